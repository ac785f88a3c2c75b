"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a hash in (0, 1); the shard with the least -ln(hash) / weight takes
the record. The winner depends on the key and the shards alone, so a new shard takes records
only into itself, and each of the others keeps all it does not lose to it.

Defined cases: a null key is one more key (all such rows share a shard); a null text has size 1
and the checksum of the empty text; repeated rows get the same shard and slots of their own; an
empty table gives no rows. Slots follow the key's order within a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import h64, running_totals, width, written

SEED = 20_011


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of a key, 0 to len(weights) - 1; shards of weight 0 take nothing."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(h64(SEED, key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
            scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def shard_rows(docs: DataFrame, weights: list[float], grown: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and the gapless slot of each row in its shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    lean = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Ranges of (key, row): a key that repeats very often is cut, too.
    ranged = lean.repartitionByRange(width(docs.sparkSession), "k", "at").withColumn("part", F.spark_partition_id())
    rows = written(ranged, "shard-rows")
    counts = running_totals(rows.groupBy("part", "shard").agg(F.count("*").alias("n")), "part", "n", by="shard")
    place = F.row_number().over(W.partitionBy("part", "shard").orderBy("k", "at")) - 1
    return (
        rows.withColumn("place", place)
        .join(counts.select("part", "shard", "before"), ["part", "shard"])
        .select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
    )


def op4_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    return shard_rows(docs, [1.0] * shards, [1.0] * (shards + 1)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int")
    )
