"""Helpers that the corpus operators share: tables in the shared folder, order numbering, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process (master local) may do
    without, and gets a folder of its own there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, rows: int, each: int = 20_000) -> int:
    """Tasks (and files) for so many rows; no more than the session's shuffle partitions."""
    return max(1, min(width(spark), -(-rows // each)))


def written(df: DataFrame, kind: str, codec: str = "zstd", parts: int | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder. parts: where the number of rows is known, the number
    of tasks that write them, so that a small table is no multitude of tiny files."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df = df if parts is None else df.coalesce(parts)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, times: int = 1) -> int:
    """Number of partitions for an explicit repartition; it follows the session's setting, which grows with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * times


def free_name(df: DataFrame, like: str) -> str:
    """A column name that df does not have, in any case."""
    taken, name, i = {c.lower() for c in df.columns}, f"_{like}", 0
    while name.lower() in taken:
        name, i = f"_{like}_{i}", i + 1
    return name


def h64(*cols: Column | int | str) -> Column:
    return F.xxhash64(*[F.lit(c) if isinstance(c, (int, str)) else c for c in cols])


def join_hot(rows: DataFrame, keys: DataFrame, by: list[str], times: str, keep: list[str] = [], share: int = 1024) -> DataFrame:
    """rows whose key (no null in it) is in keys (a written table with one row for each key; `times`: how often rows has
    it), with the columns `keep` of keys. Keys with more than 1/share of all are broadcast, fewer than `share` of them; the
    others go by shuffle."""
    total = keys.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    often = F.col(times) > total / share
    hot, cold = (keys.where(x).select(*by, *keep) for x in (often, ~often))
    return rows.join(F.broadcast(hot), by).unionByName(rows.join(F.broadcast(hot), by, "left_anti").join(cold, by))


def with_parts(rows: DataFrame, by: str, most: int, part: str, row: str = "id") -> DataFrame:
    """rows with `part`, a number by hash of `row` so that a part of a value of `by` has about `most` rows, and `parts`."""
    large = rows.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(large, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.withColumn(part, F.pmod(h64(3, F.col(row)), F.col("parts")).cast("int"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the undirected graph with edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes. Each step groups by
    one end with a partial minimum and joins it back, so a hub with very many neighbours is
    split by the engine's skew join and never collected. Nodes without edges are not in the result.
    """
    ids = dict(edges.dtypes)["a"]
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    n = e.count()
    if not n:
        return e.sparkSession.createDataFrame([], f"node {ids}, component {ids}")
    parts = parts_for(e.sparkSession, n, 50_000)
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38, 0)"))]
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large, "edges", parts=parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        e = written(small, "edges", parts=parts)
        now = tuple(e.agg(*state).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def running_totals(counts: DataFrame, part: str, value: str, by: str | None = None) -> DataFrame:
    """Exclusive prefix sums of `value` over `part` (one row for each partition, so few rows), within `by`."""
    w = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
