"""Shapes that many queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkledger.functions.cells import FAILED, IN_SERVICE, PENDING, family, present


def ends(links: DataFrame) -> DataFrame:
    """Two rows per link, its A end and its Z end, from one scan."""
    fields = {"device": "device", "port": "port", "optic": "optic", "model": "model", "loc": "loc_cab_ru", "breakout": "breakout_loc"}
    each = [F.struct(F.lit(s.upper()).alias("side"), *[F.col(f"{s}_{c}").alias(n) for n, c in fields.items()]) for s in ("a", "z")]
    ports = F.concat_ws("|", "a_device", "a_port", "z_device", "z_port").alias("ports")
    return links.select("id", "site_id", "upload_id", "section", "status_normalized", "cable_id", ports, F.inline(F.array(*each)))


def physical_optics(rows: DataFrame) -> DataFrame:
    """Ends with an optic; of breakout ends that share upload, location and port, the lowest id. Whatever is not empty is a
    breakout, also the literal nan. Only breakout ends are shuffled, as one row for each of their places and tasks."""
    rows = rows.where(present("optic"))
    broken, blank = F.coalesce(F.col("breakout") != "", F.lit(False)), F.lit("")
    kept = ["id", "side", "site_id", "upload_id", "status_normalized", "optic"]
    place = [F.coalesce(c, blank).alias(f"_{c}") for c in ("loc", "port")]
    first = rows.where(broken).groupBy("side", "upload_id", *place).agg(F.min_by(F.struct(*kept), "id").alias("_row")).select("_row.*")
    return rows.where(~broken).select(*kept).unionByName(first)


def status_counts() -> list:
    return [F.count_if(family("status_normalized", s)).alias(n) for n, s in (("in_service", IN_SERVICE), ("failed", FAILED), ("pending", PENDING))]


def scope(df: DataFrame, site_id: int | None = None, upload_id: int | None = None) -> DataFrame:
    if site_id is not None:
        df = df.where(F.col("site_id") == site_id)
    return df if upload_id is None else df.where(F.col("upload_id") == upload_id)


def like(column: str, text: str):
    """Contains, in any case; the empty text is no filter."""
    return F.lit(True) if not text else F.lower(column).contains(text.lower())


def contains_any(column: str, texts):
    """Contains one of the texts, in any case."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(column).contains(x.lower()) for x in texts]), F.lit(False))


def top(df: DataFrame, *order, limit: int | None = None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def with_group_total(df: DataFrame) -> DataFrame:
    """Number of all rows, by a one-row aggregate that is broadcast (a window over everything would use one task). It uses all
    columns, so that both sides are one plan below, whose exchange is made once."""
    used = F.coalesce(F.bit_xor(F.hash(*df.columns)), F.lit(0)) * 0
    return df.crossJoin(F.broadcast(df.agg((F.count("*") + used).alias("total_groups"))))
