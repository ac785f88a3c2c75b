"""Sorted exports of any size, and the rows of the summaries that are exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.cells import natural_key


def write_sorted_csv(df: DataFrame, path: str, *keys: Column | str, files: int | None = None) -> None:
    """CSV files that are the table in the order of the keys when read by name, each with a header: ranges of the keys go to one
    file each, so no task holds the whole. Rows that agree in all keys are in the order of their other columns."""
    order = [*keys, *df.columns]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("header", True).option("emptyValue", "").csv(path)


def by_name(*columns: str) -> list[Column]:
    """Keys in which runs of digits compare as numbers."""
    return [natural_key(c) for c in columns]


def summary_rows(interfaces: DataFrame) -> DataFrame:
    """(section, category, name, count): devices by model, then interfaces by category and label; the commonest first of each."""
    named = interfaces.where(F.coalesce("device_name", F.lit("")) != "")
    devices = named.groupBy(F.lit("Devices").alias("section"), F.lit("Device Model").alias("category"), F.col("model").alias("name")).agg(F.countDistinct("device_name").alias("count"))
    ports = named.groupBy(F.lit("Interfaces").alias("section"), F.col("type_category").alias("category"), F.col("type_label").alias("name")).agg(F.count("*").alias("count"))
    return devices.unionByName(ports)


def write_summary(interfaces: DataFrame, path: str) -> None:
    write_sorted_csv(summary_rows(interfaces), path, F.asc("section"), F.desc("count"))


def rack_serials(devices: DataFrame, racks: list[int]) -> DataFrame:
    """Devices of the asked racks: rack (R and its number), ru (a whole number, 0 if it is none), serial, name, asset_tag."""
    number = F.expr("try_cast(regexp_extract(rack, '([0-9]+)', 1) as int)")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = devices.withColumn("_rack", number).where(F.col("_rack").isin(*racks))
    ru = F.coalesce(F.expr("try_cast(try_cast(position as double) as int)"), F.lit(0))
    return rows.select(F.concat(F.lit("R"), F.col("_rack").cast("string")).alias("rack"), ru.alias("ru"), text("serial"), text("name"), text("asset_tag"))


def write_rack_serials(devices: DataFrame, racks: list[int], path: str) -> None:
    """By rack number, from the top of each rack down."""
    write_sorted_csv(rack_serials(devices, racks), path, natural_key("rack"), F.desc("ru"), F.asc("name"))
