"""Reading workbooks' tabs as CSV or Parquet, all columns as text and with the row's place in its file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words in names of tabs that hold no inventory, and whole names.
SKIPPED_WORDS, SKIPPED_NAMES = {"backup", "old", "archive", "deprecated"}, {"overhead"}


def holds_inventory(tab: str) -> bool:
    """Not a backup, a copy, a legend, an overview or a sheet that nobody has named."""
    low = tab.strip().lower()
    copied = re.sub(r"[\s_]", " ", low).startswith("copy of ")
    legend = re.split("[-_]", low)[0] == "legend"
    unnamed = low.startswith("sheet") and low[5:].isdecimal()
    return bool(low) and not (copied or legend or unnamed or low in SKIPPED_NAMES or SKIPPED_WORDS & set(re.split(r"\W+", low)))


def wanted_tabs(names: list[str]) -> list[str]:
    return [n for n in names if n and holds_inventory(n)]


def pick_tab(names: list[str], fits=lambda name: True) -> str | None:
    """CUTSHEET_CLEAN, else CUTSHEET, else the first wanted tab that fits(), else none."""
    by_name = {n.strip().upper(): n for n in names}
    for exact in ("CUTSHEET_CLEAN", "CUTSHEET"):
        if exact in by_name:
            return by_name[exact]
    return next((n for n in wanted_tabs(names) if fits(n)), None)


def has_link_columns(columns: list[str]) -> bool:
    """A link tab has an optic column and a device or port column."""
    low = [c.lower() for c in columns]
    return any("optic" in c for c in low) and any("device" in c or "dns-name" in c or "port" in c for c in low)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, with file and row_idx. A file's lines are numbered by their offset in the scan, so row_idx
    follows the order in the file and has gaps between splits."""
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * 2**20 + F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))).alias("row_idx"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file, to skip those that were loaded before."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"))


def new_files(found: DataFrame, loaded: DataFrame) -> DataFrame:
    return found.join(loaded.select("file_hash"), "file_hash", "left_anti")


def write_links(links: DataFrame, path: str, dealt: bool = False) -> None:
    """Appends to the table that is laid out by site and upload, so that queries read only their uploads. The rebalance joins
    small uploads' rows and splits large ones; dealt: each task has rows of a few uploads already."""
    links = links if dealt else links.hint("rebalance", "site_id", "upload_id")
    links.write.mode("append").option("compression", "zstd").partitionBy("site_id", "upload_id").parquet(path)


def activate_latest(uploads: DataFrame) -> DataFrame:
    """is_active anew: the latest upload of each site."""
    last = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("upload_id")))
    return uploads.withColumn("is_active", last == 1)
