"""Tables that take batches: rows are written first, a row that commits them last, and readers see committed batches only.

A batch that is killed half-way leaves files that nothing refers to; trying it again adds its rows once. A batch that fails
leaves a row that says so. One writer at a time. All files are Parquet below the table's path, which any cluster store can be.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "version long, batch string, status string, rows long, error string, at timestamp"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch, also for those that failed."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def _commit(spark: SparkSession, path: str, version: int, batch: str, status: str, rows: int | None, error: str | None) -> None:
    row = spark.createDataFrame([(version, batch, status, rows, error)], COMMITS.rpartition(", ")[0]).withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def current(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """Committed rows with the version that brought them, as of a version (none: the latest). A version names its own folder, so
    others are not read."""
    done = commits(spark, path).where("status = 'ok' and rows > 0")
    done = done if version is None else done.where(F.col("version") <= version)
    folders = [f"{path}/rows/version={r['version']}/{r['batch']}" for r in done.select("version", "batch").collect()]  # a row for each batch ever written
    names = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    if not folders:
        return spark.createDataFrame([], f"{names}, version long")
    return spark.read.schema(f"{names}, version long").option("basePath", f"{path}/rows").parquet(*folders)


def first_rows(rows: DataFrame, key: list[str], known: DataFrame | None = None, by: list[str] = []) -> DataFrame:
    """One row of each key, the least of all columns, without keys that known has; a key with a null is never known. Rows and known
    keys meet in one shuffle. by: columns of the key, of many values with few rows each, that deal rows out; rows that share them
    arrive beside each other as they were read and stored, and compress better than rows dealt out by the whole key."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.select(*key, F.struct(*(rest or [F.lit(0).alias("_")])).alias("_row"))
    if known is not None:
        none = F.lit(None).cast(out.schema["_row"].dataType)
        out = out.withColumn("_known", F.lit(False)).unionByName(known.dropna(subset=key).select(*key, none.alias("_row"), F.lit(True).alias("_known")))
    out = out.repartition(*by) if by else out
    if known is None:
        out = out.groupBy(*key).agg(F.min("_row").alias("_row"))
    else:
        out = out.groupBy(*key).agg(F.min("_row").alias("_row"), F.bool_or("_known").alias("_known")).where("not _known")
    return out.select(*key, "_row.*").select(*key, *rest)


def add_batch(spark: SparkSession, path: str, rows: DataFrame | Callable[[], DataFrame], key: list[str] = [], replace: bool = False, by: list[str] = []) -> int:
    """Commits a batch and returns its version. With a key, rows whose key the table has already are left out, and of
    those that share one, one stays (the least of all columns); with replace=True they are taken, and by_key() shows the latest.
    by: see first_rows()."""
    version = (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    batch = f"batch-{uuid.uuid4().hex}"
    where = f"{path}/rows/version={version}/{batch}"
    try:
        rows = rows() if callable(rows) else rows
        if key:
            rows = first_rows(rows, key, None if replace else current(spark, path, rows.schema), by)
        rows.write.parquet(where)
        n = spark.read.schema(rows.schema).parquet(where).count()
    except Exception as e:
        _commit(spark, path, version, batch, "failed", None, str(e)[:1000])
        raise
    _commit(spark, path, version, batch, "ok", n, None)
    return version


def by_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """The latest row of each key, of rows with a version."""
    rest = [c for c in rows.columns if c not in (*key, "version")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(*key, "_row.*")


SITES = "site_code string, site_id long, site_name string"


def sites(spark: SparkSession, path: str) -> DataFrame:
    return by_key(current(spark, path, SITES), ["site_code"])


def upsert_sites(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """found: site_code, site_name. Known codes keep their number and take the new name (none: the code); new ones get the next
    numbers, which may have gaps. Returns the sites as they are then."""
    have = sites(spark, path)
    last = have.agg(F.coalesce(F.max("site_id"), F.lit(0)).alias("last"))
    found = found.groupBy("site_code").agg(F.max(F.nullif("site_name", F.lit(""))).alias("site_name"))
    rows = found.join(have.select("site_code", "site_id"), "site_code", "left").crossJoin(F.broadcast(last))
    number = F.coalesce("site_id", F.col("last") + 1 + F.monotonically_increasing_id())
    add_batch(spark, path, rows.select("site_code", number.alias("site_id"), F.coalesce("site_name", "site_code").alias("site_name")), ["site_code"], replace=True)
    return sites(spark, path)


def load_tabs(spark: SparkSession, path: str, tabs: dict[str, Callable[[], DataFrame]], required: tuple[str, ...] = ("links",)) -> DataFrame:
    """Loads each tab of a workbook into a table of its own. A tab that breaks leaves its failed row, and the others go on; if a
    required one breaks, the load stops there. Returns (tab, status, rows, error) of this load."""
    out = []
    for tab in sorted(tabs, key=lambda x: (x not in required, x)):
        try:
            add_batch(spark, f"{path}/{tab}", tabs[tab])
        except Exception:
            if tab in required:
                raise
        out.append(commits(spark, f"{path}/{tab}").orderBy(F.desc("version")).limit(1).select(F.lit(tab).alias("tab"), "status", "rows", "error").first())
    return spark.createDataFrame(out, "tab string, status string, rows long, error string")
