"""Views that are kept as tables and refreshed upload by upload.

Each view is stored by site and upload. A refresh computes only uploads that are new or were loaded again since, and puts
their partitions in place of the old ones; the log row comes last. Rows carry the time of the load they were computed from, and
readers take those that fit the upload as it is now, so that a refresh that broke half-way, a load without rows, or an upload
that is no longer active leaves nothing wrong behind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.functions.cells import present

from .shapes import ends, status_counts

LOG = "upload_id long, created_at timestamp, refreshed_at timestamp, triggered_by string"
PER = ("site_id", "upload_id")


def _by_side(links: DataFrame) -> DataFrame:
    return ends(links).where(present("optic")).groupBy(*PER, "optic", "side").agg(F.count("*").alias("total"), *status_counts())


def _combined(links: DataFrame) -> DataFrame:
    optic = F.coalesce(F.when(present("a_optic"), F.col("a_optic")), F.when(present("z_optic"), F.col("z_optic")))
    return links.withColumn("optic", optic).where("optic is not null").groupBy(*PER, "optic").agg(F.count("*").alias("total"), *status_counts())


def _statuses(links: DataFrame) -> DataFrame:
    return links.groupBy(*PER, "section", "status", "status_normalized").agg(F.count("*").alias("cnt"))


def _devices(links: DataFrame) -> DataFrame:
    """By device and port, so that the ports of several active uploads of a site can be told apart."""
    rows = ends(links).where(present("device"))
    return rows.groupBy(*PER, "device", "port").agg(F.max(F.when(present("model"), F.col("model"))).alias("model"), F.count("*").alias("connections"))


VIEWS = {"optic_inventory_by_side": _by_side, "optic_inventory_combined": _combined, "cable_status_summary": _statuses, "device_summary": _devices}
#: Views with rows of single devices, whose number grows with the links. The tasks that count them write them, where a second shuffle would
#: bring each upload into one task; others are small and become one file for each upload.
LARGE = {"device_summary"}
#: How a view's rows of several active uploads of a site come together.
MERGED = {
    "optic_inventory_by_side": (["site_id", "optic", "side"], ["total", "in_service", "failed", "pending"]),
    "optic_inventory_combined": (["site_id", "optic"], ["total", "in_service", "failed", "pending"]),
    "cable_status_summary": (["site_id", "section", "status", "status_normalized"], ["cnt"]),
}


def refresh_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def changed_uploads(uploads: DataFrame, log: DataFrame) -> DataFrame:
    """Uploads without a refresh since they were loaded."""
    return uploads.select("upload_id", "created_at").join(log.select("upload_id", "created_at"), ["upload_id", "created_at"], "left_anti")


def refresh(links: DataFrame, uploads: DataFrame, path: str, triggered_by: str = "data_load") -> int:
    """Brings the views below path up to date; returns how many uploads were computed. links: partitioned by site and upload, so
    that uploads which have not changed are not read."""
    spark = links.sparkSession
    log = refresh_log(spark, path)
    new = changed_uploads(uploads, log).withColumn("upload_id", F.col("upload_id").cast("long"))
    n = new.count()
    if not n:
        return 0
    now = spark.sql("select current_timestamp() as at").first()["at"]
    new = F.broadcast(new) if n <= 10_000 else new
    rows = links.join(new.select("upload_id"), "upload_id", "left_semi")
    for name, view in VIEWS.items():
        out = view(rows).join(new, "upload_id")
        out = out if name in LARGE else out.repartition(*PER)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PER).parquet(f"{path}/{name}")
    new.select("upload_id", "created_at", F.lit(now).alias("refreshed_at"), F.lit(triggered_by).alias("triggered_by")).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return n


def read_view(spark: SparkSession, path: str, name: str, uploads: DataFrame) -> DataFrame:
    """A view over the active uploads, as of their last load."""
    active = uploads.where("is_active").select(F.col("upload_id").cast("long").alias("upload_id"), "created_at")
    rows = spark.read.parquet(f"{path}/{name}").withColumn("upload_id", F.col("upload_id").cast("long")).join(active, ["upload_id", "created_at"])
    if name == "device_summary":
        return rows.groupBy("site_id", "device").agg(F.max("model").alias("model"), F.sum("connections").alias("connections"), F.countDistinct("port").alias("ports"))
    keys, sums = MERGED[name]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
