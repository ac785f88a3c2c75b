"""Summaries of sheets that stay small whatever the sheets hold, and that merge over files.

Lists are bounded by rank: the first k of a group by count, the rest as one remainder. The filter on the rank reaches the
tasks before the shuffle, so a group of very many items sends k rows from each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkledger.functions.cells import SLUGS, present
from linkledger.sources.ledger import add_batch, current

from .counters import location_optics, sheet_ends


def first_items(counts: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank, from 1."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def top_items(counts: DataFrame, group: list[str], item: str, k: int) -> DataFrame:
    """counts: group, item, n. Rows (group, item, n, items, rank): the k commonest items of a group, ties by item, and one row of
    rank k + 1 without an item for how many others there are (items) and their sum, where there are any."""
    top = first_items(counts.select(*group, item, "n"), group, [F.desc("n"), item], k)
    sums = counts.groupBy(*group).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    shown = top.groupBy(*group).agg(F.sum("n").alias("shown"), F.count("*").alias("rows"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]
    rest = sums.alias("s").join(shown.alias("t"), on).where("kinds > rows")
    kind = dict(counts.dtypes)[item]
    rest = rest.select(*[F.col(f"s.{c}").alias(c) for c in group], F.lit(None).cast(kind).alias(item), (F.col("all") - F.col("shown")).alias("n"), (F.col("kinds") - F.col("rows")).alias("items"), F.lit(k + 1).alias("rank"))
    return top.withColumn("items", F.lit(1).cast("long")).select(*rest.columns).unionByName(rest)


def optic_locations(df: DataFrame, k: int = 10, per: tuple[str, ...] = ()) -> DataFrame:
    """Where the ends of each optic are: the k commonest places and the rest."""
    counts = sheet_ends(df, per).where(present("optic") & present("loc_cab_ru")).groupBy(*per, "optic", "loc_cab_ru").agg(F.count("*").alias("n"))
    return top_items(counts, [*per, "optic"], "loc_cab_ru", k)


def model_devices(df: DataFrame, k: int = 5, per: tuple[str, ...] = ()) -> DataFrame:
    """Of each model the k first devices in reading order (A ends before Z ends of a row), and on each row how many devices it has."""
    ends = sheet_ends(df, per).where(present("device")).withColumn("model", F.when(present("model"), F.col("model")).otherwise("UNKNOWN"))
    each = ends.groupBy(*per, "model", "device").agg(F.min(F.struct("row_idx", "side")).alias("at"))
    first = first_items(each, [*per, "model"], ["at", "device"], k)
    total = each.groupBy(*per, "model").agg(F.count("*").alias("devices"))
    return first.join(total, [*per, "model"]).select(*per, "model", "device", "rank", "devices")


#: The statuses that get a column of their own.
SHOWN = sorted(set(SLUGS.values()))


def status_by_section(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """How many rows of each section have each status, one column a status, null as 0; rows without a section or status don't count."""
    rows = df.where(present("section") & present("status"))
    return rows.groupBy(*per, "section").pivot("status_normalized", SHOWN).count().na.fill(0, SHOWN)


def optic_pairs(df: DataFrame, k: int | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of different optics at both ends of a row by how often they meet, with the share of the first row that shows one; the k
    commonest of each sheet, or all."""
    rows = df.where(present("a_optic") & present("z_optic") & (F.col("a_optic") != F.col("z_optic")))
    pairs = rows.groupBy(*per, "a_optic", "z_optic").agg(F.count("*").alias("n"), F.min_by(F.struct("row_idx", "section", "a_device", "z_device"), "row_idx").alias("example"))
    order = [F.desc("n"), "a_optic", "z_optic"]
    pairs = first_items(pairs, list(per), order, k) if k and per else pairs.orderBy(*order).limit(k) if k else pairs
    return pairs.select(*per, "a_optic", "z_optic", "n", "example.*")


# Context over files: parts of one file each, stored once, merged at any time.

COUNTS = "file_hash string, kind string, name string, location string, n long, a long, z long"
EVIDENCE = "file_hash string, kind string, name string, location string, row_idx string, place string"


def file_parts(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """df: rows of sheets with file_hash. Counts of optics by the A location of their row and of models by location, and for each
    optic and location the k first cells that show it."""
    per = ("file_hash",)
    cells = location_optics(df, per).select(*per, F.lit("optic").alias("kind"), F.col("optic").alias("name"), "location", "row_idx", F.col("optic_column").alias("place"))
    optics = cells.groupBy(*per, "kind", "name", "location").agg(F.count("*").alias("n"), F.count_if(F.col("place") == "a_optic").alias("a"), F.count_if(F.col("place") == "z_optic").alias("z"))
    ends = sheet_ends(df, per).where(present("model"))
    models = ends.groupBy(*per, F.lit("model").alias("kind"), F.upper("model").alias("name"), F.col("loc_cab_ru").alias("location")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "Z").alias("z"))
    shown = first_items(cells, [*per, "kind", "name", "location"], ["row_idx", "place"], k).drop("rank").withColumn("row_idx", F.col("row_idx").cast("string"))
    return optics.unionByName(models), shown


#: Lists of this many files are small enough for a broadcast, some 10 MB.
LISTED = 100_000


def _listed(files: DataFrame, n: int) -> DataFrame:
    """A list of n files to join rows with. It is broadcast, as rows that are shuffled by file meet in as many tasks as there are files."""
    return F.broadcast(files) if n <= LISTED else files


def add_files(spark: SparkSession, path: str, df: DataFrame, k: int = 10) -> int:
    """Stores the parts of files that are not stored yet; returns how many. The list of files is committed last."""
    known = current(spark, f"{path}/files", "file_hash string").select("file_hash")
    new = df.select("file_hash").distinct().join(known, "file_hash", "left_anti")
    n = new.count()
    if n:
        counts, shown = file_parts(df.join(_listed(new, n), "file_hash", "left_semi"), k)
        add_batch(spark, f"{path}/counts", counts)
        add_batch(spark, f"{path}/evidence", shown)
        add_batch(spark, f"{path}/files", new, ["file_hash"])
    return n


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of files that are committed, once each: a file that was added again after a break has its rows in two versions, of which
    the last counts. Rows are compared by file and version, which leaves them where they are."""
    files, rows = current(spark, f"{path}/files", "file_hash string").select("file_hash"), current(spark, f"{path}/{name}", schema)
    n = files.count()
    last = rows.groupBy("file_hash").agg(F.max("version").alias("version")).join(_listed(files, n), "file_hash", "left_semi")
    return rows.join(_listed(last, n), ["file_hash", "version"], "left_semi").drop("version")


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = _stored(spark, path, "counts", COUNTS)
    return rows.groupBy("kind", "name", "location").agg(*[F.sum(c).alias(c) for c in ("n", "a", "z")], F.count("*").alias("files"))


def merged_evidence(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """The k first cells of each optic and location over all files, by file and row: each of them is among the first k of its file."""
    rows = _stored(spark, path, "evidence", EVIDENCE)
    return first_items(rows, ["kind", "name", "location"], ["file_hash", "row_idx", "place"], k)
