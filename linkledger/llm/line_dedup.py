"""Line-level deduplication across documents.

Normalised lines are exploded with their positions and hashed (128 bits); hashes held by enough
distinct documents lose their lines everywhere but in the largest doc_id that holds them, and a
document is put together again from the positions that stay.

The positions of repeated lines are found by two joins: hashes with more than 1/1024 of all
repeated lines (so at most 1,023 of them) are broadcast, all others are joined by shuffle.

Defined cases: null and empty texts are one empty line; a row with a null doc_id is counted in
no document and loses nothing; rows that repeat a doc_id are one document; a document whose
every line goes has the empty text; an empty table gives no rows; columns of any name are kept, but for
those that the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import h64, join_hot, written

#: The ASCII white space that is stripped.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row (a struct of docs' columns), text (what is kept), n_lines and n_dropped."""
    own = docs.select("doc_id", "text", h64(F.col("text")).alias("th"))
    lines = own.select("doc_id", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where((F.char_length("key") >= min_chars) & F.col("doc_id").isNotNull())
    lines = written(lines.select("doc_id", "th", "pos", h64(F.col("key")).alias("h1"), h64(7, F.col("key")).alias("h2")), "lines")
    held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
    often = written(held.agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs), "often")
    found = join_hot(lines, often, ["h1", "h2"], "n", ["last"])
    gone = found.where("doc_id <> last").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    rest = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), h64(F.col("text")).alias("t"))
    both = rest.join(gone, (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("t")), "left").select("row", "gone", _lines(F.col("row.text")).alias("all"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("all"), i)), "\n"))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return both.select("row", kept.alias("text"), F.size("all").cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of docs with the kept text, and n_lines and n_dropped; clashing columns are replaced."""
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    return _judged(docs, min_chars, min_docs).select(*[F.col("row")[c].alias(c) for c in rest], "text", "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows and columns of docs with the kept text."""
    return _judged(docs, min_chars, min_docs).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
