"""Order MinHash fingerprints of texts, in DataFrame functions only.

A text's k-mers of words are numbered by occurrence, so a repeated k-mer counts each time. For each
of `sketches` hash functions the numbered k-mers fall into two halves of the hash range; the minimal
one of each half is selected, the two are put in text order, and the pair is hashed. Likeness is the
share of equal components, which falls with changed, moved and swapped words.

Each document is also edited: its last floor(n_chars / 2) code points give way to the beginning of the
next document by doc_id (after the last: the first). To bring neighbours together with one shuffle of
the texts, doc_ids are cut into ranges of about equal counts; a range is the shuffle key, and k-mers,
numbering and minima are all worked out inside it.

Defined cases: null text is empty; a text without words has the fingerprint of zeros; a text with fewer
words than k has one k-mer; rows that share a doc_id are ordered by a hash of their text; null doc_ids
come first. In texts of more than 2^26 words, later words count as one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import h64, width, written

K, SKETCHES = 3, 32
PLACE_BITS = 26
MOST_RANGES = 65_536


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def kmers(w: str, k: int) -> Column:
    """Hashes of the k-mers of the words in column w, in text order. w is a column of its own: inside the lambda, an
    expression would be worked out again for each k-mer."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each).when(F.size(w) > 0, F.array(F.xxhash64(w)))


def ranges(docs: DataFrame, parts: int) -> Column:
    """The range of `parts` about equal ones that doc_id is in, by a search in two levels of bounds."""
    at = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", at or [0.5], 100 * max(100, parts)).alias("b")).first()["b"] or []
    bounds = sorted(set(found)) if parts > 1 else []
    if not bounds:
        return F.lit(0)
    side = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    key = F.col("doc_id")
    coarse = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.size(F.filter(coarse, lambda b: b <= key)) - 1
    fine = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    inside = F.size(F.filter(F.get(fine, block), lambda b: b <= key))
    return F.when(key.isNull() | (block < 0), 0).otherwise(block * side + inside).cast("int")


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """part, rn (place in it), doc_id, text and next_text (of the next document; only as much as is needed)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", ranges(docs, parts))
    rows = rows.withColumn("th", h64(F.col("text")))
    # The first document of each range, found by its key; at most MOST_RANGES small rows are broadcast.
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    order = W.partitionBy(F.lit(0)).orderBy("part")
    back = F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy(F.lit(0))))
    first = first.select(F.col("f.doc_id").alias("d"), F.col("f.th").alias("h"), back.alias("to"))
    match = rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("h"))
    heads = rows.join(F.broadcast(first), match).select("to", F.col("text").alias("head")).dropDuplicates(["to"])
    in_part = W.partitionBy("part").orderBy("doc_id", "th")
    # A fixed number of partitions: small ones merged again would make the sorts of k-mers spill.
    rows = rows.repartition(parts, "part").withColumns({"rn": F.row_number().over(in_part), "follow": F.lead("text").over(in_part)})
    rows = rows.join(heads, rows["part"] == heads["to"], "left")
    half = F.floor(F.char_length("text") / 2).cast("int")
    return rows.select("part", "rn", "doc_id", "text", F.substring(F.coalesce("follow", "head", F.lit("")), F.lit(1), half).alias("next_text"))


def sketch(kmer: DataFrame, by: list[str], sketches: int) -> DataFrame:
    """kmer: by, pos, h and key (one number for by and h). One row for each by: fingerprint array<int>."""
    occurrence = F.row_number().over(W.partitionBy("key", by[0]).orderBy("pos"))
    numbered = kmer.withColumn("g", F.xxhash64("h", occurrence))
    # The hash in the high bits, the place in the low ones; the sign tells the half.
    place = F.least("pos", F.lit(2**PLACE_BITS - 1)).cast("long")
    low = F.lit(2**PLACE_BITS - 1).cast("long")
    value = [F.when(F.col("h").isNotNull(), F.xxhash64("g", F.lit(j)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(place)) for j in range(sketches)]
    numbered = numbered.select(*by, *[v.alias(f"v{j}") for j, v in enumerate(value)])
    minima = []
    for j in range(sketches):
        v = F.col(f"v{j}")
        minima += [F.min(v).alias(f"a{j}"), F.min(F.when(v >= 0, v)).alias(f"b{j}")]
    least = numbered.groupBy(*by).agg(*minima)
    parts = []
    for j in range(sketches):
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        x, y = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
        first = a.bitwiseAND(low) <= b.bitwiseAND(low)
        parts.append(F.when(a.isNull(), 0).when(b.isNull(), F.hash(x)).when(first, F.hash(x, y)).otherwise(F.hash(y, x)))
    return least.select(*by, F.array(*parts).alias("fingerprint"))


def likeness(a: Column, b: Column, sketches: int) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(sketches))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def op1_order_minhash(docs: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    spark = docs.sparkSession
    parts = min(MOST_RANGES, width(spark, 8))
    rows = neighbours(docs, parts)
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("next_text"))
    rows = rows.select("part", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    texts = rows.select("part", "rn", F.posexplode(F.array("text", "edited")).alias("kind", "t"))
    cut = texts.select("part", (F.col("rn") * 2 + F.col("kind")).alias("rn"), words(F.col("t")).alias("w"))
    grams = cut.select("part", "rn", F.posexplode_outer(kmers("w", k)).alias("pos", "h"))
    grams = grams.withColumn("key", F.xxhash64("rn", "h"))
    prints = sketch(grams, ["part", "rn"], sketches)
    prints = written(prints, "fingerprints")
    facts_ = written(rows.select("part", "rn", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")), "facts")
    own = prints.where("rn % 2 = 0").select("part", F.shiftright("rn", 1).alias("rn"), F.col("fingerprint").alias("own"))
    changed = prints.where("rn % 2 = 1").select("part", F.shiftright("rn", 1).alias("rn"), F.col("fingerprint").alias("changed"))
    out = facts_.join(own, ["part", "rn"]).join(changed, ["part", "rn"])
    order = W.partitionBy(F.lit(0)).orderBy("part")
    first = own.where("rn = 1").select("part", F.col("own").alias("first"))
    back = F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy(F.lit(0))))
    first = first.select(back.alias("part"), "first")
    out = out.withColumn("follow", F.lead("own").over(W.partitionBy("part").orderBy("rn"))).join(first, "part", "left")
    follow = F.coalesce("follow", "first")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), sketches).alias("near_edited"), likeness(F.col("own"), follow, sketches).alias("near_next"),
    )
