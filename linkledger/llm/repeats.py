"""Removal of repeated passages: every byte under a string of `length` bytes that also starts anywhere else.

The suffixes (byte positions) that can matter are sorted into buckets by bucket-pointer refinement.

1. Thinning. Each start of a `length`-byte string points to the least hash among the `gram`-byte
   strings inside it (ties: the first), its anchor. Equal strings point to equal grams at equal distances,
   so the starts of each possible match have anchors in one gram bucket. Consecutive starts with one anchor
   are a window. Windows whose gram is in no other place can't match and go; windows of equal content (same
   bytes, same distance to the anchor) are repeated as a whole, which partial sums count, so a passage in a
   third of all documents is no hot group. Of each content one window stays.
2. Refinement, in buckets with different contents. Each byte position of the windows gets a pointer to the bucket of
   the 40 bytes there. A pass sorts the positions of each bucket on the pointers of the positions as many
   bytes later as the pointers tell apart, and writes the new pointers back for the next pass, which so
   goes twice as far: 40, 80, 160, then `length` bytes. Positions alone in their bucket drop out, and so do, unsorted,
   those whose later position has dropped out. Starts that share their last bucket are repeated.
3. A gram bucket of more than `big` contents is spread over all executors start by start, each with the bucket
   identifier that the same passes give it (as a hash of the identifiers before), and partial sums count them.

Results are exact but for collisions of 64-bit hashes. Defined cases: null text is empty; texts shorter than `length`
bytes keep all; rows that repeat a doc_id, also with equal texts, are each judged by themselves and repeat each
other; a null doc_id is a key like any other; an empty table gives no rows; columns of any name are kept,
but for those that the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import free_name, h64, join_hot, width, written
from .units import let_go

#: Bytes of an anchor, of a first bucket; contents of a gram bucket that is spread out, contents of one call.
GRAM, STEP, BIG, CALL = 80, 40, 1024, 8_000
SLICE = 1 << 20
#: Windows of a document in one row.
PER_ROW = 1_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n bytes (a multiple of 8) at each place."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    h = np.full(m, n, np.uint64)
    for k in range(0, n, 8):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ words[k : k + m])
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m = len(v)
    rows = -(-m // w)
    p = np.full(rows * w, np.uint64(2**64 - 1))
    p[:m] = v
    p = p.reshape(rows, w)
    after = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    before = np.minimum.accumulate(p, 1).ravel()
    return np.minimum(after[: m - w + 1], before[w - 1 : m])


def windows(data: np.ndarray, length: int, gram: int):
    """(gram hash, first start, starts, distance of the anchor from the first start) of each window. A window goes no
    further than a slice of the data; slices follow each other without loss."""
    starts = len(data) - length + 1
    for lo in range(0, max(0, starts), SLICE):
        part = data[lo : lo + min(SLICE, starts - lo) + length - 1]
        h = gram_hashes(part, gram)
        v = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        low = sliding_min(v, length - gram + 1)
        cut = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]]))
        at = (low[cut[:-1]] & np.uint64(0xFFFFFF)).astype(np.int64)
        yield h[at], lo + cut[:-1], np.diff(cut), at - cut[:-1]


WINDOWS = "k long, t long, anchor long, whole long, place long"


def window_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: k, t (key of the row), text. place packs first start, number of starts and distance of the anchor."""

    def run(batches):
        let_go()
        for batch in batches:
            k, t, cols, held = batch.column(0), batch.column(1), [], 0
            for row, raw in enumerate(batch.column(2).cast(pa.large_binary())):
                raw = raw.as_py() or b""
                data = np.frombuffer(raw, np.uint8)
                for h, first, n, d in windows(data, length, gram):
                    own = data[first[0] : first[-1] + n[-1] + length - 1]
                    whole = span_hashes(own, first - first[0], n + length - 1) + (n * 1024 + d).astype(np.uint64)
                    cols.append((np.full(len(h), row), h, _mix(whole), first * 65536 + n * 256 + d))
                    held += len(h)
                if held > 100_000:
                    yield pack(k, t, cols)
                    cols, held = [], 0
            if cols:
                yield pack(k, t, cols)

    def pack(k, t, cols):
        row, h, whole, place = (np.concatenate(c) for c in zip(*cols))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [k.take(row), t.take(row), pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(place.astype(np.int64))], ["k", "t", "anchor", "whole", "place"]
        )

    return docs.mapInArrow(run, WINDOWS)


_TABLE = np.random.default_rng(9_0909).integers(1, 2**63, 256, dtype=np.uint64)
_UP = np.uint64(0xD6E8FEB86659FD93)
_DOWN = np.uint64(pow(int(_UP), -1, 2**64))


def _powers(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, step, np.uint64)]), dtype=np.uint64) for step in (_UP, _DOWN)]


_KEPT = _powers(1 << 17)


def powers(n: int) -> list[np.ndarray]:
    """Powers of _UP and _DOWN, n of them at least: kept ones, or new ones for longer texts."""
    return _KEPT if n <= len(_KEPT[0]) else _powers(n)


def span_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, by prefix sums."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])
    return (sums[first + size] - sums[first]) * down[first]


def passes(length: int):
    """Offset of each pass: as many bytes as the pointers tell apart, at the end as many as are missing."""
    done = STEP
    while done < length:
        step = min(done, length - done)
        yield step
        done += step


def bucket_pointers(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the starts (ascending positions of data with `length` bytes of their row) shares its bucket of equal
    `length`-byte strings with another start. The passes before the last one sort all positions that they can need."""
    h = gram_hashes(data, STEP)
    place = np.full(len(data), -1, np.int64)
    place[: len(h)] = np.unique(h, return_inverse=True)[1]
    top = int(place.max(initial=0)) + 1
    shared = np.zeros(len(data), bool)
    shared[: len(h)] = np.bincount(place[: len(h)], minlength=top)[place[: len(h)]] > 1
    steps = list(passes(length))
    for i, step in enumerate(steps):
        if i == len(steps) - 1:  # rows overlap: the same place may stand in two of them, but is a start in one
            live = starts[shared[starts]]
        else:
            live = np.flatnonzero(shared[:-step])
        out = ~shared[live + step]  # the later position is alone in its bucket, and so is this one
        shared = np.zeros(len(data), bool)
        live = live[~out]
        key = place[live] << 32 | place[live + step]
        order = np.argsort(key, kind="stable")
        key, live = key[order], live[order]
        cut = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        number = np.cumsum(cut)
        place[live] = top + number
        shared[live] = np.bincount(number, minlength=1)[number] > 1
        top += len(live) + 1
        if top >= 2**31:
            place, top = np.unique(place, return_inverse=True)[1].astype(np.int64), len(place) + 1
    return shared[starts]


def bucket_identifiers(data: np.ndarray, length: int) -> np.ndarray:
    """As bucket_pointers(), for positions of one row that are compared over executors: hashes of pairs of identifiers."""
    h = gram_hashes(data, STEP)
    for step in passes(length):
        h = _mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) ^ h[step:])
    return h


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers (sorted, distinct)."""
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1, [True]])) if len(starts) else np.zeros(1, int)
    return starts[cut[:-1]], starts[cut[1:] - 1]


def repeated_starts(docs: DataFrame, length: int = 200, gram: int = GRAM, big: int = BIG) -> DataFrame:
    """(k, t, lo, hi): runs of starts whose string is repeated; docs: k, t, text."""
    spark = docs.sparkSession
    rows = window_rows(docs, length, gram)
    often = written(rows.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "anchors")
    rows = written(join_hot(rows, often, ["anchor"], "times"), "windows")
    contents = rows.groupBy("anchor", "whole").agg(F.count("*").alias("times"), F.min(F.struct("k", "t", "place")).alias("one"))
    contents = written(contents.select("anchor", "whole", "times", "one.*"), "contents")
    first, n = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    again = contents.where("times > 1")
    full = join_hot(rows, again, ["anchor", "whole"], "times").select("k", "t", first.alias("lo"), (first + n - 1).alias("hi"))
    buckets = written(contents.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"), "buckets")
    calls = max(width(spark), int(buckets.agg(F.coalesce(F.sum("contents"), F.lit(0))).first()[0] // CALL))
    open_ = join_hot(contents, buckets, ["anchor"], "contents", ["contents"])
    # Rows of at most PER_ROW windows, however many a document has. (Rows that repeat a document have known windows only.)
    open_ = open_.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.struct("anchor", "place", (F.col("times") > 1).alias("known"), (F.col("contents") > big).alias("hot")).alias("w"))
    open_ = open_.withColumn("part", F.floor(F.row_number().over(W.partitionBy("k2", "t2").orderBy("w")) / PER_ROW)).groupBy("k2", "t2", "part").agg(F.collect_list("w").alias("w"))
    texts = docs.join(open_, docs["k"].eqNullSafe(open_["k2"]) & (docs["t"] == open_["t2"]))
    cut = written(texts.select("k", "t", "text", "w").mapInArrow(lambda it: _cut(it, length), "k long, t long, anchor long, place long, known boolean, hot boolean, part binary"), "parts")

    def by_bucket(t):
        data = np.frombuffer(b"".join(t["part"].to_pylist()), np.uint8)
        place, known = t["place"].to_numpy(), t["known"].to_numpy(zero_copy_only=False)
        n = (place >> 8) & 255
        size = n + length - 1
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(bucket_pointers(data, begin[row] + within, length) & ~known[row])
        lo, hi = runs_of(hit + row[hit])  # a gap between the rows, so that no run spans two
        lo_row, at = np.searchsorted(np.cumsum(n) + np.arange(len(n)), lo, side="right"), np.cumsum(n) - n + np.arange(len(n))
        base = (place >> 16)[lo_row] - at[lo_row]
        take = pa.array(lo_row)
        return pa.table({"k": t["k"].combine_chunks().take(take), "t": t["t"].combine_chunks().take(take), "lo": pa.array(lo + base), "hi": pa.array(hi + base)})

    cold = cut.where("not hot").withColumn("g", F.pmod("anchor", F.lit(calls))).groupBy("g").applyInArrow(by_bucket, "k long, t long, lo long, hi long")
    hot = cut.where("hot").select("k", "t", "anchor", "place", "known", "part").mapInArrow(lambda it: _starts(it, length), "k long, t long, known boolean, start long, anchor long, d long, h long")
    hot = written(hot, "hot-starts")
    twice = hot.groupBy("anchor", "d", "h").agg(F.count("*").alias("times")).where("times > 1")
    found = join_hot(hot.where("not known"), written(twice, "hot-twice"), ["anchor", "d", "h"], "times")
    return full.unionByName(cold).unionByName(found.select("k", "t", F.col("start").alias("lo"), F.col("start").alias("hi")))


def _cut(batches, length):
    """Bytes of the asked windows of each text."""
    for batch in batches:
        out, held = [], 0
        for k, t, text, w in zip(*(batch.column(i) for i in range(4))):
            raw, k, t = text.as_py().encode(), k.as_py(), t.as_py()
            for x in w.as_py():
                first = x["place"] >> 16
                part = raw[first : first + ((x["place"] >> 8) & 255) + length - 1]
                out.append((k, t, x["anchor"], x["place"], x["known"], x["hot"], part))
                held += len(part)
            if held > 4_000_000:
                yield _cut_rows(out)
                out, held = [], 0
        if out:
            yield _cut_rows(out)


def _cut_rows(out):
    kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], ["k", "t", "anchor", "place", "known", "hot", "part"])


def _starts(batches, length):
    """One row for each start of windows in big buckets, with the chained identifiers."""
    for batch in batches:
        place = batch.column(3).to_numpy()
        for row, part in enumerate(batch.column(5).to_pylist()):
            n = int((place[row] >> 8) & 255)
            h = bucket_identifiers(np.frombuffer(part, np.uint8), length)[:n]
            take = pa.array(np.full(n, row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(4).take(take), pa.array((place[row] >> 16) + np.arange(n)), batch.column(2).take(take), pa.array((place[row] & 255) - np.arange(n)), pa.array(h.view(np.int64))],
                ["k", "t", "known", "start", "anchor", "d", "h"],
            )


def _without(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of raw without the spans [lo, hi), which may overlap; bytes removed and maximal spans."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    a, b = lo[new], hi[np.concatenate([new[1:], [True]])]
    pieces = zip([0, *b.tolist()], [*a.tolist(), len(raw)])
    return b"".join(raw[x:y] for x, y in pieces), int((b - a).sum()), len(a)


def _judged(docs: DataFrame, length: int, gram: int, big: int, run, fields: str) -> DataFrame:
    """docs with columns that run(raw, lo, hi) gives for each row, of the schema `fields`; clashing ones are replaced."""
    key, hash_ = F.col("doc_id").cast("long"), h64(F.col("text"))
    found = repeated_starts(docs.select(key.alias("k"), hash_.alias("t"), "text"), length, gram, big)
    per_doc = written(found.groupBy("k", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    rest = docs.select(F.struct(*docs.columns).alias("row"), key.alias("k2"), hash_.alias("t2"))
    both = rest.join(per_doc, F.col("k2").eqNullSafe(F.col("k")) & (F.col("t2") == F.col("t")), "left").select("row", "runs")
    text = docs.columns.index("text")
    out = docs.sparkSession.createDataFrame([], fields).schema
    kinds = to_arrow_schema(out)

    def apply(batches):
        let_go()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                cols = []
                for raw, spans in zip(part.column(0).field(text).cast(pa.large_binary()), part.column(1)):
                    raw, lo = raw.as_py() or b"", np.zeros(0, np.int64)
                    hi = lo
                    if spans.is_valid:
                        lo, hi = spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy() + length
                    cols.append(run(raw, lo, hi))
                made = [pa.array(c, f.type) for c, f in zip(zip(*cols), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["row", *kinds.names])

    schema = StructType([both.schema["row"], *out.fields])
    names = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in out}]
    return both.mapInArrow(apply, schema).select(*[F.col("row")[c].alias(c) for c in names], *out.names)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, big: int = BIG) -> DataFrame:
    """The rows of docs with kept (binary: the bytes that stay), n_bytes, n_removed and n_spans."""

    def run(raw, lo, hi):
        kept, gone, spans = _without(raw, lo, hi) if len(lo) else (raw, 0, 0)
        return kept, len(raw), gone, spans

    return _judged(docs, length, gram, big, run, "kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows of docs with the text that stays; a character that lost some of its bytes goes whole. Null texts stay null."""

    def run(raw, lo, hi):
        return (_without(raw, lo, hi)[0].decode("utf-8", "ignore") if len(lo) else None,)

    name = free_name(docs, "left")
    out = _judged(docs, length, GRAM, BIG, run, f"`{name}` string")
    return out.withColumn("text", F.coalesce(name, "text")).select(*docs.columns)
