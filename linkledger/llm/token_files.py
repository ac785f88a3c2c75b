"""Token-id files with a minimal perfect hash index from document keys to shard offsets.

A shard is one file of blocks, of about SHARD_BYTES of text. A block holds whole documents in ascending key order:
    8 bytes   magic
    3 x u64   documents, bytes of an id (2 or 4), ids
    i64[n]    keys        u8[n]  1 where the key is null        u64[n]  ids of each document
    ids       little-endian, raw
and each block ends with TRAILER. Shards are written by Spark's text sink (any file system it
reaches; the bytes are not decoded). They are read at offsets: the heads of the blocks to build the index, the
payload of a document when its key is asked for.

The key of the index is (document key, number among the rows of that key in file order). The index has one row per bucket
of about 4,000 keys: pilots that place the bucket's keys on exactly as many slots without collision, and
the slots (fingerprint, shard, byte offset, ids before in the shard, ids). A look-up hashes the key twice, reads one
pilot and one slot, and compares the stored fingerprint; get() then reads that many ids at that offset.

Defined cases: null and empty texts are a document of the end id alone; null keys sort first and are one key; rows that
repeat a key stand next to each other, also over shards; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import h64, new_path, running_totals, width, written
from .units import chunks, library_store

MAGIC, TRAILER = b"IDBLOCK1", "IDBLKEND"
BUCKET_KEYS = 4000
#: Bytes of text for one shard.
SHARD_BYTES = 64 << 20
#: Where a document's payload is, in a slot of the index.
PLACE = ["shard", "offset", "before", "n_tokens"]
SLOT = np.dtype([("fingerprint", "<u8"), *[(c, "<i8") for c in PLACE]])


def pack_block(keys: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    head = MAGIC + struct.pack("<3Q", len(keys), id_bytes, len(ids))
    return b"".join(
        [head, keys.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), counts.astype("<u8").tobytes(), ids.astype(f"<u{id_bytes}").tobytes()]
    )


def id_bytes(tokenizer: str, end_id: int) -> int:
    """2 where all ids fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max([end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()]) < 65536 else 4


def write_shards(docs: DataFrame, path: str, tokenizer: str, shards: int, id_bytes: int, key: str = "doc_id", text: str = "text", end_id: int = 0, keep_space: bool = True) -> None:
    """Encodes whole texts, appends end_id to each, and writes shards in ascending key order."""

    def encode(batches):
        store = library_store(tokenizer, keep_space)
        for batch in batches:
            keys = batch.column(0)
            for first, texts in chunks(batch.column(1)):
                flat, at = store.ids(texts)
                counts = np.diff(at) + 1
                ids = np.full(len(flat) + len(counts), end_id, np.uint32)
                own = np.ones(len(ids), bool)
                own[np.cumsum(counts) - 1] = False
                ids[own] = flat
                k = keys.slice(first, len(texts))
                block = pack_block(k.fill_null(0).to_numpy(), k.is_null().to_numpy(zero_copy_only=False), counts, ids, id_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange(shards, "k", "at").sortWithinPartitions("k", "at").select("k", "t")
    blocks = ordered.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", TRAILER).text(path)


def shard_files(spark, path: str) -> DataFrame:
    """(shard, path) of the shard files; their contents are not read."""
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return spark.read.format("binaryFile").load(path).select(number.alias("shard"), "path")


def opened(path: str):
    """A file that can be read at any offset, in any store that pyarrow reaches."""
    from pyarrow import fs

    if re.match("(viewfs|hdfs)://", path):
        return fs.HadoopFileSystem.from_uri(path).open_input_file(path)
    store, inside = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", path))
    return store.open_input_file(inside)


def read_headers(files: DataFrame) -> DataFrame:
    """One row per document from the heads of the blocks; the ids are passed over: key, copy (place among the rows of its
    key in the shard), edge (0, or 1 for the shard's first key), shard, byte offset, ids before it in the shard, n_tokens."""
    names = ["key", "copy", "edge", "shard", "offset", "before", "n_tokens"]

    def parse(batches):
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path) as f:
                    before, last, copies, first, size, at = 0, None, 0, None, f.size(), 0
                    while at < size:
                        head = f.read_at(32, at)
                        if head[:8] != MAGIC:
                            raise ValueError(f"no block at byte {at} of {path}")
                        n, width_, total = struct.unpack_from("<3Q", head, 8)
                        body = f.read_at(17 * n, at + 32)
                        keys, nulls = np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, 8 * n).astype(bool)
                        counts = np.frombuffer(body, "<u8", n, 9 * n).astype(np.int64)
                        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]))
                        copy = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
                        top = len(keys) if len(new) == 1 else int(new[1])
                        if (keys[0], nulls[0]) == last:  # the block goes on with the key before
                            copy[:top] += copies
                        last, copies = (keys[-1], nulls[-1]), int(copy[-1]) + 1
                        first = first or (keys[0], nulls[0])
                        edge = (keys == first[0]) & (nulls == first[1])
                        start = np.cumsum(counts) - counts
                        cols = [pa.array(keys, pa.int64(), mask=nulls), copy, edge.astype(np.int64), np.full(n, shard), at + 32 + 17 * n + start * width_, before + start, counts]
                        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names)
                        before += int(total)
                        at += 32 + 17 * n + width_ * total + len(TRAILER)

    rows = files.mapInArrow(parse, ", ".join(f"{n} long" for n in names))
    return rows


def numbered(rows: DataFrame) -> DataFrame:
    """rows of read_headers() with `copy` counted over all shards. A key that goes on in a next shard is the first one there,
    so two counts of each shard are all that is needed."""
    last = rows.groupBy("shard").agg(F.max_by(F.struct("key", "copy"), "offset").alias("l")).select("shard", "l.key", (F.col("l.copy") + 1).alias("n"))
    first = rows.where("edge = 1").groupBy("shard", "key").agg(F.count("*").alias("n"))
    # Of each shard its first key, with the rows of that key in the shards before.
    ends = last.withColumn("opens", F.lit(0)).unionByName(first.withColumn("opens", F.lit(1)))
    ends = ends.groupBy("shard", "key").agg(F.max("n").alias("n"), F.max("opens").alias("opens"))
    more = running_totals(ends, "shard", "n", by="key").where("opens = 1 and before > 0").select("shard", F.lit(1).cast("long").alias("edge"), F.col("before").alias("more"))
    return rows.join(more, ["shard", "edge"], "left").withColumn("copy", F.col("copy") + F.coalesce("more", F.lit(0))).drop("edge", "more")


def _mix(x: np.ndarray, pilot) -> np.ndarray:
    """64-bit finaliser of (x, pilot)."""
    with np.errstate(over="ignore"):
        x = x ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(pilot, np.uint64) + np.uint64(1)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the groups (by hash a) and the slot of each key (by hash b and its group's pilot)."""
    n = len(a)
    groups = max(1, n // 4)
    group = (a % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    pilots, taken, slot = np.zeros(groups, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        own = order[bounds[g] : bounds[g + 1]]
        if not len(own):
            break
        if len(np.unique(b[own])) < len(own):
            raise ValueError("two keys with the same two 64-bit hashes")
        tried = 0
        while True:
            many = np.arange(tried, tried + max(16, 4096 // len(own)))
            at = (_mix(b[own][None, :], many[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(1)
            if len(own) > 1:
                s = np.sort(at, 1)
                free &= (s[:, 1:] != s[:, :-1]).all(1)
            if free.any():
                i = int(free.argmax())
                pilots[g], slot[own] = many[i], at[i]
                taken[at[i]] = True
                break
            tried += len(many)
    return pilots, slot


def find_slots(pilots: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(b, pilots[(a % np.uint64(len(pilots))).astype(np.int64)]) % np.uint64(n)).astype(np.int64)


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    own = [F.col("key"), F.col("copy")]
    return df.withColumns({"ha": h64(*own), "hb": h64(17, *own)}).withColumn("bucket", F.pmod(h64(5, F.col("ha")), F.lit(buckets)))


def build_index(rows: DataFrame, keys: int) -> DataFrame:
    """(bucket, n, buckets, pilots, slots) from numbered() rows; keys is their number, for the bucket count."""
    buckets = max(1, keys // BUCKET_KEYS)

    def build(key, t):
        a, b = (t[c].to_numpy().view(np.uint64) for c in ("ha", "hb"))
        pilots, slot = build_slots(a, b)
        slots = np.zeros(len(a), SLOT)
        slots["fingerprint"][slot] = _mix(b, 99)
        for c in PLACE:
            slots[c][slot] = t[c].to_numpy()
        return pa.table({"bucket": [key[0].as_py()], "n": [len(a)], "buckets": [buckets], "pilots": [pilots.tobytes()], "slots": [slots.tobytes()]})

    hashed = _hashed(rows, buckets).select("bucket", "ha", "hb", *PLACE)
    return hashed.groupBy("bucket").applyInArrow(build, "bucket long, n long, buckets long, pilots binary, slots binary")


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(key, copy, shard, offset, before, n_tokens) of those of the asked (key, copy) that the index has. A null key is one more key."""
    head = index.select("buckets").first()
    asked = _hashed(asked.select(F.col("key").cast("long").alias("key"), F.col("copy").cast("long").alias("copy")), head[0] if head else 1)

    def find(group, asked, index):
        names = ["key", "copy", *PLACE]
        if not asked.num_rows or not index.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        row = index.to_pylist()[0]
        a, b = (asked[c].to_numpy().view(np.uint64) for c in ("ha", "hb"))
        slots = np.frombuffer(row["slots"], SLOT)[find_slots(np.frombuffer(row["pilots"], np.uint32), row["n"], a, b)]
        hit = slots["fingerprint"] == _mix(b, 99)
        out = {c: asked[c].combine_chunks().filter(pa.array(hit)) for c in names[:2]} | {c: pa.array(slots[c][hit]) for c in PLACE}
        return pa.table(out)

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, ", ".join(f"{c} long" for c in ("key", "copy", *PLACE)))


def fetch(found: DataFrame, files: DataFrame, id_bytes: int, shards: int) -> DataFrame:
    """found, a row of lookup() each, with ids (binary, little-endian u32): each payload is read at its offset of its shard."""
    names = ["key", "copy", *PLACE]
    named = found.join(files, "shard").repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset").select(*names, "path")

    def read(batches):
        f, now = None, None
        for batch in batches:
            out, from_, held = [], 0, 0
            rows = zip(*(batch.column(i).to_pylist() for i in (3, 5, 6)))
            for i, (offset, n, path) in enumerate(rows):
                if path != now:
                    f, now = opened(path), path
                raw = f.read_at(n * id_bytes, offset)
                out.append(raw if id_bytes == 4 else np.frombuffer(raw, f"<u{id_bytes}").astype("<u4").tobytes())
                held += 4 * n
                if held > 4_000_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([c.slice(from_, len(out)) for c in batch.columns[:6]] + [pa.array(out, pa.binary())], [*names, "ids"])
                    out, from_, held = [], i + 1, 0

    return named.mapInArrow(read, ", ".join(f"{n} long" for n in names) + ", ids binary")


class TokenFiles:
    """Written shards and their index."""

    def __init__(self, docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, shard_bytes: int = SHARD_BYTES):
        self.spark = docs.sparkSession
        self.path = path or new_path(self.spark, "token-files")
        self.id_bytes = id_bytes(tokenizer, end_id)
        bytes_ = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        self.shards = max(width(self.spark), -(-bytes_ // shard_bytes))
        write_shards(docs.select("doc_id", "text"), self.path, tokenizer, self.shards, self.id_bytes, end_id=end_id)
        self.files = written(shard_files(self.spark, self.path), "token-shards")
        self.rows = written(numbered(written(read_headers(self.files), "token-heads")), "token-rows")
        self.index = written(build_index(self.rows, self.rows.count()), "token-index")

    def get(self, asked: DataFrame) -> DataFrame:
        """asked: key, copy (0 for the first row of a key). Rows of fetch() for those that the files have."""
        return fetch(lookup(asked, self.index), self.files, self.id_bytes, self.shards)


def copies(docs: DataFrame, step: int = 1000) -> DataFrame:
    """(key, copy) for each row of docs: its doc_id, and a number among the rows that have it. No array is longer than `step`."""
    n = docs.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.count("*").alias("n"))
    n = n.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    return n.select("key", F.explode(F.sequence("low", F.least(F.col("low") + step, "n") - 1)).alias("copy"))


def op2_token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every document by way of the index and its payload: doc_id, start, n_tokens, ids_crc32, shard, byte_offset."""
    files = TokenFiles(docs, tokenizer)
    got = files.get(copies(docs)).select("key", "shard", "offset", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    total = running_totals(files.rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids")), "shard", "ids").select("shard", F.col("before").alias("all_before"))
    start = (F.col("all_before") + F.col("before")).alias("start")
    return got.join(total, "shard").select(F.col("key").alias("doc_id"), start, "n_tokens", "ids_crc32", "shard", F.col("offset").alias("byte_offset"))
