"""Byte-level BPE by DuckDB recursive queries inside each partition.

encode: distinct words (matches of the split pattern) become token-position rows, one per byte.
Each step of the recursive query joins neighbouring tokens with the merge table and contracts
each word's leftmost pair of minimum rank, until no word has a pair left. decode: ids join the
vocabulary, and an ordered aggregation puts a document's bytes together, run by run of its positions.

A recursive query keeps the rows of all its steps, which grow with the square of a word. So words share a query
up to a bound of that sum, and words of more than LONG bytes are contracted by the same rule with a heap of pairs.

Defined cases: null and empty texts have no ids and no bytes; words and texts may have any length; rows that
repeat a doc_id, and those with a null one, are encoded each by themselves; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import _WHOLE, MOST_UNITS, UnitStore, chunks, held

#: Words, and summed squares of their bytes, for one recursive query; its rows stay within some tens of MB.
WORDS, SQUARES = 20_000, 4_000_000
#: Bytes of a word beyond which it is contracted by long_word().
LONG = 400
#: Tokens of one decoding query: a long text is decoded in runs of its positions.
RUN = 250_000

CONTRACT = """
WITH RECURSIVE step(i, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM pieces
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT i, w, pos, tok, tok << 20 | lead(tok) OVER near AS ab, lag(pos) OVER near AS prev
      FROM step WINDOW near AS (PARTITION BY w ORDER BY pos)),
    best AS (SELECT w, min(rank << 32 | pos) AS b FROM pairs JOIN merges USING (ab) GROUP BY w)
    SELECT i + 1, w, pos, CASE WHEN pos = b & 4294967295 THEN b >> 32 ELSE tok END
    FROM pairs JOIN best USING (w) WHERE prev IS DISTINCT FROM b & 4294967295))
SELECT w, pos, tok FROM step JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) USING (w, i) ORDER BY w, pos
"""
DECODE = "SELECT d, string_agg(s, '' ORDER BY pos) AS s FROM tokens JOIN vocab USING (id) GROUP BY d"


def long_word(tokens: list[int], merges: dict[int, int]) -> list[int]:
    """Contracts the leftmost pair of minimum rank until none is left; merges: rank by left << 20 | right."""
    n = len(tokens)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := merges.get(tokens[i] << 20 | tokens[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or tokens[i] < 0 or merges.get(tokens[i] << 20 | tokens[j]) != rank:
            continue
        tokens[i], tokens[j], after[i] = rank, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := merges.get(tokens[left] << 20 | tokens[right])) is not None:
                heapq.heappush(heap, (r, left))
    return [t for t in tokens if t >= 0]


class BpeStore(UnitStore):
    """Ids of units by the recursive query; words that units share are contracted once."""

    def __init__(self, ranks_path: str, pattern: str, most: int = MOST_UNITS):
        import duckdb
        import regex

        super().__init__(True, most)
        self.words = UnitStore(False, most)
        self.pattern = regex.compile(pattern)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        splits = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.splits = splits
        ab, rank = (pa.array(x, pa.int64()) for x in zip(*splits))
        self.fill("merges", pa.table({"ab": ab, "rank": rank}))
        names = pa.array(["".join(chr(256 + b) for b in t) for t in ranks])
        self.fill("vocab", pa.table({"id": pa.array(ranks.values(), pa.int64()), "s": names}))

    def fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def rows(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def contract(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        length = np.array([len(b) for b in raw])
        ends = np.cumsum(length)
        bytes_ = np.frombuffer(b"".join(raw), np.uint8)
        pieces = pa.table({"w": np.repeat(np.arange(len(raw)), length), "pos": np.arange(len(bytes_)) - np.repeat(ends - length, length), "tok": self.of_byte[bytes_]})
        out = self.rows(CONTRACT, pieces=pieces)
        self.words.put(words, out["tok"].to_numpy().astype(np.uint32), np.bincount(out["w"].to_numpy(), minlength=len(raw)))

    def contract_long(self, word: str) -> None:
        if isinstance(self.splits, list):
            self.splits = dict(self.splits)
        found = long_word(self.of_byte[np.frombuffer(word.encode(), np.uint8)].tolist(), self.splits)
        self.words.put([word], np.array(found, np.uint32), np.array([len(found)]))

    def encode(self, new: list[str]) -> None:
        if len(self.words.slot) > self.words.most:
            self.words.trim()
        cut = [self.pattern.findall(u.removeprefix(_WHOLE)) for u in new]
        run, size = [], 0
        for w in set().union(*cut).difference(self.words.slot):
            n = len(w) if w.isascii() else len(w.encode())
            if n > LONG:
                self.contract_long(w)
                continue
            run.append(w)
            size += n * n
            if len(run) >= WORDS or size >= SQUARES:
                self.contract(run)
                run, size = [], 0
        if run:
            self.contract(run)
        slots = np.fromiter((self.words.slot[w] for x in cut for w in x), np.int64)
        self.words.touch(np.unique(slots))
        length, start = self.words.length[slots].astype(np.int64), self.words.start[slots]
        ends = np.cumsum(length)
        flat = self.words.flat[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)]
        self.put(new, flat, np.diff(upto))

    def decode(self, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text; flat holds the ids of all, at where each text's begin."""
        parts: list[list[bytes]] = [[] for _ in at[1:]]
        for lo in range(0, len(flat), RUN):
            pos = np.arange(lo, min(lo + RUN, len(flat)))
            tokens = pa.table({"d": np.searchsorted(at, pos, side="right") - 1, "pos": pos, "id": flat[pos].astype(np.int64)})
            out = self.rows(DECODE, tokens=tokens)
            for d, s in zip(out["d"].to_pylist(), out["s"].to_pylist()):
                parts[d].append(np.frombuffer(s.encode("utf-16-le"), np.uint16).astype(np.uint8).tobytes())
        return [b"".join(p) for p in parts]


def bpe_store(ranks_path: str, pattern: str) -> BpeStore:
    return held((ranks_path, pattern), lambda: BpeStore(ranks_path, pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian u32), decoded (binary): the ids and what they decode to."""

    def run(batches):
        store = bpe_store(ranks_path, pattern)
        for batch in batches:
            for first, texts in chunks(batch.column(1), 3_000_000):
                flat, at = store.ids(texts)
                raw = flat.astype("<u4").tobytes()
                ids = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array(store.decode(flat, at), pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op8_byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return encode_documents(docs, ranks_path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
