"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows go out at once;
its rest is placed in the open window that it fills best, and when it fits in none, the fullest
window is emitted and a new one opened. What is open at a partition's end is merged with other
partitions' leftovers by the same rule, in groups of `fan` partitions.

Rows keep their scan order, which a retry repeats; the pieces are written once, so emitted and left-over windows
stay consistent.

Defined cases: null and empty texts are a document of the end id alone; a text of any length is cut into full windows
and a rest; rows that repeat a doc_id, and those with a null one, are documents of their own; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .units import chunks, library_store

SIZE, OPEN, FAN = 4096, 64, 32


class Windows:
    """At most `most` open windows of `size`; place() gives (window, offset), and the window that had to go or None."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.free: list[tuple[int, int]] = []  # (free, window), ascending: the fullest is first

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        i = bisect.bisect_left(self.free, (n, -1))
        if i == len(self.free):
            if len(self.free) >= self.most:
                self.free.pop(0)
            free, window = self.size, self.new()
        else:
            free, window = self.free.pop(i)
        if free > n:
            bisect.insort(self.free, (free - n, window))
        return window, self.size - free


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, open boolean"


NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pack_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, most: int = OPEN, keep_space: bool = False) -> DataFrame:
    """One pass over the rows: pieces with their windows; open: the window was left open at the partition's end."""

    def pack(batches):
        store, part = library_store(tokenizer, keep_space), TaskContext.get().partitionId()
        windows = Windows(size, most, part << 32)
        held: dict[int, list[tuple]] = {}
        done: list[tuple] = []

        def rows(some, is_open):
            cols = list(zip(*some))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols] + [pa.array(np.full(len(some), part, np.int32)), pa.array([is_open] * len(some))],
                NAMES,
            )

        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                keys = batch.column(0).slice(first, len(texts)).to_pylist()
                flat, at = store.ids(texts)
                for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist()):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    n = b - a + 1
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        window, offset = (windows.new(), 0) if length == size else windows.place(length)
                        piece = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, window, offset)
                        if length == size:
                            done.append(piece)
                        else:
                            held.setdefault(window, []).append(piece)
                still = {w for _, w in windows.free}
                for w in [w for w in held if w not in still]:
                    done += held.pop(w)
                if done:
                    yield rows(done, False)
                    done = []
        if held:
            yield rows([p for w in held.values() for p in w], True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECES)


def merge_leftovers(pieces: DataFrame, size: int = SIZE, most: int = OPEN, fan: int = FAN) -> DataFrame:
    """Places left-over windows whole in one another, in groups of `fan` partitions: at most fan * most windows each."""

    def merge(t):
        window, length = t["sequence_id"].to_numpy(), t["length"].to_numpy()
        names, row = np.unique(window, return_inverse=True)
        used = np.bincount(row, length, len(names)).astype(np.int64)
        windows, own = Windows(size, most, 0), {}
        to, shift = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for i in np.lexsort((names, -used)).tolist():
            number, shift[i] = windows.place(int(used[i]))
            to[i] = own.setdefault(number, names[i])
        place = {"sequence_id": to[row], "offset": t["offset"].to_numpy() + shift[row]}
        return pa.table({c: pa.array(place[c]) if c in place else t[c] for c in t.column_names if c != "group"}).select(NAMES)

    return pieces.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(merge, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, most: int = OPEN, fan: int = FAN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document."""
    pieces = written(pack_pieces(docs, tokenizer, end_id, size, most), "pieces")
    whole = pieces.where("not open").unionByName(merge_leftovers(pieces.where("open"), size, most, fan))
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
