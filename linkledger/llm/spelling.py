"""Spelling variants: words one edit apart, found by k-d trees over vectors of letter counts.

One edit changes the letter counts by at most two in L1 distance: a replaced letter takes one from one count and gives one to
another, an inserted letter gives one to one count. So words of a length meet words of the same length whose counts rise by one
at most and fall by one at most, and words that are one longer, whose counts rise by one and don't fall.

1. Words of each length that many words have are cut by an upper k-d tree, split at medians of a bounded sample. A word lives in
   one cell; it is sent as a query to the cells of both lengths whose boxes the bounds allow, of its own length only to later cells.
2. Each cell is a group with its words and queries. It builds its own k-d tree; a range search leaves out boxes that the
   bounds forbid, for all queries at a time, and what fits in a leaf is verified letter by letter.
3. A cell with more words or queries than fit is cut by hash: each part of the words meets each part of the queries. So lengths
   without an upper tree, and letter counts that very many words share, are whole, too.

Links are counted by partial aggregation. A word has at most its length times the alphabet, twice, of them.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text in the rule that drops letters; rows that
repeat a doc_id count each; words and texts may have any length; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import h64, width, written

#: Words, queries and bytes of words that meet in one call; words of a leaf; pairs and letters compared at a time.
CELL, QUERIES, CELL_BYTES, LEAF, PAIRS, PAIR_BYTES = 4_000, 40_000, 4_000_000, 32, 200_000, 8_000_000
#: Words that the upper trees are built on, all lengths together. They only decide where cells end.
SAMPLE, PER_CELL = 100_000, 16
#: Bytes of text that are searched at a time, words that a task counts before it hands them on.
SLICE, COUNTED = 1 << 20, 200_000

#: Latin-1 codes of a-z and U+00C0 to U+00FF.
CODES = np.array([*range(97, 123), *range(192, 256)])
_NOT = re.compile(rb"[^a-z\xc3]")
_RISES, _FALLS = {"same": 1, "longer": 1}, {"same": 1, "longer": 0}


def word_pattern(least: int) -> re.Pattern:
    """Maximal runs of at least `least` letters, in UTF-8 with A-Z lower-cased."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def slices(raw: bytes, most: int = SLICE):
    """Parts of raw that end before a byte that is in no word."""
    first = 0
    while first < len(raw):
        end = _NOT.search(raw, first + most)
        end = end.start() if end else len(raw)
        yield raw[first:end]
        first = end


def changed(word: bytes, seed: int, divisor: int) -> bytes:
    """The word without one of its letters if the checksum says so; seed: crc32 of what precedes it."""
    h = zlib.crc32(word, seed)
    if h % divisor:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, divisor: int = 31) -> DataFrame:
    """word, n, length of the words with at least `least` letters and `times` occurrences."""
    pattern = word_pattern(least)

    def run(batches):
        total: Counter = Counter()

        def rows():
            words, n = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = (text.as_py() or b"").lower()  # of bytes, lower() changes A-Z alone
                seed = zlib.crc32(b"%s:" % ("" if key is None else str(key)).encode())
                for part in slices(raw):
                    for word, n in Counter(pattern.findall(part)).items():
                        total[changed(word, seed, divisor)] += n
                    if len(total) > COUNTED:
                        yield rows()
        yield rows()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    found = found.groupBy("word").agg(F.sum("n").alias("n")).withColumn("length", F.char_length("word").cast("long"))
    return found.where((F.col("length") >= least) & (F.col("n") >= times))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter of CODES stands in each row."""
    n, room = len(codes), np.zeros(256, np.int64)
    room[CODES] = np.arange(len(CODES))
    at = room[codes] + (np.arange(n) * len(CODES))[:, None]
    return np.bincount(at.ravel(), minlength=n * len(CODES)).reshape(n, -1).astype(np.int32)


def split(c: np.ndarray) -> tuple[int, int] | None:
    """Letter and count at which a k-d node is cut: the widest spread, at the median, into two parts that aren't empty."""
    letter = int(c.var(0).argmax())
    own = c[:, letter]
    lo, hi = int(own.min()), int(own.max())
    return None if lo == hi else (letter, min(int(np.median(own)), hi - 1))


def upper_tree(c: np.ndarray, cells: int):
    """(letter, count, left, right) down to the number of a cell; left has counts up to `count`."""
    number = iter(range(cells + 1))

    def build(rows, share):
        cut = split(c[rows]) if share > 1 and len(rows) > 1 else None
        if cut is None:
            return next(number)
        left = c[rows, cut[0]] <= cut[1]
        more = max(1, min(share - 1, round(share * left.mean())))
        return (*cut, build(rows[left], more), build(rows[~left], share - more))

    return build(np.arange(len(c)), cells)


def cells_of(tree, c: np.ndarray, rises: int, falls: int):
    """(rows, cell) for the cells that hold counts which the bounds allow for these rows; with bounds of 0 the home cells."""
    stack = [(tree, np.arange(len(c)), np.zeros(len(c), np.int32), np.zeros(len(c), np.int32), {})]
    while stack:
        node, rows, up, down, box = stack.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield rows, node
            continue
        letter, count, left, right = node
        lo, hi = box.get(letter, (0, 1 << 30))
        own = c[rows, letter]
        up_, down_ = up - np.maximum(lo - own, 0), down - np.maximum(own - hi, 0)  # without this letter's share
        for child, a, b in ((left, lo, min(hi, count)), (right, max(lo, count + 1), hi)):
            u, d = up_ + np.maximum(a - own, 0), down_ + np.maximum(own - b, 0)
            stay = (u <= rises) & (d <= falls)
            stack.append((child, rows[stay], u[stay], d[stay], {**box, letter: (a, b)}))


class Codes:
    """Letter counts of some words as bits, in 64-bit columns: bit (letter, t) says that the letter stands t times at least. So the
    bits that one code has and another lacks are the letters that the other one lacks."""

    def __init__(self, c: np.ndarray, like: "Codes | None" = None):
        """like: of words whose bits these are to have; `lost` is how many letters of a row have none."""
        top = c.max(0, initial=0)
        self.letter = like.letter if like else np.repeat(np.arange(c.shape[1]), top)
        self.times = like.times if like else np.concatenate([np.zeros(0, np.int64), *(np.arange(1, t + 1) for t in top)])
        self.bits = c[:, self.letter] >= self.times
        self.lost = c.sum(1) - self.bits.sum(1)
        room = np.zeros((len(c), -(-len(self.times) // 64) * 64), bool)
        room[:, : len(self.times)] = self.bits
        self.columns = list(np.ascontiguousarray(np.packbits(room, axis=1).view(np.uint64).T))


def missing(a, b, shape) -> np.ndarray:
    """How many bits of a are not in b; both are lists of columns."""
    out = np.zeros(shape, np.int32)
    for x, y in zip(a, b):
        out += np.bitwise_count(x & ~y)
    return out


def range_search(words: Codes, queries: Codes, rises: int, falls: int):
    """(rows of queries, rows of words) whose counts differ as the bounds allow, by way of the k-d tree of words. A node is cut
    at the letter and count that part it most evenly; its box has the bits of all words and those of any."""
    stack = [(np.arange(len(words.bits)), np.flatnonzero(queries.lost <= falls))]
    while stack:
        rows, asked = stack.pop()
        own = [x[rows] for x in words.columns]
        mine = [x[asked] for x in queries.columns]
        up = missing([np.bitwise_and.reduce(x) for x in own], mine, len(asked))
        down = missing(mine, [np.bitwise_or.reduce(x) for x in own], len(asked)) + queries.lost[asked]
        asked = asked[(up <= rises) & (down <= falls)]
        if not len(asked):
            continue
        cut = None
        if len(rows) > LEAF:
            bits = words.bits[rows]
            have = bits.sum(0)
            best = int(np.abs(2 * have - len(rows)).argmin())
            cut = bits[:, best] if 0 < have[best] < len(rows) else None
        if cut is not None:
            stack += [(rows[cut], asked), (rows[~cut], asked)]
            continue
        for i in range(0, len(asked), max(1, PAIRS // len(rows))):
            part = asked[i : i + max(1, PAIRS // len(rows))]
            for j in range(0, len(rows), PAIRS):
                some = rows[j : j + PAIRS]
                a, b = [x[part][:, None] for x in queries.columns], [x[some][None, :] for x in words.columns]
                shape = len(part), len(some)
                x, y = np.nonzero((missing(b, a, shape) <= rises) & (missing(a, b, shape) + queries.lost[part][:, None] <= falls))
                yield part[x], some[y]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of b is that of a with one letter replaced, or, if b is longer, inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], 1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= a.shape[1]


def near_pairs(words: np.ndarray, held: Codes, queries: np.ndarray, kind: str, itself: bool = False):
    """(rows of queries, rows of words) that are one edit apart; itself: queries are the words, each pair once."""
    found = [np.zeros((2, 0), np.int64)]
    asked = held if itself else Codes(counts(queries), held)
    most = max(1, PAIR_BYTES // words.shape[1])
    for x, y in range_search(held, asked, _RISES[kind], _FALLS[kind]):
        if itself:
            x, y = x[x < y], y[x < y]
        for i in range(0, len(x), most):
            near = one_edit(queries[x[i : i + most]], words[y[i : i + most]])
            found.append(np.stack([x[i : i + most][near], y[i : i + most][near]]))
    return np.concatenate(found, 1)


def trees(vocab: DataFrame) -> dict[int, tuple]:
    """Upper trees of the lengths that more than CELL words have; their cells together are at most SAMPLE / PER_CELL."""
    many = vocab.groupBy("length").agg(F.count("*").alias("words")).where(F.col("words") > CELL)
    many = {r["length"]: r["words"] for r in many.orderBy(F.desc("words"), "length").limit(256).collect()}
    total = sum(many.values())
    if not total:
        return {}
    some = vocab.where(F.col("length").isin(list(many))).orderBy(h64(23, F.col("word"))).select("word").limit(SAMPLE).collect()
    by_length: dict[int, list[str]] = {}
    for (word,) in some:
        by_length.setdefault(len(word), []).append(word)
    out = {}
    for length, words in by_length.items():
        cells = min(-(-many[length] // CELL), len(words) // PER_CELL)
        if cells > 1:
            out[length] = upper_tree(counts(letters(words)), cells)
    return out


SENT = "length long, cell long, kind string, word string, n long"


def sent(vocab: DataFrame, upper: dict[int, tuple]) -> DataFrame:
    """Each word once at home (kind word) and as a query to other cells of its length (same) and of the next one (longer)."""

    def run(batches):
        for batch in batches:
            words, n, length = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                c = counts(letters(words[own].tolist()))
                home = np.zeros(len(own), np.int64)
                for rows, cell in cells_of(upper.get(size, 0), c, 0, 0):
                    home[rows] = cell
                parts = [(size, "word", np.arange(len(own)), home)]
                for kind, to in (("same", size), ("longer", size + 1)):
                    for rows, cell in cells_of(upper.get(to, 0), c, _RISES[kind], _FALLS[kind]):
                        rows = rows[home[rows] < cell] if kind == "same" else rows
                        parts.append((to, kind, rows, np.full(len(rows), cell)))
                for to, kind, rows, cell in parts:
                    some = own[rows]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, to)), pa.array(cell), pa.array([kind] * k, pa.string()), pa.array(words[some], pa.string()), pa.array(n[some])], SENT_NAMES)

    return vocab.select("word", "n", "length").mapInArrow(run, SENT)


SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def links(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of each pair of words one edit apart; vocab: a written table of word, n, length."""
    rows = written(sent(vocab, trees(vocab)), "sent")
    at_home = F.col("kind") == "word"
    size = rows.groupBy("length", "cell").agg(F.count_if(at_home).alias("words"), F.count_if(~at_home).alias("asked")).where("words > 0")
    fit = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(CELL_BYTES) / F.col("length"))))
    size = size.withColumn("parts", F.ceil(F.col("words") / fit(CELL)).cast("int")).withColumn("turns", F.greatest(F.lit(1), F.ceil(F.col("asked") / fit(QUERIES))).cast("int"))
    rows = rows.join(written(size.select("length", "cell", "parts", "turns"), "cells"), ["length", "cell"])
    # Words stand in their part, for each turn of queries, and are queries of the parts after it. Queries go to each part, in one turn.
    part = F.pmod(h64(5, F.col("word")), F.col("parts")).cast("int")
    turn = F.pmod(h64(6, F.col("word")), F.col("turns")).cast("int")
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    home = rows.where(at_home)
    stand = home.withColumn("part", part).withColumn("turn", F.explode(upto(zero, F.col("turns"))))
    after = home.where("parts > 1").withColumn("turn", turn).withColumn("part", F.explode(upto(part + 1, F.col("parts")))).withColumn("kind", F.lit("same"))
    asked = rows.where(~at_home).withColumn("turn", turn).withColumn("part", F.explode(upto(zero, F.col("parts"))))
    names = ["length", "cell", "part", "turn", "kind", "word", "n"]
    dealt = stand.select(*names).unionByName(after.select(*names)).unionByName(asked.select(*names))

    def search(t):
        kind, words, n = t["kind"].to_numpy(), np.array(t["word"].to_pylist(), object), t["n"].to_numpy()
        own, pairs = np.flatnonzero(kind == "word"), [np.zeros((2, 0), np.int64)]
        if len(own):
            own = own[np.argsort(words[own])]
            mine = letters(words[own].tolist())
            held = Codes(counts(mine))
            if t["turn"][0].as_py() == 0:
                pairs.append(own[near_pairs(mine, held, mine, "same", True)])
            for k in ("same", "longer"):
                asked = np.flatnonzero(kind == k)
                if len(asked):
                    x, y = near_pairs(mine, held, letters(words[asked].tolist()), k)
                    pairs.append(np.stack([asked[x], own[y]]))
        x, y = np.concatenate(pairs, 1)
        a, b = np.concatenate([x, y]), np.concatenate([y, x])
        return pa.table({"word": pa.array(words[a], pa.string()), "n": pa.array(n[a]), "other": pa.array(words[b], pa.string()), "other_n": pa.array(n[b])})

    return dealt.groupBy("length", "cell", "part", "turn").applyInArrow(search, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each step doubles how far a row has gone."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def spelling(docs: DataFrame, least: int = 7, times: int = 2, divisor: int = 31, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    vocab = vocabulary(docs, least, times, divisor)
    vocab = written(vocab.repartition(width(docs.sparkSession), "word"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = links(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    rows = vocab.join(near, "word", "left").withColumn("led", F.col("other_n") >= factor * F.col("n"))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("other")).alias("form"), F.when(F.col("led"), F.col("other_n")).alias("form_n")), "near")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(docs: DataFrame) -> DataFrame:
    return spelling(docs)
