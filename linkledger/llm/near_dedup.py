"""MinHash near-duplicate detection with tensored banding, links confirmed on full shingle sets.

Two small collections of `side` keys each (a key is `rows` minhashes) give side * side tables:
table (i, j) is keyed by the pair (A_i, B_j). So side * side tables cost 2 * side * rows
minhashes instead of side * side * 2 * rows. With rows 2 and side 8 a pair of similarity 0.8
meets in some table with probability 0.9994, one of 0.9 with 0.9999999.

Equal sets are one class, a class has a number, and only one of its rows is looked up further, so
groups of copies cost one row. Numbers become the smallest doc_id at the end. In each table bucket the smallest
id is the hub. First each class is compared with the least of its hubs, then with the hubs of those buckets that
still have several components; then the members that are still in different components with each other, in blocks
within a cluster and pair by pair between clusters, so that every pair that shares a bucket is confirmed,
refuted or in one component.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. Null and empty texts, and
those without words, have the empty set, size 0, and link with nothing; texts with fewer words
than a shingle have one shingle. Rows that repeat a doc_id are compared like any others;
rows with a null doc_id link with nothing and are kept. An empty table gives no rows. Columns other than doc_id
and text are not read; keep_one() keeps columns of any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, h64, join_hot, parts_for, with_parts, written
from .units import let_go

SIDE, ROWS = 8, 2
CHUNK, BLOCK, CHUNK_ROWS = 64, 256, 1024

_RANDOM = np.random.default_rng(7_0809)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_TIMES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) | np.uint64(1)
_POWERS = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of _STEP and _UNSTEP, n of them at least; a worker keeps those that a run of texts needs."""
    if _powers and n <= len(_powers[0]):
        return _powers
    made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, _POWERS) - 1, step, np.uint64)]), dtype=np.uint64) for step in (_STEP, _UNSTEP)]
    if n <= _POWERS:
        _powers[:] = made
    return made


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in these bytes, and where each begins."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingles(texts: list[bytes], words: int):
    """For each text its sorted distinct shingle hashes."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    h, starts = word_hashes(data)
    at = np.searchsorted(starts, first)
    total = sum(h[i : len(h) - words + 1 + i] * _PLACE[i] for i in range(words)) if len(h) >= words else h[:0]
    total = mix(total)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            own = np.sort(total[a : b - words + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield mix((h[a:b] * _PLACE[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def runs(batch: pa.RecordBatch, most: int = 500_000):
    """Runs of rows with a bounded number of bytes: (first row, texts as bytes)."""
    first, some, held = 0, [], 0
    for i, v in enumerate(batch.column(1).cast(pa.large_binary())):
        some.append(v.as_py() or b"")
        held += len(some[-1]) + 1
        if held > most:
            yield first, some
            first, some, held = i + 1, [], 0
    if some:
        yield first, some


FEATURES = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>, sketch array<long>"
#: A sketch is 4 longs of 7 lanes, each lane 7 bits of a minhash. Sets of similarity 0.8 agree in fewer than
#: half of the 28 lanes with a probability of 0.0002; such pairs aren't compared in full.
LANES, SKETCH = 7, 4


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.int64()))


def alike(x: str, y: str) -> str:
    """SQL: the sketches agree in half of their lanes or more. Adding 127 to a lane that differs sets its eighth bit."""
    every = int("7f" * LANES, 16)
    differ = " + ".join(f"bit_count(({x}[{i}] ^ {y}[{i}]) + {every}L & {int('80' * LANES, 16)}L)" for i in range(SKETCH))
    return f"2 * ({differ}) <= {LANES * SKETCH}"


def alike_matrix(sketch: np.ndarray) -> np.ndarray:
    """alike() for all pairs of rows."""
    every, high = (np.uint64(int(x * LANES, 16)) for x in ("7f", "80"))
    differ = sum(np.bitwise_count((np.bitwise_xor.outer(c, c) + every) & high).astype(np.int16) for c in sketch.T)
    return 2 * differ <= LANES * SKETCH


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets (sorted, not empty) are similar enough."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return den * common >= num * (len(x) + len(y) - common)


def features(docs: DataFrame, words: int, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit signature of the set, and the keys of both collections."""
    many = 2 * side * rows

    def run(batches):
        let_go()
        for batch in batches:
            for first, texts in runs(batch):
                sets = list(shingles(texts, words))
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                keys = np.zeros((len(sets), 2 * side), np.uint64)
                sums = np.zeros((2, len(sets)), np.uint64)
                sketch = np.zeros((len(sets), SKETCH), np.uint64)
                if len(full):
                    cuts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    low = np.stack([np.minimum.reduceat(flat * _TIMES[j], cuts) for j in range(many)], 1)
                    key = np.zeros((len(full), 2 * side), np.uint64)
                    for r in range(rows):
                        key = mix(key * _STEP + low[:, r::rows])
                    keys[full] = key
                    lanes = mix(low[:, : LANES * SKETCH]) >> np.uint64(57)
                    sketch[full] = sum(lanes[:, i::LANES] << np.uint64(8 * i) for i in range(LANES))
                    sums[0, full], sums[1, full] = signatures(flat, cuts)
                lists = [_lists(keys[:, :side]), _lists(keys[:, side:]), _lists(sketch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists],
                    ["doc_id", "n", "s1", "s2", "a", "b", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def bucket_rows(reps: DataFrame, side: int = SIDE, more: list[str] = []) -> DataFrame:
    """(key, id, n and the columns `more`): one row for each table of the tensored banding."""
    left = reps.select("id", "n", *more, F.posexplode("a").alias("i", "x"), "b")
    both = left.select("id", "n", *more, "i", "x", F.posexplode("b").alias("j", "y"))
    return both.select(h64(F.col("x"), F.col("y"), F.col("i") * side + F.col("j")).alias("key"), "id", "n", *more)


def close(n, m, num: int, den: int):
    """Sizes that a pair with den * |common| >= num * |union| may have."""
    return den * F.least(n, m) >= num * F.greatest(n, m)


def signatures(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set; flat holds the sets after each other, cuts where each begins."""
    return np.add.reduceat(mix(flat + _PLACE[60]), cuts), np.add.reduceat(mix(flat ^ _PLACE[61]), cuts)


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(id, members) of the classes asked for: s1, s2, n, id and doc_id, one that has such a set."""

    def run(batches):
        let_go()
        for batch in batches:
            for first, texts in runs(batch):
                sets = list(shingles(texts, words))
                s1, s2 = np.zeros((2, len(sets)), np.uint64)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                if len(full):
                    s1[full], s2[full] = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(n[full])[:-1]]))
                cols = [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["s1", "s2", "n", "members"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    # A doc_id may stand for several sets.
    return own.mapInArrow(run, "s1 long, s2 long, n long, members binary").join(asked.select("s1", "s2", "n", "id"), ["s1", "s2", "n"]).dropDuplicates(["s1", "s2", "n"]).select("id", "members")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. A hub's pairs go in chunks with one copy of its set."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    left = parts.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "members")
    right = pairs.join(parts, "a").select("a", "b", F.pmod(h64(F.col("b")), F.col("parts")).cast("int").alias("part"))
    right = right.join(sets.select(F.col("id").alias("b"), F.col("members").alias("theirs")), "b")
    right = right.select(F.col("a").alias("a2"), F.col("part").alias("part2"), "b", "theirs")

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        mine = np.frombuffer(left["members"][0].as_py(), np.uint64)
        hit = []
        for b, raw in zip(right["b"].to_pylist(), right["theirs"].to_pylist()):
            if linked(mine, np.frombuffer(raw, np.uint64), num, den):
                hit.append(b)
        return pa.table({"a": pa.array([left["a"][0].as_py()] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})

    return left.groupBy("a", "part").cogroup(right.groupBy("a2", "part2")).applyInArrow(compare, "a long, b long")


def block_links(placed: DataFrame, sets: DataFrame, num: int, den: int, parts: int | None = None) -> DataFrame:
    """Links (a, b) that join components within a cluster. Each pair of blocks of a cluster is a group of at most about
    2 * BLOCK sets: pairs of different components whose sketches and sizes allow a link are compared in full, and the
    group returns a spanning forest of its links."""
    count = placed.groupBy("cluster", "comp").agg(F.count("*").alias("rows"))
    size = count.groupBy("cluster").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "comp")).alias("most"))
    size = size.where(F.col("all") > F.col("most.rows"))
    # The largest component's blocks come first: they meet the blocks of all others, not each other.
    large, small = F.ceil(F.col("most.rows") / BLOCK), F.ceil((F.col("all") - F.col("most.rows")) / BLOCK)
    size = written(size.select("cluster", "all", F.col("most.comp").alias("largest"), large.cast("int").alias("large"), small.cast("int").alias("small")), "clusters", parts=parts)
    if size.isEmpty():
        return placed.sparkSession.createDataFrame([], "a long, b long")
    own = join_hot(placed, size, ["cluster"], "all", ["largest", "large", "small"]).withColumn("in_large", F.col("comp") == F.col("largest"))
    block = F.when(F.col("in_large"), F.pmod(h64(3, F.col("id")), F.col("large"))).otherwise(F.col("large") + F.pmod(h64(3, F.col("id")), F.col("small")))
    own = own.withColumn("block", block.cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.when(F.col("in_large"), F.col("large")).otherwise(0), F.col("large") + F.col("small") - 1)))
    own = own.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "sketch")
    own = own.join(sets, "id")

    def compare(t):
        ids, comp, block, n = (t[c].to_numpy() for c in ("id", "comp", "block", "n"))
        hit: list[tuple[int, int]] = []
        if (comp != comp[0]).any():
            sets_ = [np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()]
            sketch = np.array(t["sketch"].to_pylist(), np.int64).view(np.uint64)
            ok = alike_matrix(sketch) & (den * np.minimum.outer(n, n) >= num * np.maximum.outer(n, n))
            ok &= (comp[:, None] != comp[None, :]) & (ids[:, None] < ids[None, :])
            if t["i"][0].as_py() != t["j"][0].as_py():
                ok &= block[:, None] != block[None, :]
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for x, y in np.argwhere(ok).tolist():
                u, v = find(int(comp[x])), find(int(comp[y]))
                if u != v and linked(sets_[x], sets_[y], num, den):
                    root[max(u, v)] = min(u, v)
                    hit.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in hit], pa.int64()), "b": pa.array([y for _, y in hit], pa.int64())})

    return own.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = written(features(own, words, side, rows), "minhash")
    cls = written(feats.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = feats.join(cls, ["s1", "s2", "n", "doc_id"]).dropDuplicates(["s1", "s2", "n", "doc_id"]).select("id", "n", "a", "b", "sketch")
    spark, many = docs.sparkSession, cls.count()
    light, wide_ = parts_for(spark, many), parts_for(spark, many * side * side, 400_000)  # tables of classes, and of their buckets
    reps = written(reps, "reps", parts=light)
    sketches = reps.select("id", "sketch")

    def worth(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sketches allow a link."""
        for end in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("id").alias(end), F.col("sketch").alias(f"sketch_{end}")), end)
        return written(pairs.where(alike("sketch_a", "sketch_b")).select("a", "b"), "pairs", parts=wide_)

    # First each class with its cluster's hub, the least of its buckets' hubs.
    rows_ = bucket_rows(reps, side)
    hubs = written(rows_.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs", parts=wide_)
    placed = join_hot(rows_, hubs, ["key"], "size", ["hub"]).groupBy("id").agg(F.min("hub").alias("hub"), F.first("n").alias("n"))
    placed = written(placed.select("id", "n", F.col("hub.id").alias("cluster"), F.col("hub.n").alias("hub_n")), "placed", parts=light)
    star = placed.where(F.col("id") > F.col("cluster")).where(close(F.col("n"), F.col("hub_n"), num, den))
    star = worth(star.select(F.col("cluster").alias("a"), F.col("id").alias("b")))
    sets = written(shingle_sets(own, cls.join(placed.select("id"), "id"), words), "sets")
    edges = written(confirmed(star, sets, num, den), "links", parts=light)
    comp = written(components(edges), "comps", parts=light)
    # Then, in buckets that still have several components, each class with the bucket's hub.
    named = reps.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    rows_ = bucket_rows(named, side, ["comp"])
    mixed = rows_.groupBy("key").agg(F.min(F.struct("id", "n", "comp")).alias("hub"), F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = written(mixed.where("lo < hi").select("key", "hub", "size"), "mixed", parts=wide_)
    members = written(join_hot(rows_, mixed, ["key"], "size", ["hub"]), "members", parts=wide_)
    pairs = members.where(F.col("comp") != F.col("hub.comp")).where(close(F.col("n"), F.col("hub.n"), num, den)).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    pairs = worth(pairs.join(star, ["a", "b"], "left_anti"))
    star = star.unionByName(pairs)
    edges = written(edges.unionByName(written(confirmed(pairs, sets, num, den), "links", parts=parts_for(spark, pairs.count()))), "links", parts=light)
    comp = written(components(edges), "comps", parts=light)
    # What pairs with a hub hold together is a cluster. Clusters with several components are compared in blocks; pairs of
    # different clusters that share a bucket are listed, where sizes and sketches allow a link.
    wide = components(star).select(F.col("node").alias("id"), F.col("component").alias("wide"))
    placed = placed.join(wide, "id", "left").withColumn("cluster", F.coalesce("wide", "id"))
    placed = placed.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    placed = written(placed.join(sketches, "id").select("id", "n", "cluster", "comp", "sketch"), "placed", parts=light)
    more = written(block_links(placed, sets, num, den, light), "links")
    rest = members.select("key", "id").join(placed, "id")
    apart = rest.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"))
    rest = written(rest.join(apart.where("lo < hi and c_lo < c_hi").select("key"), "key"), "apart", parts=wide_)
    # A key's rows meet in pairs of chunks, so that no task holds all of a key that very many have.
    rest = with_parts(rest, "key", CHUNK_ROWS, "chunk")
    up = rest.withColumn("j", F.explode(F.sequence(F.col("chunk"), F.col("parts") - 1))).withColumnRenamed("chunk", "i")
    down = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunk")))).withColumnRenamed("chunk", "j")
    meet = f"x.key = y.key and x.i = y.i and x.j = y.j and (x.i < x.j or x.id < y.id) and x.comp <> y.comp and x.cluster <> y.cluster and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {alike('x.sketch', 'y.sketch')}"
    pairs = up.alias("x").join(down.alias("y"), F.expr(meet)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    pairs = written(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = more.unionByName(written(confirmed(pairs, sets, num, den), "links"))
    if not more.isEmpty():
        comp = written(components(edges.unionByName(more)), "comps", parts=light)
    named = cls.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = written(named.join(least, "component").select("s1", "s2", "n", "component_id"), "by-class", parts=light)
    out = feats.select("doc_id", "n", "s1", "s2").join(by_class, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near duplicates: one row of each component stays, that of the smallest doc_id (null ones last; of
    several, one). Here the row is the node, so that rows that repeat a doc_id and rows without one are copies like any
    other. Rows without words stay, but for those that repeat a doc_id."""
    row = free_name(docs, "row")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_components(own.select(F.col(row).alias("doc_id"), "text"), words, num, den).withColumnRenamed("doc_id", "row")
    found = own.select(F.col(row).alias("row"), "doc_id", h64(F.col("text")).alias("hash")).join(found, "row")
    bare = F.col("n_shingles") == 0
    group = [F.when(~bare | F.col("doc_id").isNull(), F.col("component_id")).alias("component"), F.when(bare, F.col("doc_id")).alias("bare_id")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row")).alias("least")
    stay = written(found.groupBy(*group).agg(least).select(F.col("least.row").alias(row)), "kept")
    return own.join(stay, row, "left_semi").drop(row).select(*docs.columns)


def op7_minhash_dedup(docs: DataFrame) -> DataFrame:
    out = near_components(docs, words=4, num=80, den=100)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
