"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: a direction is a pair of code words, one for each half
of the coordinates. Every vector is list-decoded to all directions whose inner product exceeds the
cap's height (and to its `least` best ones). The height is set so that a random vector exceeds it for
about `caps` directions.

Equal vectors are one class. A class lives in a block of at most about BLOCK classes with the same best
filter. The join on filters carries no vectors, only the block and a sketch of 128 signs: two blocks are
candidates if they hold vectors with a common filter whose sketches are as close as those of a linked
pair are (a linked pair fails that with a probability under 1e-9). Each pair of candidate blocks is then
compared once, in double precision, and returns sums of links and a spanning forest, never all pairs. Filters
and homes with very many vectors are cut into chunks and blocks, so no task holds one whole.

Defined cases: null, zero and non-finite vectors, and rows with a null vec_id, link with nothing and are
kept; vectors of other lengths never meet. Rows that repeat a vec_id are each compared like any others.
An empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, h64, width, with_parts, written

WORDS, CAPS, LEAST = 1024, 56, 28
#: Classes of a block, entries of a chunk of a filter, rows of one call of either comparison.
BLOCK, CHUNK, GROUP_ROWS, GROUP_ENTRIES = 256, 2_048, 8_000, 200_000


class Caps:
    """The product code for vectors of one length."""

    def __init__(self, dims: int):
        self.dims, self.room = dims, max(8, dims + dims % 2)
        rng = np.random.default_rng(10_0100 + dims)
        half = self.room // 2
        self.signs = rng.standard_normal((dims, 128))
        self.code = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2) for c in rng.standard_normal((2, WORDS, half))]
        sample = rng.standard_normal((48, self.room))
        sample[:, dims:] = 0
        a, b = self.halves(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        self.height = float(np.mean([np.partition((x[:, None] + y[None, :]).ravel(), -CAPS)[-CAPS] for x, y in zip(a, b)]))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.room // 2
        return x[:, :half] @ self.code[0].T, x[:, half:] @ self.code[1].T

    def decode(self, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each unit vector the numbers of its filters, and that of the best one."""
        padded = np.zeros((len(x), self.room))
        padded[:, : self.dims] = x
        out = []
        for a, b in zip(*self.halves(padded)):
            i, j = np.argsort(-a)[:LEAST], np.argsort(-b)[:LEAST]
            best = np.sort((a[i][:, None] + b[j][None, :]).ravel())[-LEAST]
            least = min(self.height, best)
            i, j = np.flatnonzero(a >= least - b.max()), np.flatnonzero(b >= least - a.max())
            u, v = np.nonzero(a[i][:, None] + b[j][None, :] >= least)
            out.append((i[u] * WORDS + j[v], int(a.argmax()) * WORDS + int(b.argmax())))
        return out


_CAPS: dict[int, Caps] = {}


def caps(dims: int) -> Caps:
    if dims not in _CAPS:
        _CAPS[dims] = Caps(dims)
    return _CAPS[dims]


def classes(vectors: DataFrame, whole: bool = False) -> DataFrame:
    """vec_id, v1, v2 (whole: and embedding): 128 bits of the vector's components; null where it links with nothing."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or None in v else np.asarray(v, np.float64)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                d = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if ok else None
                a.append(d and int.from_bytes(d[:8], "little", signed=True)), b.append(d and int.from_bytes(d[8:], "little", signed=True))
            cols = [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(cols[: 3 + whole], ["vec_id", "v1", "v2", "embedding"][: 3 + whole])

    return vectors.mapInArrow(run, "vec_id long, v1 long, v2 long" + ", embedding array<double>" * whole)


def filters(reps: DataFrame) -> DataFrame:
    """id, weight, unit vector (binary), sketch (s1, s2), best filter and all filters of each class; reps: id, weight, embedding."""

    def run(batches):
        for batch in batches:
            x = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
            x = [v / np.abs(v).max() for v in x]
            x = [v / np.linalg.norm(v) for v in x]
            lists, home, sketch = [None] * len(x), np.zeros(len(x), np.int64), np.zeros((len(x), 2), np.int64)
            for dims in {len(v) for v in x}:
                own = [i for i, v in enumerate(x) if len(v) == dims]
                unit = np.stack([x[i] for i in own])
                for i, (f, best) in zip(own, caps(dims).decode(unit)):
                    lists[i], home[i] = f + (dims << 32), best + (dims << 32)
                sketch[own] = np.packbits(unit @ caps(dims).signs > 0, axis=1).view(np.int64)
            cols = [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in sketch.T], pa.array(home), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "weight", "unit", "s1", "s2", "home", "filters"])

    return reps.mapInArrow(run, "id long, weight long, unit binary, s1 long, s2 long, home long, filters array<long>")


def most_bits(cosine: float) -> int:
    """Signs of 128 in which a pair of this cosine differs at most, by seven standard deviations."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(np.ceil(128 * p + 7 * np.sqrt(128 * p * (1 - p))))


def near_blocks(entries: DataFrame, bits: int, groups: int) -> DataFrame:
    """(x, y), x <= y: blocks of vectors that share a filter and differ in at most `bits` signs; entries: filter, id, block, s1, s2."""

    def compare(t):
        t = t.sort_by([("filter", "ascending"), ("i", "ascending"), ("j", "ascending")])
        f, i, j, chunk, block = (t[c].to_numpy() for c in ("filter", "i", "j", "chunk", "block"))
        s1, s2 = (t[c].to_numpy().view(np.uint64) for c in ("s1", "s2"))  # of signed numbers bitwise_count takes the absolute value
        cuts = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        end = np.repeat(cuts[1:], np.diff(cuts))
        a, step, found = np.arange(len(f)), 1, np.zeros((0, 2), np.int64)
        some = [found]
        while len(a := a[a + step < end[a]]):  # each row with the one `step` places on in its group
            b = a + step
            near = (np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b])) <= bits
            near &= (i[a] == j[a]) | (chunk[a] != chunk[b])
            x, y = block[a[near]], block[b[near]]
            some.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            if sum(map(len, some)) > 500_000:
                some = [np.unique(np.concatenate(some), axis=0)]
            step += 1
        found = np.unique(np.concatenate(some), axis=0)
        return pa.table({"x": np.ascontiguousarray(found[:, 0]), "y": np.ascontiguousarray(found[:, 1])})

    cut = with_parts(entries, "filter", CHUNK, "chunk")
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("filter", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "block", "s1", "s2")
    dealt = cut.withColumn("g", F.pmod(h64(11, F.col("filter"), F.col("i"), F.col("j")), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(compare, "x long, y long").distinct()


def block_pair_links(unit, weight, side, cosine):
    """Links between the blocks of a pair (side: number of the row's block), or in one block: rows with links, how many for
    each, and a spanning forest (pairs of rows)."""
    link = np.triu(unit @ unit.T >= cosine, 1)
    if side[0] != side[-1]:
        link &= side[:, None] != side[None, :]
    if not link.any():
        return [], [], []
    near = np.flatnonzero(link.any(0) | link.any(1))
    link, weight = link[np.ix_(near, near)], weight[near]
    count = link @ weight + link.T @ weight
    root = list(range(len(near)))

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    forest = []
    for x, y in np.argwhere(link).tolist():
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            forest.append((int(near[x]), int(near[y])))
    return near.tolist(), count.tolist(), forest


def confirmed_links(pairs: DataFrame, members: DataFrame, cosine: float, groups: int) -> DataFrame:
    """(id, links, other): links to add to id's count; other, where not null, is an edge of the forest. pairs: x, y; members:
    block, id, weight, unit. Pairs of blocks are dealt whole to `groups` groups, so that one call handles many small ones."""

    def compare(t):
        t = t.sort_by([("x", "ascending"), ("y", "ascending"), ("block", "ascending")])
        x, y, ids, weight, block = (t[c].to_numpy() for c in ("x", "y", "id", "weight", "block"))
        raw = t["unit"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]]))
        out_id, out_links, out_other = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            unit = np.frombuffer(b"".join(raw[a:b])).reshape(b - a, -1)
            some, count, forest = block_pair_links(unit, weight[a:b], block[a:b], cosine)
            out_id += [int(ids[a + i]) for i in some] + [int(ids[a + i]) for i, _ in forest]
            out_links += count + [0] * len(forest)
            out_other += [None] * len(some) + [int(ids[a + i]) for _, i in forest]
        return pa.table({"id": pa.array(out_id, pa.int64()), "links": pa.array(out_links, pa.int64()), "other": pa.array(out_other, pa.int64())})

    ends = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    rows = pairs.select("x", "y", F.explode(ends).alias("block")).join(members, "block")
    dealt = rows.withColumn("g", F.pmod(h64(11, F.col("x"), F.col("y")), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(compare, "id long, links long, other long")


def embedding_components(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id for every row; vectors: vec_id, embedding."""
    least = width(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = written(classes(own), "vectors")
    cls = keyed.where("v1 is not null and vec_id is not null").groupBy("v1", "v2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    # A repeated vec_id may stand for several classes: the class, not the id, is the node, and has a number.
    cls = written(cls.withColumn("id", F.monotonically_increasing_id()), "classes")
    body = classes(own.join(cls.select("vec_id").distinct(), "vec_id", "left_semi"), True)
    body = body.join(cls.select("v1", "v2", "id", "weight"), ["v1", "v2"]).dropDuplicates(["v1", "v2"]).select("id", "weight", "embedding")
    found = with_parts(written(filters(body), "filters"), "home", BLOCK, "part").withColumn("block", h64(5, F.col("home"), F.col("part"))).drop("parts", "part")
    found = written(found, "blocks")
    members = found.select("block", "id", "weight", "unit")
    entries = found.select(F.explode("filters").alias("filter"), "id", "block", "s1", "s2")
    total = found.agg(F.coalesce(F.sum(F.size("filters")), F.lit(0))).first()[0]
    pairs = written(near_blocks(entries, most_bits(cosine), max(least, total // GROUP_ENTRIES)), "block-pairs")
    size = members.groupBy("block").agg(F.count("*").alias("n"))
    total = pairs.select(F.explode(F.array("x", "y")).alias("block")).join(size, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = written(confirmed_links(pairs, members, cosine, max(least, total // GROUP_ROWS)), "links")
    comp = components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = cls.join(total, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    named = named.join(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component")
    named = written(named.select("v1", "v2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "by-class")
    out = keyed.join(named, ["v1", "v2"], "left")
    linked = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.coalesce("component_id", "vec_id")).alias("component_id"))


def op10_embedding_dedup(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    out = embedding_components(vectors, cosine)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
