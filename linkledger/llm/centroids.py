"""Centroid clustering with the threshold algorithm.

Each dimension has the list of all centroids sorted by their value there. From a vector's own value the list is
walked outward, one centroid a round, the nearer of both sides first. A centroid that comes up for the first time
gets its exact distance. The squares of the last gaps of all dimensions add up to the frontier: no centroid that has not come
up is nearer. The walk stops when the frontier strictly exceeds the best exact distance, so that ties are seen,
and the smaller number wins them. A batch of vectors walks together; those that have stopped drop out.

Vectors are integers, floor(scale * x). The centroids, k vectors, are all that the driver holds. Each task returns
sums and counts for each centroid and dimension, so a cluster that holds most vectors is no hot group.

Defined cases: vectors that are null, of other lengths, or hold null or non-finite components are left out; components of
more than 2^27 in size count as 2^27 (distances then fit a long); rows that repeat a vec_id, and those with a null one, are vectors of
their own; ones with a null vec_id start no cluster unless there are too few others; rows that tie for a start are taken by content;
with fewer than k vectors there are fewer centroids; an empty table gives no rows; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K, DIMS, SCALE, ROUNDS = 16, 64, 64, 3
LARGEST = 1 << 27
#: Vectors that walk together.
WALK = 2_048


def integers(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id, v: the kept vectors as integers; vectors: vec_id, embedding."""

    def run(batches):
        for batch in batches:
            own = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)  # null: NaN
            fine = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * x[fine]), -LARGEST, LARGEST).astype(np.int32)
            v = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(fine)), v], ["vec_id", "v"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, v array<int>")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row and its squared distance, by the threshold algorithm."""
    (n, dims), k = x.shape, len(centres)
    order = np.argsort(centres, axis=0, kind="stable")
    lists, dim = np.take_along_axis(centres, order, 0), np.arange(dims)
    far = np.int64(2**62)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
    right = np.stack([np.searchsorted(lists[:, j], x[:, j]) for j in dim], 1)
    left, seen, live = right - 1, np.zeros((n, k), bool), np.arange(n)
    while len(live):
        own, lo, hi = x[live], left[live], right[live]
        below = np.where(lo >= 0, own - lists[np.maximum(lo, 0), dim], far)
        above = np.where(hi < k, lists[np.minimum(hi, k - 1), dim] - own, far)
        down = below <= above
        gap, came = np.minimum(below, above), order[np.where(down, lo, np.minimum(hi, k - 1)), dim]
        left[live], right[live] = lo - down, hi + ~down
        new = np.zeros((len(live), k), bool)
        np.put_along_axis(new, came, True, 1)
        new &= ~seen[live]
        seen[live] |= new
        row, c = np.nonzero(new)
        exact = np.full((len(live), k), np.iinfo(np.int64).max)
        exact[row, c] = ((own[row] - centres[c]) ** 2).sum(1)
        d, c = exact.min(1), exact.argmin(1)
        better = (d < best[live]) | (d == best[live]) & (c < who[live])
        best[live[better]], who[live[better]] = d[better], c[better]
        frontier = (gap**2).sum(1)
        live = live[~((frontier > best[live]) | seen[live].all(1))]
    return who, best


def _walks(batches, centres: np.ndarray):
    """(ids, vectors, cluster, distance) of runs of rows."""
    for batch in batches:
        x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, centres.shape[1])
        for i in range(0, len(x), WALK):
            yield batch.column(0).slice(i, WALK), x[i : i + WALK], *nearest(x[i : i + WALK], centres)


def sums(kept: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster: number of its vectors and the sum of each component."""

    def run(batches):
        k, dims = centres.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, who, _ in _walks(batches, centres):
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        c, d = np.divmod(np.flatnonzero(np.repeat(count > 0, dims)), dims)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d]), pa.array(count[c])], ["c", "d", "total", "n"])

    parts = kept.mapInArrow(run, "c long, d long, total long, n long")
    out: dict[int, tuple[int, list[int]]] = {}
    for c, _, total, n in parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38, 0)")), F.sum("n")).orderBy("c", "d").collect():  # k * dims rows
        out.setdefault(c, (n, []))[1].append(int(total))
    return out


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: float = SCALE, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids (k vectors)."""
    kept = written(integers(vectors, dims, scale), "vectors")
    start = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v")
    centres = np.array([r["v"] for r in start.limit(k).collect()], np.int64).reshape(-1, dims)
    if len(centres):
        for _ in range(rounds):
            centres = centres.copy()
            for c, (n, total) in sums(kept, centres).items():
                centres[c] = [t // n for t in total]  # exact, rounded down

    def run(batches):
        for ids, _, who, best in _walks(batches, centres):
            yield pa.RecordBatch.from_arrays([ids, pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long"), centres


def op12_centroids(vectors: DataFrame) -> DataFrame:
    found, centres = cluster(vectors)
    found = written(found, "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38, 0)"))
    inertia = {c: int(s) for c, s in found.groupBy("cluster").agg(wide).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    fit = lambda s: min(s, 2**63 - 1)
    rows = [(c, fit(s), fit(sum(inertia.values())), digest[c]) for c, s in inertia.items()]
    named = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same in SQL, distances to all centroids compared. rid tells rows apart that share a vec_id."""
    floor = "(s - ((s % n) + n) % n) // n"
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS})""",
        "wide AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(len(v))) AS d FROM kept)",
        f"first AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept QUALIFY c < {K})",
        "c0 AS MATERIALIZED (SELECT c, d, CAST(x AS HUGEINT) AS y FROM first JOIN wide USING (rid))",
    ]
    for i in range(ROUNDS + 1):
        dist = f"SELECT rid, c, sum((x - y) * (x - y)) AS dist FROM wide JOIN c{i} USING (d) GROUP BY rid, c"
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM ({dist}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)")
        if i < ROUNDS:
            moved = f"SELECT c, d, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM a{i} JOIN wide USING (rid) GROUP BY c, d"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce({floor}, y) AS y FROM c{i} LEFT JOIN ({moved}) USING (c, d))")
    parts.append(f"digest AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (rid) JOIN digest USING (c)"""


OP12_SQL = _oracle()
