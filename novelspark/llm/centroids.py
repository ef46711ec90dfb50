"""Centroid clustering by Lloyd rounds that skip distances by Drake's adaptive bounds.

A vector keeps its nearest centroids in order, each with a lower bound of its distance, one
more bound for all the rest, and an upper bound for the centroid it is in.  When centroids
move, bounds move by as much.  A vector whose upper bound is below all others stays where it
is; otherwise the shortest run of its nearest centroids is measured that is certainly nearer
than all that is not measured; if there is none, all centroids are measured.  The number of bounds
adapts: it is the longest run that a round measured, an eighth of the centroids at least.
Bounds are rounded so that they stay bounds, and only a strict gap certifies, so every
assignment is that of a full search, ties to the smaller number included.

Vectors are integers, so that distances, sums and new centroids (floor of the mean) are
exact.  A round writes vectors with their bounds in the shared folder; only the vectors that
changed their cluster are summed, into a table of fixed size.  Centroids are broadcast: they
are as many as asked for.

Edge cases: rows that are null, have another length, or a null or non-finite component are
not kept; components beyond 2 ** 27 in size raise an error, as squared distances then pass
64 bits; vectors that share an id are vectors of their own (as seeds in the order of their
components); fewer vectors than seeds give as many centroids; equal vectors share a cluster;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array_sums, discard, stored, table

#: Relative slack of a bound: more than the rounding of a root, a sum and a product.
SLACK = 2.0**-48
#: Largest component: the squared distance of two vectors of up to 128 then fits in 64 bits.
LARGEST = 1 << 27
#: Below this, products of two vectors are exact as floating-point numbers.
EXACT_PRODUCT = 2.0**52


def integers(vectors: DataFrame, vec_id: str, values: str, dimension: int, scale: int) -> DataFrame:
    """id, x: floor(scale * component) of the vectors that are whole and finite."""
    v = F.col(values).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    kept = vectors.where(F.coalesce((F.size(v) == dimension) & finite, F.lit(False)))
    whole = lambda e: F.when(F.abs(e) > F.lit(LARGEST / scale), F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}"))).otherwise(F.floor(F.lit(scale) * e)).cast("int")
    return kept.select(F.col(vec_id).cast("bigint").alias("id"), F.transform(v, whole).alias("x"))


def seeds(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors of ``rows`` (id, x) with the smallest sha256 of "seed:id", in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r.x for r in first], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    most = float(max(np.abs(x).max(), np.abs(c).max(), 1))
    if 4 * x.shape[1] * most * most < EXACT_PRODUCT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - SLACK)


def _above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK)


class Bounds:
    """``near`` (rows, b): nearest centroids in order; ``low``: lower bounds of their distances;
    ``rest``: one for all other centroids; ``up``: an upper bound of the first's."""

    def __init__(self, near: np.ndarray, low: np.ndarray, rest: np.ndarray, up: np.ndarray) -> None:
        self.near, self.low, self.rest, self.up = near, low, rest, up

    @classmethod
    def measured(cls, square: np.ndarray, b: int) -> Bounds:
        order = np.argsort(square, axis=1, kind="stable")
        near = order[:, :b]
        low = _below(np.take_along_axis(square, near, 1))
        rest = _below(np.take_along_axis(square, order[:, b : b + 1], 1))[:, 0] if square.shape[1] > b else np.full(len(square), np.inf)
        return cls(near.astype(np.int32), low, rest, _above(square[np.arange(len(square)), near[:, 0]]))

    def moved(self, shift: np.ndarray) -> None:
        """Centroids moved by ``shift`` (an upper bound for each)."""
        self.up = (self.up + shift[self.near[:, 0]]) * (1 + SLACK)
        self.low = np.maximum(self.low - shift[self.near], 0) * (1 - SLACK)
        self.rest = np.maximum(self.rest - shift.max(initial=0.0), 0) * (1 - SLACK)

    def settle(self, x: np.ndarray, centroids: np.ndarray) -> int:
        """Makes ``near`` right for ``centroids``; returns the longest run that was measured."""
        b = self.near.shape[1]
        # what every centroid from the z-th of the list on is certainly beyond
        beyond = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.up >= beyond[:, 1])
        longest = 1
        if not len(open_):
            return longest
        first = self.near[open_, 0]
        square = ((x[open_] - centroids[first]) ** 2).sum(1)
        self.up[open_], self.low[open_, 0] = _above(square), _below(square)
        run = (self.up[open_, None] >= beyond[open_, 1:]).sum(1) + 1  # bounds grow along the list
        for z in np.unique(run).tolist():
            rows = open_[run == z]
            if z == 1:
                continue
            if z > b:  # the rest is not certainly further: all centroids
                new = Bounds.measured(squares(x[rows], centroids), b)
                self.near[rows], self.low[rows], self.rest[rows], self.up[rows] = new.near, new.low, new.rest, new.up
                continue
            longest = max(longest, z)
            some = self.near[rows, :z]
            d = ((x[rows, None, :] - centroids[some]) ** 2).sum(2)
            order = np.lexsort((some, d), axis=1)
            self.near[rows, :z] = np.take_along_axis(some, order, 1)
            d = np.take_along_axis(d, order, 1)
            self.low[rows, :z], self.up[rows] = _below(d), _above(d[:, 0])
        return longest

    def cut(self, b: int) -> None:
        """Keeps b of the list; the others join the rest."""
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]


STATE = "id bigint, x array<int>, was int, cluster int, near array<int>, low array<double>, rest double, up double, measured int"


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _assigned(rows: DataFrame, centroids: np.ndarray, shift: np.ndarray | None, b: int) -> DataFrame:
    """``rows`` assigned anew: by all distances without ``shift``, else by their bounds."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((centroids, shift))  # as many as clusters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, shift = shared.value
        names = STATE.replace(", ", ",").split(",")
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = _matrix(col["x"], np.int64)
            if shift is None:
                bounds, was, longest = Bounds.measured(squares(x, centroids), b), np.full(len(x), -1), 0
            else:
                bounds = Bounds(_matrix(col["near"], np.int32).copy(), _matrix(col["low"], np.float64).copy(), col["rest"].to_numpy().copy(), col["up"].to_numpy().copy())
                was = bounds.near[:, 0].copy()
                bounds.moved(shift)
                longest = bounds.settle(x, centroids)
                bounds.cut(max(b, longest))
            arrays = [
                col["id"], col["x"], pa.array(was, pa.int32()), pa.array(bounds.near[:, 0], pa.int32()), _lists(bounds.near, pa.int32()),
                _lists(bounds.low, pa.float64()), pa.array(bounds.rest), pa.array(bounds.up), pa.array(np.full(len(x), longest), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [n.split(" ")[0] for n in names])

    return rows.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to sums and counts of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, was, now = _matrix(batch.column(0), np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, sign in ((now, 1), (was, -1)):
                use = at >= 0
                np.add.at(sums, at[use], sign * x[use])
                counts += sign * np.bincount(at[use], minlength=k)
        return {"sums": sums, "counts": counts}

    out = array_sums(state.where("was != cluster").select("x", "was", "cluster"), run, {"sums": (k, dimension), "counts": (k,)})
    return out["sums"], out["counts"]


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """``rows`` (id, x) with their cluster after ``rounds`` of assigning and moving centroids
    and one more of assigning, and the final centroids."""
    k, dimension = centroids.shape
    least = max(2, k // 8)
    b = min(k, max(least, k // 4))
    state = stored(_assigned(rows, centroids, None, b), "centroid-state")
    sums, counts = np.zeros((k, dimension), object), np.zeros(k, object)
    for _ in range(rounds):
        more_sums, more_counts = _changes(state, k, dimension)
        sums, counts = sums + more_sums, counts + more_counts
        new = centroids.copy()
        for c in range(k):
            if counts[c]:
                new[c] = [int(s) // int(counts[c]) for s in sums[c]]
        shift = _above(((new - centroids) ** 2).sum(1))
        centroids = new
        after = stored(_assigned(state, centroids, shift, b), "centroid-state")
        discard(rows.sparkSession, state)
        state = after
        b = min(b, max(least, int(state.agg(F.max("measured")).first()[0] or 0)))
    return state, centroids


OUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def clustered(rows: DataFrame, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """``rows`` (id, x): vec_id, cluster, distance (squared), cluster_inertia, inertia and the
    sha256 of the components of the centroid."""
    spark = rows.sparkSession
    first = seeds(rows, k, seed)
    if not len(first):
        return spark.createDataFrame([], OUT)
    state, centroids = fit(rows, first, rounds)
    final = [(c, [int(v) for v in row], hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    known = F.broadcast(spark.createDataFrame(final, "cluster int, centre array<bigint>, centroid_sha256 string"))  # k rows
    square = F.aggregate(F.zip_with("x", "centre", lambda a, c: (a - c) * (a - c)), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    measured = state.select("id", "x", "cluster").join(known, "cluster").select(F.col("id").alias("vec_id"), "cluster", square.alias("distance"), "centroid_sha256")
    per = measured.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r[0]: r[1] for r in per.collect()}  # k rows at most
    totals = F.broadcast(spark.createDataFrame([(c, s, sum(sums.values())) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint"))
    return measured.join(totals, "cluster").select(*OUT.replace(",", "").split()[::2])


DIMENSION, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMENSION, SCALE), "integer-vectors")
    return clustered(rows, CLUSTERS, ROUNDS)


def oracle() -> str:
    """The same by full searches."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [
        f"""r AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSION})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM r ORDER BY h, x LIMIT {CLUSTERS}))""",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT v.n, v.vec_id, v.x, min({{'d': {distance}, 'c': c.c}}) AS m FROM r v, c{k} c GROUP BY v.n, v.vec_id, v.x)")
        if k < ROUNDS:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.x, o.x) AS x FROM c{k} o LEFT JOIN (
  SELECT c, list((t - ((t % q) + q) % q) // q ORDER BY p)::BIGINT[] AS x FROM (SELECT m.c AS c, p, sum(x[p])::HUGEINT AS t, count(*)::HUGEINT AS q FROM a{k}, range(1, {DIMENSION + 1}) g(p) GROUP BY m.c, p) GROUP BY c) s ON s.c = o.c)""")
    last = ROUNDS
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} f ON f.c = m.c"""
