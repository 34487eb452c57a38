"""Centroid clustering with Elkan's bounds, exact in integers (operator 13).

Vectors become integer vectors once.  Each row of the state table carries its vector,
its centroid, an upper bound of the distance to it and a lower bound for each of the k
centroids; a round reads one state table and writes the next, so nothing is shuffled
but a partial sum of each centroid and task.  Between rounds bounds move by how far the
centroids went.

A centroid is left out for a row if the upper bound is strictly below its lower bound or
below half the distance between the two centroids: then it is strictly farther, so ties
are always compared.  Distances are exact integers; a bound made of one is rounded
outwards by two steps of a double, and by one more for each sum.  What bounds do not
rule out is computed, and the smaller number wins a tie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: Components beyond this would take a squared distance out of 64 bits.
LIMIT = 1 << 27
_STATE = "vec_id long, vec binary, cluster int, upper double, lower binary, distance long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, vec)``: floor(scale * x) of each component as little-endian 32-bit numbers, of the vectors with ``dims`` finite components.

    A component beyond 2^27 after scaling raises, since squared distances would not fit a long.
    """

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            scaled = np.floor(x.astype(np.float64) * scale)
            if len(scaled) and np.abs(scaled).max() > LIMIT:
                raise ArithmeticError(f"a component beyond {LIMIT // scale} in size: squared distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in scaled.astype("<i4")], pa.binary())], ["vec_id", "vec"])

    vec = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dims)).where(finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _first_centroids(vectors: DataFrame, k: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id; equal ids by their components."""
    mark = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), F.hex("vec")).limit(k).collect()
    return np.array([np.frombuffer(r.vec, "<i4") for r in rows], np.int64).reshape(len(rows), dims)


def _out(x: np.ndarray, steps: int = 1) -> np.ndarray:
    for _ in range(steps):
        x = np.nextafter(x, np.inf)
    return x


def _in(x: np.ndarray, steps: int = 1) -> np.ndarray:
    for _ in range(steps):
        x = np.nextafter(x, -np.inf)
    return np.maximum(x, 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...j,...j->...", d, d)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple:
    """The nearest centroid of each row of ``x`` with its bounds: ``(cluster, upper, lower, distance, computed)``.

    distance is the squared one where it was computed, else -1; computed counts them.
    ``cluster`` -1 means that nothing is known of a row yet.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    exact = np.full(len(x), -1, np.int64)
    half = _in(np.sqrt(_squared(centroids[:, None], centroids[None]).astype(np.float64)) / 2, 3)
    new = cluster < 0
    cluster[new] = 0
    computed = 0

    def measure(rows: np.ndarray, c: int | np.ndarray) -> np.ndarray:
        nonlocal computed
        computed += len(rows)
        d = _squared(x[rows], centroids[c])
        lower[rows, c] = _in(np.sqrt(d.astype(np.float64)), 2)
        return d

    def open_for() -> np.ndarray:
        rivals = (upper[:, None] >= lower) & (upper[:, None] >= half[cluster])
        rivals[np.arange(len(x)), cluster] = False
        return rivals

    rows = np.flatnonzero(open_for().any(axis=1) | new)
    exact[rows] = measure(rows, cluster[rows])
    upper[rows] = _out(np.sqrt(exact[rows].astype(np.float64)), 2)
    for c in range(len(centroids)):
        rivals = (cluster != c) & (upper >= lower[:, c]) & (upper >= half[cluster, c])
        rows = np.flatnonzero(rivals)
        if not len(rows):
            continue
        d = measure(rows, c)
        better = (d < exact[rows]) | ((d == exact[rows]) & (c < cluster[rows]))
        rows, d = rows[better], d[better]
        cluster[rows], exact[rows], upper[rows] = c, d, _out(np.sqrt(d.astype(np.float64)), 2)
    return cluster, upper, lower, exact, computed


def _step(centroids: np.ndarray, moved: np.ndarray | None, dims: int, last: bool):
    """A pass over the state: bounds move, rows are assigned; in the last one every row's distance is computed."""

    def run(batches):
        k = len(centroids)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            if b.num_columns == 2:
                cluster, upper = np.full(len(x), -1, np.int32), np.full(len(x), np.inf)
                lower = np.zeros((len(x), k))
            else:
                cluster, upper = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                lower = _in(np.frombuffer(b"".join(b.column(4).to_pylist())).reshape(-1, k) - moved)
                upper = _out(upper + moved[cluster])
            cluster, upper, lower, exact, _ = assign(x, cluster, upper, lower, centroids)
            if last:
                exact = _squared(x, centroids[cluster]) if len(x) else exact
            bounds = pa.array([r.tobytes() for r in lower], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(exact)], ["vec_id", "vec", "cluster", "upper", "lower", "distance"])

    return run


def _sums(dims: int):
    """Sums of each centroid's vectors, a row for each centroid and component of a batch; component -1 is the count."""

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            cluster = b.column(0).to_numpy(zero_copy_only=False)
            which, at = np.unique(cluster, return_inverse=True)
            total = np.zeros((len(which), dims + 1), np.int64)
            np.add.at(total, at, np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(which, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(which))), pa.array(total.ravel())], ["cluster", "component", "s"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; an empty cluster's centroid stays.  k * (dims + 1) sums come to the driver."""
    dims = centroids.shape[1]
    parts = state.select("cluster", "vec").mapInArrow(_sums(dims), "cluster int, component int, s long")
    sums = {(r.cluster, r.component): int(r.s) for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, -1)):
            out[c] = [sums[c, j] // n for j in range(dims)]
    return out


def kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """State table ``(vec_id, vec, cluster, upper, lower, distance)`` after ``rounds`` rounds and one more assignment, and the centroids.

    ``vectors`` is ``(vec_id, vec)`` of ``integer_vectors``.  With fewer than k rows
    there are as many centroids as rows.
    """
    now = written(vectors, "vectors")
    centroids = _first_centroids(now, k, dims)
    moved = None
    for turn in range(rounds + 1):
        step = _step(centroids, moved, dims, turn == rounds)
        after = written(now.mapInArrow(step, _STATE) if len(centroids) else now.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.col("vec").alias("lower"), F.lit(0).cast("long").alias("distance")), "kmeans")
        drop_written(now)
        now = after
        if turn < rounds and len(centroids):
            means = _means(now, centroids)
            moved = _out(np.sqrt(_squared(means, centroids).astype(np.float64)), 2)
            moved[(means == centroids).all(axis=1)] = 0.0
            centroids = means
    return now, centroids


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each kept row of ``embeddings (vec_id, embedding)``.

    Kept are vectors of ``dims`` components, none null or non-finite; others give no
    row.  Repeated rows are vectors each; a null id counts last when the first
    centroids are chosen, and equal ids by their components.  An empty table, or one
    without a kept vector, gives no rows; further columns are not read.  A component
    beyond 2^27 after scaling raises an ArithmeticError.
    """
    state, centroids = kmeans(integer_vectors(embeddings, dims=dims, scale=scale), k, rounds, dims)
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    each = F.array(*[F.lit(int(inertia.get(c, 0))).cast("long") for c in range(len(shas))] or [F.lit(0).cast("long")])
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(each, "cluster").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*[F.lit(s) for s in shas or [""]]), "cluster").alias("centroid_sha256"),
    )
