"""Centroid clustering in whole numbers, with distances filtered in a PCA-rotated space.

Vectors are scaled to integers, and every distance, mean and tie is decided in integers, so a rerun on any number of
machines gives the same clusters.  To decide few of them, vectors are rotated to their principal axes once: a row
stores its leading rotated coordinates, as many as hold ``VARIANCE`` of all variance, and the norm of the rest.  For a centroid rotated alike, the squared
distance of the coordinates plus the squared difference of the two residual norms is a lower bound of the squared
distance (the triangle inequality on the rest).  A row first takes the exact distance to the centroid of the least bound;
centroids whose bound lies above it are out, the survivors are verified in integers.  Bounds are lowered by more than
their rounding error, so none is lost.

The covariance is summed over all rows (a table of dims x dims numbers), means by cluster and component, both by
Spark with map-side sums; the driver holds centroids x dims numbers a round and never a row.  Each round
reads the stored table once; a lost executor repeats its part of one round.

Left out: vectors that are NULL, of another length than ``dims``, or hold a NULL or non-finite component; also such with a
scaled component beyond 2**27, for which a squared distance need not fit a long.  A NULL key is clustered as any other but
starts no centroid.  Rows with equal keys count one by one; equal hashes among the starting centroids go by components.
Ties go to the smaller cluster.  With fewer vectors than ``k`` there are as many centroids.  An empty table gives an
empty table.  Other columns are not looked at.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seasonlens.llm.store import stored

K = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
#: Share of the variance that the stored coordinates hold; the rest is one norm.
VARIANCE = 0.9
#: Largest component: dims x (2 x LARGEST)^2 stays under 2^63.
LARGEST = 2.0 ** 27
#: (row, centroid) pairs verified at once.
PAIRS = 1 << 16
BATCH_ROWS = 4096
OUT = "key long, cluster int, distance long, pairs long"


@dataclass
class Clusters:
    """``members``: key, cluster, distance, pairs (centroids verified for the row); ``centroids``: their components, by cluster."""
    members: DataFrame
    centroids: list[list[int]]


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def scaled(vectors: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key, v: floor(scale x component) of the vectors that take part."""
    fits = lambda x: F.coalesce((x.cast("double") >= -LARGEST / scale) & (x.cast("double") < LARGEST / scale), F.lit(False))  # false for NaN
    ok = F.coalesce((F.size(vector) == dims) & F.forall(vector, fits), F.lit(False))
    return vectors.filter(ok).select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale))).alias("v"))


def _moments(dims: int):
    """Rows (place, total) of one task: its count, its sums and its sums of products."""
    def scan(batches):
        out = np.zeros(1 + dims + dims * dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            out += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        if out[0]:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(out)), pa.int32()), "total": out})
    return scan


def principal_axes(rows: DataFrame, dims: int = DIMS, variance: float = VARIANCE) -> tuple[np.ndarray, int]:
    """Orthonormal columns by falling variance, from the covariance over all rows, and how many of them hold ``variance``."""
    got = rows.select("v").mapInArrow(_moments(dims), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    at = np.zeros(1 + dims + dims * dims)
    for r in got:
        at[r.place] = r.total
    n = max(at[0], 1.0)
    mean = at[1:dims + 1] / n
    values, axes = np.linalg.eigh(at[dims + 1:].reshape(dims, dims) / n - np.outer(mean, mean))
    order = np.argsort(-values)
    held = np.cumsum(np.maximum(values[order], 0))
    return axes[:, order], min(dims, 1 + int(np.searchsorted(held, variance * held[-1])))


def _rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading coordinates, residual norm)."""
    y = x.astype(np.float64) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def _with_projection(axes: np.ndarray, leading: int, dims: int):
    def scan(batches):
        for batch in batches:
            lead, rest = _rotated(_matrix(batch.column(1), dims), axes, leading)
            kept = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), leading).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept, pa.array(rest)], names=["key", "v", "lead", "rest"])
    return scan


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, c: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, verified centroids) of each row: exact, by filtered candidates."""
    c_lead, c_rest = _rotated(c, axes, lead.shape[1])
    size, c_size = (lead ** 2).sum(axis=1) + rest ** 2, (c_lead ** 2).sum(axis=1) + c_rest ** 2
    bound = size[:, None] + c_size[None, :] - 2 * (lead @ c_lead.T) - 2 * rest[:, None] * c_rest[None, :]
    bound -= 1e-9 * (size[:, None] + c_size[None, :]) + 1  # more than the rounding of all sums above
    best = bound.argmin(axis=1)
    diff = x - c[best]
    dist = (diff * diff).sum(axis=1)
    row, of = np.nonzero(bound <= dist[:, None])
    least = np.full(len(x), np.iinfo(np.int64).max)
    cluster = best.astype(np.int64)
    for lo in range(0, len(row), PAIRS):
        r, k = row[lo:lo + PAIRS], of[lo:lo + PAIRS]
        d = x[r] - c[k]
        d = (d * d).sum(axis=1)
        order = np.lexsort((k, d, r))  # the first of each row is its nearest, the smaller cluster on a tie
        r, k, d = r[order], k[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        r, k, d = r[first], k[first], d[first]
        better = d < least[r]  # a row that goes over a slice has its smaller clusters in the earlier one
        least[r[better]], cluster[r[better]] = d[better], k[better]
    return cluster, least, np.bincount(row, minlength=len(x))


def _slices(batch, rows: int = BATCH_ROWS):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _sums(c: np.ndarray, axes: np.ndarray):
    """Rows (cluster, place, total) of one task: place -1 counts."""
    def scan(batches):
        dims = c.shape[1]
        total, count = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for whole in batches:
            for batch in _slices(whole):
                x = _matrix(batch.column(1), dims)
                cluster = nearest(x, _matrix(batch.column(2), len(batch.column(2)[0])), batch.column(3).to_numpy(), c, axes)[0]
                part = np.zeros(c.shape, np.int64)
                np.add.at(part, cluster, x)
                total += part.astype(object)
                count += np.bincount(cluster, minlength=len(c))
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(np.repeat(full, dims + 1), pa.int32()), "place": pa.array(np.tile(np.arange(-1, dims), len(full)), pa.int32()),
                "total": pa.array([str(t) for k in full for t in (int(count[k]), *total[k])])})
    return scan


def _assigned(c: np.ndarray, axes: np.ndarray):
    def scan(batches):
        for whole in batches:
            for batch in _slices(whole):
                x = _matrix(batch.column(1), c.shape[1])
                cluster, dist, pairs = nearest(x, _matrix(batch.column(2), len(batch.column(2)[0])), batch.column(3).to_numpy(), c, axes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(dist), pa.array(pairs)],
                                                 names=["key", "cluster", "distance", "pairs"])
    return scan


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
            scale: int = SCALE, variance: float = VARIANCE) -> Clusters:
    """Clusters after ``rounds`` rounds of assigning and averaging, and one more assignment."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, key, vector, dims, scale), "scaled")
    mark = F.sha2(F.concat(F.lit("2:"), F.col("key").cast("string")).cast("binary"), 256)
    start = rows.filter(F.col("key").isNotNull()).select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    c = np.array([r.v for r in start], np.int64).reshape(len(start), dims)
    if not len(c):
        return Clusters(spark.createDataFrame([], OUT), [])
    axes, leading = principal_axes(rows, dims, variance)
    rows = stored(rows.mapInArrow(_with_projection(axes, leading, dims), "key long, v array<long>, lead array<double>, rest double"), "rotated")
    for _ in range(rounds):
        got = rows.mapInArrow(_sums(c, axes), "cluster int, place int, total string") \
            .groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r.cluster, r.place): int(r.total) for r in got}
        c = c.copy()
        for i in range(len(c)):
            if (i, -1) in total:
                c[i] = [total[i, j] // total[i, -1] for j in range(dims)]
    return Clusters(stored(rows.mapInArrow(_assigned(c, axes), OUT), "assigned"), c.tolist())
