"""Largest inner products by low-dimensional stable projections indexed by a kd-tree.

Vectors are lifted by one component so that all get the largest norm; then the largest inner product is the
smallest distance.  ``DIMS`` Gaussian projections map them to a low-dimensional space in which the squared
distance of two vectors, divided by their true one, follows a chi-square law.  A kd-tree over a bounded
sample of projected rows cuts that space into cells; every row is stored in its cell.  A query first
searches its own cell, which bounds the distance of its k-th neighbour, then visits the cells whose boxes reach
into the projected radius that this bound allows.  In a cell, rows are verified on the original vectors in
the order of projected distance until the next one fails the chi-square test: a true neighbour would lie
that far out with probability 1 - ``CONFIDENCE`` at most.

Equal vectors are stored once with their k + 1 smallest ids, which loses nothing: larger ids of the same score
cannot enter a list.  Cells are split into chunks of rows and parts of queries, so a task is bounded whatever
one cell or its visitors hold.  The sample (``SAMPLE`` rows) and the cells (``MAX_CELLS``) are all that reaches the driver.

Nulls: rows with a NULL id, or a vector that is NULL, zero, of another length than most, or holds a NULL or
non-finite component, take no part.  Ties go to smaller ids.  Equal rows are one candidate; of several vectors of one
id the smallest is its query.  An empty table
gives an empty result; with fewer candidates than k, all are returned.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from seasonlens.llm.store import stored

DIMS = 8
CONFIDENCE = 0.99
SAMPLE = 65_536
CELL_ROWS = 2048
MAX_CELLS = 4096
#: Coordinates of (query, cell) distances that a task holds at a time, 32 MB of doubles: queries pass in slices.
REACH_AT_ONCE = 1 << 22
STEP = 256
TASK_ROWS = 8192
TASK_QUERIES = 2048
OUT = "query_id long, rank int, vec_id long, score double"


def chi_square_quantile(p: float, dims: int) -> float:
    """Of an even number of dimensions, by bisection on the closed form of the tail."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return hi


class Tree:
    """A complete kd-tree: medians of the widest dimension, level by level."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros((1 << depth) - 1, np.int64)
        self.cut = np.zeros((1 << depth) - 1)
        parts = [np.arange(len(sample))]
        for node in range(len(self.dim)):
            pts = sample[parts[node]]
            d = int(np.argmax(pts.max(axis=0) - pts.min(axis=0))) if len(pts) else 0
            c = float(np.median(pts[:, d])) if len(pts) else 0.0
            self.dim[node], self.cut[node] = d, c
            right = sample[parts[node], d] > c
            parts += [parts[node][~right], parts[node][right]]

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.dim[at]] > self.cut[at])
        return at - len(self.dim)


def _matrix(column) -> np.ndarray:
    """[rows, components] of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(ok)


def _project(x: np.ndarray, norm2: float, query: bool, directions: np.ndarray) -> np.ndarray:
    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))
    return x @ directions[:-1] + lift[:, None] * directions[-1]


def _search(k: int, chi2: float, norm2: float):
    """Cogroup of a cell's rows and its visitors: each visitor's best k of the chunk."""
    def search(key, rows: pa.Table, visits: pa.Table) -> pa.Table:
        qid, rank_id, score, bound_out = [], [], [], []
        n = rows.num_rows
        if n:
            x, px = _matrix(rows["vector"]), _matrix(rows["place"])
            ids = rows["ids"].combine_chunks()
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            first, many = flat[off[:-1]], np.diff(off)
            qv, qp = _matrix(visits["vector"]), _matrix(visits["place"])
            queries, bounds = visits["query_id"].to_numpy(), visits["bound"].to_numpy()
            size = (px * px).sum(axis=1)
            for lo in range(0, len(queries), 64):
                far = size + (qp[lo:lo + 64] ** 2).sum(axis=1)[:, None] - 2 * qp[lo:lo + 64] @ px.T
                for query, q, f, bound in zip(queries[lo:lo + 64], qv[lo:lo + 64], far, bounds[lo:lo + 64]):
                    base = float(q @ q) + norm2
                    floor = (base - bound) / 2  # what an answer must score
                    some = np.flatnonzero(f <= chi2 * bound)
                    best = []  # (rows, scores) verified so far
                    if len(some) > STEP:  # the nearest by projection first: they tighten the bound
                        cut = np.argpartition(f[some], STEP)
                        near, some = some[cut[:STEP]], some[cut[STEP:]]
                        s = np.where((first[near] == query) & (many[near] == 1), -np.inf, x[near] @ q)
                        best.append((near, s))
                        kth = np.partition(s, STEP - k)[STEP - k]
                        floor = max(floor, kth) if np.isfinite(kth) else floor
                        some = some[f[some] <= chi2 * max(0.0, base - 2 * floor) * (1 + 1e-12) + 1e-12]
                    best.append((some, np.where((first[some] == query) & (many[some] == 1), -np.inf, x[some] @ q)))
                    seen, s = np.concatenate([r for r, _ in best]), np.concatenate([v for _, v in best])
                    if len(s) > k:
                        floor = max(floor, np.partition(s, len(s) - k)[len(s) - k])
                    seen = seen[(s >= floor - 1e-9 * (1 + abs(floor))) & np.isfinite(s)]  # a little below, for the last bits of a sum
                    exact = (np.ascontiguousarray(x[seen]) * q).sum(axis=1)
                    take = np.lexsort((first[seen], -exact))[:k]
                    seen, exact = seen[take], exact[take]
                    cand = np.concatenate([flat[off[i]:off[i + 1]] for i in seen]) if len(seen) else np.zeros(0, np.int64)
                    sc = np.repeat(exact, many[seen])
                    sc, cand = sc[cand != query], cand[cand != query]
                    top = np.lexsort((cand, -sc))[:k]
                    qid.append(np.full(len(top), query))
                    rank_id.append(cand[top])
                    score.append(sc[top])
                    bound_out.append(np.full(len(top), base))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        return pa.table({"query_id": cat(qid, np.int64), "vec_id": cat(rank_id, np.int64), "score": cat(score, np.float64), "base": cat(bound_out, np.float64)})
    return search


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, dims: int = DIMS,
            confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession

    good = usable(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")), "vec_id", "vector")
    good = good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0 and 0 are one value
    usual = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], OUT)
    dim, norm2 = usual["d"], usual["m"]
    good = good.filter(F.size("vector") == dim)
    directions = np.random.default_rng(seed).standard_normal((dim + 1, dims))

    # equal vectors once, with their smallest ids; only k + 1 rows of a vector leave a map task
    turn = F.dense_rank().over(W.partitionBy("vector").orderBy("vec_id"))
    few = good.withColumn("_r", turn).filter(F.col("_r") <= k + 1)
    one = stored(few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = one.count()
    depth = max(0, min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(max(1, n / cell_rows)))))

    def placed(query: bool):
        def place(batches):
            for b in batches:
                p = _project(_matrix(b.column(0)), norm2, query, directions)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), dims).cast(pa.list_(pa.float64()))],
                                                 names=[*b.schema.names, "place"])
        return place

    share = min(1.0, SAMPLE / n)
    sample = one.filter(F.pmod(F.xxhash64(F.lit(seed), "ids"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector", "ids") \
        .mapInArrow(placed(False), "vector array<double>, ids array<long>, place array<double>").select("place").limit(2 * SAMPLE).collect()
    tree = Tree(np.array([r[0] for r in sample]).reshape(len(sample), dims), depth)
    shared = spark.sparkContext.broadcast(tree)

    def in_cells(batches):
        for b in placed(False)(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.cell(_matrix(b.column(2))))], names=[*b.schema.names, "cell"])

    rows = stored(one.select("vector", "ids").mapInArrow(in_cells, "vector array<double>, ids array<long>, place array<double>, cell long"), "cells")
    boxes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.get("place", F.lit(i))).alias(f"lo{i}") for i in range(dims)],
                                     *[F.max(F.get("place", F.lit(i))).alias(f"hi{i}") for i in range(dims)]).collect()
    cells = np.array([r["cell"] for r in boxes])
    chunks = {r["cell"]: -(-r["n"] // TASK_ROWS) for r in boxes}
    lo = np.array([[r[f"lo{i}"] for i in range(dims)] for r in boxes])
    hi = np.array([[r[f"hi{i}"] for i in range(dims)] for r in boxes])
    chi2 = chi_square_quantile(confidence, dims)
    queries = good.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")).select("vector", "query_id")

    def visits_of(home: bool):
        """(query, cell) rows; home: the own cell, without a bound; else the other cells within reach."""
        def visit(batches):
            step = max(1, REACH_AT_ONCE // max(1, lo.size))
            for b in (b.slice(i, step) for b in placed(True)(batches) for i in range(0, b.num_rows, step)):
                p = _matrix(b.column(b.schema.names.index("place")))
                mine = shared.value.cell(p)
                reach = (np.maximum(np.maximum(lo - p[:, None], p[:, None] - hi), 0) ** 2).sum(axis=2)
                if home:  # the own cell or, where it has no rows, the nearest box
                    reach[cells[None, :] == mine[:, None]] = -1
                    q, c = np.arange(len(p)), reach.argmin(axis=1)
                    bound = np.full(len(p), np.inf)
                else:
                    bound = b.column(b.schema.names.index("bound")).to_numpy()
                    seen = b.column(b.schema.names.index("cell")).to_numpy()
                    q, c = np.nonzero((reach <= chi2 * bound[:, None]) & (cells[None, :] != seen[:, None]))
                    bound = bound[q]
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(b.schema.names.index("place")).take(at),
                                                  pa.array(bound), pa.array(cells[c])], names=["vector", "query_id", "place", "bound", "cell"])
        return visit

    shape = "vector array<double>, query_id long, place array<double>, bound double, cell long"

    def searched(visits: DataFrame) -> DataFrame:
        per = {r[0]: -(-r[1] // TASK_QUERIES) for r in visits.groupBy("cell").count().collect()}
        if not per:
            return spark.createDataFrame([], "query_id long, vec_id long, score double, base double")
        plan = spark.createDataFrame([(int(c), int(chunks[c]), int(p)) for c, p in per.items()], "cell long, chunks int, parts int")
        left = rows.join(F.broadcast(plan), "cell").select("vector", "ids", "place", "cell", F.pmod(F.xxhash64("ids"), F.col("chunks").cast("long")).alias("chunk"),
                                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = visits.join(F.broadcast(plan), "cell").select("vector", "query_id", "place", "bound", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"),
                                                              F.pmod(F.xxhash64("query_id"), F.col("parts").cast("long")).cast("int").alias("part"))
        by = ["cell", "chunk", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k, chi2, norm2), "query_id long, vec_id long, score double, base double")

    home = stored(queries.mapInArrow(visits_of(True), shape), "home")
    near = stored(searched(home), "near")
    # the k-th score so far bounds the distance; without k candidates nothing does
    bound = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"), F.max("base").alias("base")).select(
        "query_id", F.when(F.size("s") >= k, F.greatest(F.col("base") - 2 * F.get("s", F.lit(k - 1)), F.lit(0.0)) * (1 + 1e-12) + 1e-12).alias("_bound"))
    more = home.drop("bound", "place").join(bound, "query_id", "left").select(
        "vector", "query_id", "cell", F.coalesce("_bound", F.lit(float("inf"))).alias("bound"))
    more = stored(more.mapInArrow(visits_of(False), shape), "visits")
    every_one = near.unionByName(searched(more))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
