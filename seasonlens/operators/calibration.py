"""Yield calibration: potential yields and stress weights fitted to observed yields, with held-out units.

Model: yield = Ym(group) x (1 - sum Ky d) x (1 - heat_k hot) x (1 - veg_w short), each factor kept within 0..1; ``d_veg``, ``d_flo``, ``d_grf``
are stage deficits, ``hot`` the degree-dekads over the cap, ``short`` the canopy shortfall, all of one observed unit and
season.  The weights are shared; Ym is one number per group (zone and variety).
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seasonlens import config as C
from seasonlens.functions.masks import clamp
from seasonlens.sources.tables import new_path

FEATURES = ("d_veg", "d_flo", "d_grf", "hot", "short")
START = (C.KY["veg"], C.KY["flo"], C.KY["grf"], C.HEAT_LOSS, C.VEG_WEIGHT)


@dataclass(frozen=True)
class Calibration:
    """``weights[i]``: the weights of fit i, in the order of FEATURES.  Fit 0 reads every unit, fit i > 0 leaves fold i out.
    ``ym``: fit, group columns, ym."""

    weights: np.ndarray
    ym: DataFrame
    steps: int


def _weight(weights: np.ndarray, k: int) -> Column:
    return F.array(*[F.lit(float(w)) for w in weights[:, k]])[F.col("_fit")]


def relative_yield(weight) -> tuple[Column, list[Column]]:
    """Yield as a share of Ym, and its derivatives by the weights (0 where a factor stands at its bound)."""
    losses = ([0, 1, 2], [3], [4])
    load = [sum((weight(k) * F.col(FEATURES[k]) for k in ks), F.lit(0.0)) for ks in losses]
    factor = [1 - clamp(x, 0.0, 1.0) for x in load]
    slope = []
    for i, ks in enumerate(losses):
        rest = [f for j, f in enumerate(factor) if j != i]
        free = load[i].between(0.0, 1.0).cast("double")
        slope += [-F.col(FEATURES[k]) * free * rest[0] * rest[1] for k in ks]
    return factor[0] * factor[1] * factor[2], slope


def fold_of(unit: Sequence[str], folds: int) -> Column:
    """Fold 1..folds of a unit: all its seasons are held out together."""
    return (F.pmod(F.xxhash64(*unit), F.lit(folds)) + 1).cast("int")


def _moments(rows: DataFrame, group: Sequence[str], weights: np.ndarray) -> DataFrame:
    """Sums of a fit and group from which its Ym and its part of the normal equations follow.  They combine
    map-side: a group with most of the rows costs what a small one costs."""
    r, slope = relative_yield(lambda k: _weight(weights, k))
    n = len(FEATURES)
    x = rows.withColumns({"_r": r} | {f"_j{k}": s for k, s in enumerate(slope)})
    j = [F.col(f"_j{k}") for k in range(n)]
    return x.groupBy("_fit", *group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("rr"), F.sum(F.col("_r") * F.col("yield_obs")).alias("ry"),
        F.sum(F.col("yield_obs") * F.col("yield_obs")).alias("yy"),
        *[F.sum(j[k] * F.col("_r")).alias(f"jr{k}") for k in range(n)], *[F.sum(j[k] * F.col("yield_obs")).alias(f"jy{k}") for k in range(n)],
        *[F.sum(j[k] * j[m]).alias(f"jj{k}{m}") for k in range(n) for m in range(k, n)],
    ).withColumn("ym", F.try_divide("ry", "rr"))


def _equations(moments: DataFrame, fits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per fit: matrix and right side for the weights once every group's Ym is eliminated, and the squared error.
    One row per fit reaches the driver, whatever the number of groups."""
    n, ym = len(FEATURES), F.col("ym")
    pair = [(k, m) for k in range(n) for m in range(k, n)]
    lhs = [F.sum(ym * ym * (F.col(f"jj{k}{m}") - F.try_divide(F.col(f"jr{k}") * F.col(f"jr{m}"), F.col("rr")))).alias(f"a{k}{m}") for k, m in pair]
    rhs = [F.sum(ym * (F.col(f"jy{k}") - ym * F.col(f"jr{k}"))).alias(f"b{k}") for k in range(n)]
    sse = F.sum(F.col("yy") - F.coalesce(ym * F.col("ry"), F.lit(0.0))).alias("sse")
    a, b, s = np.zeros((fits, n, n)), np.zeros((fits, n)), np.zeros(fits)
    for row in moments.groupBy("_fit").agg(*lhs, *rhs, sse).collect():
        for k, m in pair:
            a[row._fit, k, m] = a[row._fit, m, k] = row[f"a{k}{m}"] or 0.0
        b[row._fit] = [row[f"b{k}"] or 0.0 for k in range(n)]
        s[row._fit] = row.sse
    return a, b, s


def calibrate(observed: DataFrame, group: Sequence[str], unit: Sequence[str] = (), folds: int = 0, steps: int = 20,
              start: Sequence[float] = START, tol: float = 1e-7) -> Calibration:
    """Damped least squares: a step is one grouped aggregate over the observations, for all fits at once.

    observed: the FEATURES, ``yield_obs`` and the columns of ``group`` and ``unit``.  Rows with a NULL among them take no part.  With
    ``folds`` every unit is left out of one fit.  Weights stay at 0 or above; a step that raises a fit's error is taken
    back and damped.  A weight whose feature is 0 throughout keeps its start.  ``steps=0`` fits Ym alone.
    """
    fits = folds + 1
    used = observed.select(*dict.fromkeys([*group, *unit]), "yield_obs", *FEATURES).dropna(subset=["yield_obs", *FEATURES])
    if steps:  # every step reads the observations again: keep the few columns in the shared folder
        path = new_path(used.sparkSession, "observed")
        used.write.parquet(path)
        used = used.sparkSession.read.parquet(path)
    rows = used.withColumn("_fit", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(folds)), lambda i: i != fold_of(unit, folds)))) if folds else used.withColumn("_fit", F.lit(0))
    weights = np.tile(np.asarray(start, dtype=float), (fits, 1))
    if steps == 0:
        return Calibration(weights, _ym(rows, group, weights), 0)
    a, b, best = _equations(_moments(rows, group, weights), fits)
    damp, done = np.full(fits, 1e-3), np.zeros(fits, dtype=bool)
    for step in range(1, steps + 1):
        move = np.zeros_like(weights)
        for i in np.flatnonzero(~done):
            d = np.diag(a[i])
            live = d > 1e-12 * max(d.max(), 1e-300)
            # a weight at 0 that would go below stays there
            live &= ~((weights[i] <= 0) & (b[i] < 0))
            if live.any():
                sub = np.ix_(live, live)
                move[i, live] = np.linalg.solve(a[i][sub] + damp[i] * np.diag(d[live]), b[i][live])
        tried = np.maximum(weights + move, 0.0)
        ta, tb, sse = _equations(_moments(rows, group, tried), fits)
        better = (sse <= best) & ~done
        small = np.abs(tried - weights).max(axis=1) < tol
        weights[better], a[better], b[better], best[better] = tried[better], ta[better], tb[better], sse[better]
        damp = np.where(better, damp / 10, damp * 10)
        done |= small | (damp > 1e8)
        if done.all():
            break
    return Calibration(weights, _ym(rows, group, weights), step)


def _ym(rows: DataFrame, group: Sequence[str], weights: np.ndarray) -> DataFrame:
    r, _ = relative_yield(lambda k: _weight(weights, k))
    return rows.groupBy(F.col("_fit").alias("fit"), *group).agg(F.try_divide(F.sum(r * F.col("yield_obs")), F.sum(r * r)).alias("ym"))


def estimate(rows: DataFrame, fitted: Calibration, group: Sequence[str], fit: int | Column = 0) -> DataFrame:
    """Add ``yield_tha`` from a fit (a number, or a column such as ``fold_of``: the fit that has not seen the unit).  NULL for a group
    that the fit does not know or whose key holds a NULL."""
    at = rows.withColumn("_fit", F.lit(fit) if isinstance(fit, int) else fit)
    r, _ = relative_yield(lambda k: _weight(fitted.weights, k))
    ym = fitted.ym.withColumnRenamed("fit", "_fit")
    return at.join(ym, ["_fit", *group], "left").withColumn("yield_tha", F.col("ym") * r).drop("_fit", "ym")


def yield_errors(estimates: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Observations, bias and RMSE of the units of each level (means of estimate and observation by unit, then errors)."""
    ok = estimates.filter(F.col("yield_tha").isNotNull() & F.col("yield_obs").isNotNull())
    out = None
    for level, keys in levels.items():
        units = ok.groupBy(*keys).agg(F.avg("yield_tha").alias("_e"), F.avg("yield_obs").alias("_o"))
        d = F.col("_e") - F.col("_o")
        one = units.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias_tha"), F.sqrt(F.avg(d * d)).alias("rmse_tha"))
        out = one if out is None else out.unionByName(one)
    return out
