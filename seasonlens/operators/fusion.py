"""Unbiased two-date spatiotemporal fusion of a sparse fine series with a dense coarse one."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seasonlens.functions.masks import clamp, unit_scale, unmask
from seasonlens.operators.observations import optical_greenness, radar_greenness
from seasonlens.operators.spatial import focal_mean

CELL = ("px_id", "row", "col")


def base_pairs(sos_start: int, sos_end: int, step: int = 2, pad: int = 1) -> list[tuple[int, int, int]]:
    """(target, earlier base, later base) for each dekad of the padded window (at most 36 rows)."""
    lo, hi = max(1, sos_start - pad), min(36, sos_end + pad)
    bases = sorted({*range(lo, hi + 1, step), hi})
    return [(d, max(b for b in bases if b <= d), min(b for b in bases if b >= d)) for d in range(lo, hi + 1)]


def base_pair_table(spark: SparkSession, sos_start: int, sos_end: int, step: int = 2, pad: int = 1) -> DataFrame:
    return spark.createDataFrame(base_pairs(sos_start, sos_end, step, pad), "dekad int, b0 int, b1 int")


def local_slope(cells: DataFrame, radius: int, keys: Sequence[str], dense: bool = False) -> DataFrame:
    """Moving-window slope of fine on coarse, cov(f, c) / var(c), clamped; four bands in one pass."""
    rows = cells.withColumns({"_fc": F.col("f") * F.col("c"), "_cc": F.col("c") * F.col("c")})
    m = focal_mean(rows, ["f", "c", "_fc", "_cc"], radius, keys, dense)
    cov = F.col("_fc_fm") - F.col("f_fm") * F.col("c_fm")
    var = F.greatest(F.col("_cc_fm") - F.col("c_fm") * F.col("c_fm"), F.lit(1e-6))
    return m.select(*cells.columns, clamp(cov / var, 0.1, 5.0).alias("v"))


def predict_unbiased(pairs: DataFrame, radius: int, keys: Sequence[str], dense: bool = False) -> DataFrame:
    """f0 + v (ct - c0), plus the coarse residual of its own focal mean.  Adds ``pred``."""
    raw = pairs.withColumn("_raw", F.col("f0") + F.col("v") * (F.col("ct") - F.col("c0")))
    m = focal_mean(raw, ["_raw"], radius, keys, dense)
    return m.withColumn("pred", F.col("_raw") + (F.col("ct") - F.col("_raw_fm"))).drop("_raw", "_raw_fm")


def blend_pairs(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine the predictions of one target, weighted by inverse coarse change; a masked member
    masks the blend."""
    w = 1 / (F.abs(F.col("ct") - F.col("c0")) + 1e-3)
    whole = F.count(F.col("pred") * w) == F.count(F.lit(1))
    return preds.groupBy(*keys).agg(F.when(whole, F.sum(F.col("pred") * w) / F.sum(w)).alias("g"))


def fused_series(
    spark: SparkSession, fine: DataFrame, coarse: DataFrame, sos_start: int, sos_end: int,
    radius: int = 10, fine_m: float = 250.0, coarse_m: float = 500.0, dense: bool = False,
) -> DataFrame:
    """Gap-free greenness for every dekad of the padded window.

    fine: px_id, row, col, dekad, f (NULL in gaps); coarse: px_id, dekad, c on the fine grid.
    Both predictions of a target run through one stacked focal pass.
    """
    dim = base_pair_table(spark, sos_start, sos_end)
    targets = dim.select(
        "dekad", F.explode(F.array_distinct(F.array("b0", "b1"))).alias("base"))  # at most 72 rows
    used = F.col("dekad").between(max(1, sos_start - 1), min(36, sos_end + 1))
    fine, coarse = fine.filter(used), coarse.filter(used)
    cells = coarse.join(fine.select(*CELL, "dekad", "f"), ["px_id", "dekad"])
    bases = local_slope(
        cells.join(F.broadcast(targets.select(F.col("base").alias("dekad")).distinct()), "dekad")
        .select(*CELL, F.col("dekad").alias("base"), unmask("f", F.col("c")).alias("f"), "c"),
        radius, ("base",), dense,
    ).select(*CELL, "base", F.col("f").alias("f0"), F.col("c").alias("c0"), "v")
    now = coarse.select("px_id", "dekad", F.col("c").alias("ct")).join(F.broadcast(targets), "dekad")
    pairs = bases.join(now, ["px_id", "base"])
    r = max(1, round(coarse_m / fine_m))
    preds = predict_unbiased(pairs, r, ("dekad", "base"), dense)
    return blend_pairs(preds, (*CELL, "dekad")).withColumn("g", clamp("g", -0.2, 1.0))


def calibrated_fill(
    series: DataFrame, keys: Sequence[str] = ("px_id",), calibrate: bool = True
) -> DataFrame:
    """Fallback chain optical -> fused (moment-matched into red-edge space) -> radar.

    series: keys, dekad, ndre1, fpar, rvi, g (fused).  The moments are a window over a pixel's
    few dozen dekads, so the series is evaluated once.
    """
    w = Window.partitionBy(*keys)
    series = series.withColumns({
        "_mn": F.avg("ndre1").over(w), "_sn": F.stddev_pop("ndre1").over(w),
        "_me": F.avg("g").over(w), "_se": F.greatest(F.stddev_pop("g").over(w), F.lit(1e-3))})
    if calibrate:
        est = unit_scale(F.col("_mn") + (F.col("g") - F.col("_me")) * (F.col("_sn") / F.col("_se")), 0.0, 0.7)
    else:
        est = unit_scale("g", 0.0, 0.9)
    return series.select(
        *keys, "dekad", F.coalesce(optical_greenness(), est, radar_greenness()).alias("g"))
