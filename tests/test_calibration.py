import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlens.operators import calibration as CA

TRUE = (0.3, 1.1, 0.6, 0.09, 0.5)
YM = {("UM", "early"): 4.0, ("UM", "late"): 6.5, ("LM", "early"): 3.2}
SCHEMA = "zone string, variety string, ward string, year int, d_veg double, d_flo double, d_grf double, hot double, short double, yield_obs double"


def share(w, x):
    clip = lambda v: min(max(v, 0.0), 1.0)
    return (1 - clip(sum(a * b for a, b in zip(w[:3], x[:3])))) * (1 - clip(w[3] * x[3])) * (1 - clip(w[4] * x[4]))


def rows(noise=0.0, n=40, seasons=5, seed=1):
    rng = random.Random(seed)
    out = []
    for z, v in YM:
        for ward in range(n):
            for year in range(seasons):
                x = [rng.random() * 0.5 for _ in range(3)] + [rng.random() * 6, rng.random()]
                out.append((z, v, f"{z}-{v}-{ward}", year, *x, YM[z, v] * share(TRUE, x) + rng.gauss(0, noise)))
    return out


def test_planted_parameters_are_recovered(spark):
    fit = CA.calibrate(spark.createDataFrame(rows(), SCHEMA), ["zone", "variety"])
    assert np.allclose(fit.weights[0], TRUE, atol=1e-5)
    assert {(r.zone, r.variety): round(r.ym, 5) for r in fit.ym.collect()} == YM


def test_held_out_units(spark):
    df = spark.createDataFrame(rows(noise=0.2), SCHEMA)
    group, unit = ["zone", "variety"], ["ward"]
    fit = CA.calibrate(df, group, unit, folds=3)
    assert fit.weights.shape == (4, 5) and np.abs(fit.weights - TRUE).max() < 0.25
    fold = CA.fold_of(unit, 3)
    # a fit without a fold does not change with that fold's yields
    spoiled = df.withColumn("yield_obs", F.when(fold == 2, F.lit(99.0)).otherwise(F.col("yield_obs")))
    again = CA.calibrate(spoiled, group, unit, folds=3)
    assert np.allclose(again.weights[2], fit.weights[2], atol=1e-6)
    out = CA.estimate(df, fit, group, fold)
    err = {r.level: r for r in CA.yield_errors(out, {"season": ["ward", "year"], "ward": ["ward"], "zone": ["zone"]}).collect()}
    assert err["season"].n == 600 and err["ward"].n == 120 and err["zone"].n == 2
    assert 0.17 < err["season"].rmse_tha < 0.23 and err["zone"].rmse_tha < err["ward"].rmse_tha < err["season"].rmse_tha
    assert abs(err["season"].bias_tha) < 0.05
    # the fixed starting weights, with Ym fitted, are worse
    plain = CA.estimate(df, CA.calibrate(df, group, steps=0), group)
    assert CA.yield_errors(plain, {"season": ["ward", "year"]}).first().rmse_tha > err["season"].rmse_tha


def test_step_is_the_dense_solution(spark):
    """Normal equations with Ym eliminated against the whole Jacobian."""
    data = rows(noise=0.3, n=8, seasons=3, seed=4)
    df = spark.createDataFrame(data, SCHEMA).withColumn("_fit", F.lit(0))
    w = np.array([CA.START])
    a, b, sse = CA._equations(CA._moments(df, ["zone", "variety"], w), 1)
    groups = sorted(YM)
    r = np.array([share(w[0], x[4:9]) for x in data])
    y = np.array([x[9] for x in data])
    g = np.array([groups.index(x[:2]) for x in data])
    ym = np.array([(r * y)[g == i].sum() / (r * r)[g == i].sum() for i in range(3)])
    eps = 1e-6
    slope = np.array([[(share(w[0] + eps * np.eye(5)[k], x[4:9]) - share(w[0] - eps * np.eye(5)[k], x[4:9])) / 2 / eps for k in range(5)] for x in data])
    jac = np.hstack([np.where(g[:, None] == np.arange(3), r[:, None], 0.0), ym[g][:, None] * slope])
    e = y - ym[g] * r
    dense = np.linalg.lstsq(jac, e, rcond=None)[0][3:]
    assert np.allclose(np.linalg.solve(a[0], b[0]), dense, atol=1e-4) and sse[0] == pytest.approx((e * e).sum())


def test_nulls_dead_features_and_empty(spark):
    data = [(*r[:7], 0.0, *r[8:]) for r in rows(n=6)] + [("UM", "early", "w", 1, None, 0.1, 0.1, 0.0, 0.0, 5.0), ("XX", None, "w", 1, 0.1, 0.1, 0.1, 0.0, 0.1, None)]
    fit = CA.calibrate(spark.createDataFrame(data, SCHEMA), ["zone", "variety"])
    assert fit.weights[0][3] == CA.START[3] and fit.ym.count() == 3
    none = CA.calibrate(spark.createDataFrame([], SCHEMA), ["zone", "variety"])
    assert np.allclose(none.weights[0], CA.START) and none.ym.count() == 0


def test_weights_do_not_go_below_zero(spark):
    rng = random.Random(3)
    data = []
    for i in range(200):
        x = [rng.random() * 0.3, 0.1, 0.1, 0.5, 0.2]
        data.append(("UM", "early", f"w{i}", 1, *x, 4.0 * (0.5 + x[0])))  # more deficit, more yield
    fit = CA.calibrate(spark.createDataFrame(data, SCHEMA), ["zone", "variety"])
    assert (fit.weights >= 0).all() and fit.weights[0][0] == 0
