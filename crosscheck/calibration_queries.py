"""Yield calibration on the admin pixel table, against planted parameters and closed forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.util import rounded
from seasonlens.operators import calibration as CA

PLANTED = (0.3, 1.1, 0.6, 0.09, 0.5)
YM_SQL = "(3 + (ascii(aez) + 2 * length(aez)) % 8 * 5e-1)"
X_SQL = """SELECT px_id, county, constituency, aez, (wrsi_veg % 50) / 1e2 AS d_veg, (wrsi_flo % 40) / 1e2 AS d_flo, (wrsi_grf % 60) / 1e2 AS d_grf,
           (s_heat % 24) / 4e0 AS hot, (s_veg % 101) / 1e2 AS short FROM v_pixels"""


def share_sql(w) -> str:
    return (f"(1 - least(d_veg * {w[0]}::DOUBLE + d_flo * {w[1]}::DOUBLE + d_grf * {w[2]}::DOUBLE, 1)) "
            f"* (1 - least(hot * {w[3]}::DOUBLE, 1)) * (1 - least(short * {w[4]}::DOUBLE, 1))")


# observed yields that depart from the model by up to three per cent, and Ym for the standing weights
OBSERVED = f"o AS (SELECT *, {YM_SQL} * {share_sql(PLANTED)} * (1 + (px_id % 7 - 3) / 1e2) AS y, {share_sql(CA.START)} AS r FROM ({X_SQL}))"
YM_FIT = "m AS (SELECT aez, sum(r * y) / sum(r * r) AS ym FROM o GROUP BY aez)"


def observed(spark, sf, noise: bool):
    x = I.pixels(spark, sf).select(
        "px_id", "county", "constituency", "aez", ((F.col("wrsi_veg") % 50) / 100).alias("d_veg"), ((F.col("wrsi_flo") % 40) / 100).alias("d_flo"),
        ((F.col("wrsi_grf") % 60) / 100).alias("d_grf"), ((F.col("s_heat") % 24) / 4).alias("hot"), ((F.col("s_veg") % 101) / 100).alias("short"))
    share, _ = CA.relative_yield(lambda k: F.lit(PLANTED[k]))
    ym = 3 + (F.ascii("aez") + 2 * F.length("aez")) % 8 * 0.5
    return x.withColumn("yield_obs", ym * share * ((1 + (F.col("px_id") % 7 - 3) / 100) if noise else F.lit(1.0)))


@query("cpi3_calibrated_potential", f"""
    SELECT aez, CAST({YM_SQL} AS DOUBLE) AS ym, {', '.join(f'{w}::DOUBLE AS w_{n}' for w, n in zip(PLANTED, CA.FEATURES))} FROM (SELECT DISTINCT aez FROM v_pixels)""")
def _(spark, sf):
    """Ym and weights fitted to yields that the planted ones made."""
    fit = CA.calibrate(observed(spark, sf, False), ["aez"])
    w = [F.lit(round(float(v), 4)).alias(f"w_{n}") for v, n in zip(fit.weights[0], CA.FEATURES)]
    return fit.ym.select("aez", F.round("ym", 4).alias("ym"), *w)


@query("cpi3_potential_by_zone", f"WITH {OBSERVED}, {YM_FIT} SELECT aez, round(ym, 6) AS ym FROM m")
def _(spark, sf):
    return rounded(CA.calibrate(observed(spark, sf, True), ["aez"], steps=0).ym.drop("fit"), "ym")


def level_sql(name: str, keys: str) -> str:
    return f"""SELECT '{name}' AS level, count(*) AS n, round(avg(e), 6) AS bias_tha, round(sqrt(avg(e * e)), 6) AS rmse_tha
               FROM (SELECT avg(ym * r) - avg(y) AS e FROM o JOIN m USING (aez) GROUP BY {keys})"""


@query("cpi3_yield_errors", f"WITH {OBSERVED}, {YM_FIT} {level_sql('county', 'county')} UNION ALL {level_sql('constituency', 'county, constituency')}")
def _(spark, sf):
    """Bias and RMSE per admin level with the standing weights."""
    df = observed(spark, sf, True)
    e = CA.estimate(df, CA.calibrate(df, ["aez"], steps=0), ["aez"])
    return rounded(CA.yield_errors(e, {"county": ["county"], "constituency": ["county", "constituency"]}), "bias_tha", "rmse_tha")
