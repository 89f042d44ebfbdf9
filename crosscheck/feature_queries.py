"""Optical, radar, canopy and fused-greenness operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.util import r6, rounded
from crosscheck.views import dk
from seasonlens.operators import observations as OB
from seasonlens.functions.masks import keep_if, nmin, self_mask, unmask
from seasonlens.operators.frames import dekad_spine, dekadal, densify
from seasonlens.operators.spatial import focal_mean_circle

NAMES = "ndvi evi2 ndre1 ndre2 rendvi cire"


@query("opt1_cloud_mask", """
    SELECT px_id, count(*) AS n, count(CASE WHEN cs_cdf >= 6e-1 THEN 1 END) AS clear,
           round(sum(CASE WHEN cs_cdf >= 6e-1 THEN b8 / 1e4 END), 6) AS b8, round(sum(CASE WHEN cs_cdf >= 6e-1 THEN b12 / 1e4 END), 6) AS b12
    FROM v_optical GROUP BY ALL""")
def _(spark, sf):
    return OB.cloud_mask(I.optical(spark, sf)).groupBy("px_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("b4").alias("clear"), F.round(F.sum("b8"), 6).alias("b8"), F.round(F.sum("b12"), 6).alias("b12"))


@query("opt2_normalised_differences", f"SELECT px_id, d, {r6('ndvi ndre1 ndre2 rendvi')} FROM v_indices")
def _(spark, sf):
    x = OB.optical_indices(OB.cloud_mask(I.optical(spark, sf))).filter(F.col("b4").isNotNull())
    return rounded(x.select("px_id", "d", "ndvi", "ndre1", "ndre2", "rendvi"), "ndvi", "ndre1", "ndre2", "rendvi")


@query("opt3_evi2_cire", f"SELECT px_id, d, {r6('evi2 cire')} FROM v_indices")
def _(spark, sf):
    x = OB.optical_indices(OB.cloud_mask(I.optical(spark, sf))).filter(F.col("b4").isNotNull())
    return rounded(x.select("px_id", "d", "evi2", "cire"), "evi2", "cire")


@query("opt4_median_composite", f"""
    SELECT px_id, year, dekad, {r6(NAMES)} FROM v_dekad_spine LEFT JOIN v_s2 USING (px_id, year, dekad)""")
def _(spark, sf):
    full = densify(I.s2(spark, sf), dekad_spine(I.grid(spark, sf), I.YEARS), ["px_id", "year", "dekad"])
    return rounded(full, *NAMES.split())


@query("sar1_db_linear", """
    SELECT px_id, d, round(pow(1e1, vv_db/1e1), 8) AS vv, round(pow(1e1, vh_db/1e1), 8) AS vh, round(vv_db, 6) AS vv_db, round(vh_db, 6) AS vh_db FROM v_sar""")
def _(spark, sf):
    x = OB.radar_features(I.sar(spark, sf))
    return rounded(rounded(x.select("px_id", "d", "vv", "vh", "vv_db", "vh_db"), "vv", "vh", n=8), "vv_db", "vh_db")


@query("sar2_speckle_filter", """
    SELECT t.row, t.col, round(avg(s.vv), 8) AS vv_fm, round(avg(s.vh), 8) AS vh_fm FROM v_cells t
    JOIN (SELECT l_partkey // 64 AS row, l_partkey % 64 AS col, avg(pow(1e1, (-14e0 + (l_quantity % 16) * 25e-2)/1e1)) AS vv,
                 avg(pow(1e1, (-28e0 + (l_quantity % 16) * 25e-2)/1e1)) AS vh FROM lineitem GROUP BY ALL) s
      ON (s.row - t.row)*(s.row - t.row) + (s.col - t.col)*(s.col - t.col) <= 9
    GROUP BY ALL""")
def _(spark, sf):
    q, k = F.col("l_quantity") % 16 * 0.25, F.col("l_partkey")
    img = I.table(spark, sf, "lineitem").groupBy(
        F.floor(k / 64).cast("int").alias("row"), (k % 64).cast("int").alias("col")).agg(
        F.avg(OB.to_linear(q - 14.0)).alias("vv"), F.avg(OB.to_linear(q - 28.0)).alias("vh"))
    scene = I.cells(spark, sf).select("row", "col").join(img, ["row", "col"], "left")
    m = focal_mean_circle(scene, ["vv", "vh"], 30.0, 10.0)
    return rounded(m.select("row", "col", "vv_fm", "vh_fm"), "vv_fm", "vh_fm", n=8)


@query("sar3_ratio_rvi", """
    SELECT px_id, d, round(vh / vv, 6) AS vh_vv, round(4*vh/(vv+vh), 6) AS rvi
    FROM (SELECT px_id, d, pow(1e1, vv_db/1e1) AS vv, pow(1e1, vh_db/1e1) AS vh FROM v_sar)""")
def _(spark, sf):
    return rounded(OB.radar_features(I.sar(spark, sf)).select("px_id", "d", "vh_vv", "rvi"), "vh_vv", "rvi")


@query("sar4_mean_composite", f"SELECT px_id, year, dekad, round(vv, 8) AS vv, round(vh, 8) AS vh, {r6('vh_vv rvi')} FROM v_s1")
def _(spark, sf):
    return rounded(rounded(I.s1(spark, sf), "vv", "vh", n=8), "vh_vv", "rvi")


@query("fpar1_mean_composite", f"SELECT px_id, year, dekad, {r6('fpar')} FROM v_fpar")
def _(spark, sf):
    return rounded(I.fpar(spark, sf), "fpar")


@query("coarse1_ndvi", f"""
    SELECT px_id, year(d) AS year, {dk('d')} AS dekad, round(avg((nir - red) / greatest(nir + red, 1e-6)), 6) AS c
    FROM (SELECT px_id, d, b8 / 1e4 AS nir, b4 / 1e4 AS red FROM v_optical) GROUP BY ALL""")
def _(spark, sf):
    obs = I.optical(spark, sf).select("px_id", "d", (F.col("b8") / 1e4).alias("nir"), (F.col("b4") / 1e4).alias("red"))
    return rounded(dekadal(OB.coarse_ndvi(obs), [F.avg("c").alias("c")]), "c")


@query("fuse1_unit_scale", """
    SELECT px_id, year, dekad, round(least(greatest((rvi - 1e-1) / 7e-1, 0), 1), 6) AS sar_g FROM v_s1 WHERE rvi IS NOT NULL
    UNION ALL SELECT px_id, year, dekad, NULL FROM v_s1 WHERE rvi IS NULL""")
def _(spark, sf):
    return I.s1(spark, sf).select("px_id", "year", "dekad", F.round(OB.radar_greenness(), 6).alias("sar_g"))


@query("fuse2_fused_greenness", f"SELECT px_id, year, dekad, {r6('g')} FROM v_g")
def _(spark, sf):
    return rounded(I.greenness(spark, sf), "g")


@query("fuse3_canopy_condition", """
    SELECT px_id, year, round(least(greatest(max(g) * 100, 0), 100), 6) AS fcci FROM v_g
    WHERE dekad BETWEEN 7 AND 27 AND px_id IN (SELECT px_id FROM v_mask WHERE product = 'maize' AND classification = 100) GROUP BY ALL""")
def _(spark, sf):
    g = OB.masked_to(I.greenness(spark, sf), OB.crop_pixels(I.crop_mask(spark, sf), "maize"))
    return rounded(OB.canopy_condition(g, 7, 15), "fcci")


@query("mask1_crop_mask", """
    SELECT px_id, year, dekad, p FROM v_rain WHERE px_id IN (SELECT px_id FROM v_mask WHERE product = 'temporarycrops' AND classification = 100)""")
def _(spark, sf):
    return OB.masked_to(I.rain(spark, sf), OB.crop_pixels(I.crop_mask(spark, sf), "teff"))


@query("mask2_mask_algebra", """
    SELECT px_id, nullif(waterlog_idx, 0) AS self_masked, CASE WHEN planting IS NOT NULL THEN wrsi END AS updated,
           coalesce(planting, 0) AS unmasked, CASE WHEN planting IS NULL OR lvpd IS NULL THEN NULL ELSE least(planting, lvpd) END AS lower FROM v_pixels""")
def _(spark, sf):
    return I.pixels(spark, sf).select(
        "px_id", self_mask("waterlog_idx").alias("self_masked"), keep_if("wrsi", F.col("planting").isNotNull()).alias("updated"),
        unmask("planting", 0).alias("unmasked"), nmin("planting", "lvpd").alias("lower"))


@query("stat6_temporal_zscore", """
    SELECT px_id, year, dekad, round((p - m) / greatest(s, 1e-4), 6) AS p_z FROM v_rain
    JOIN (SELECT px_id, avg(p) AS m, stddev_pop(p) AS s FROM v_rain GROUP BY ALL) USING (px_id)""")
def _(spark, sf):
    return rounded(OB.temporal_zscore(I.rain(spark, sf), "p").drop("p"), "p_z")
