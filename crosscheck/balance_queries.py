"""Evapotranspiration, soil, water balance, thermal clock, agro-ecology."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.balance_sql import balance_sql, staged_sql, stepwise_sql
from crosscheck.onset_queries import FALLBACK_SQL, short_onset
from crosscheck.registry import query
from crosscheck.source_queries import TEXTURE_SQL, WHC_SQL
from crosscheck.util import r6, rounded
from crosscheck.views import kc, ra, start, wrsi_class
from seasonlens.config import MAIZE, MAIZE_EARLY, SoilConfig
from seasonlens.functions import classes as CL, climate as CM, dekads as D
from seasonlens.operators import balance as B, onset as O, soil as SO

PLANT = "SELECT px_id, year, onset AS planting FROM v_onset"


@query("et1_radiation", f"SELECT px_id, dekad, round({ra('lat', 'dayofyear(' + start('1999', 'dekad') + ') + 5')}, 6) AS ra FROM v_grid, (SELECT unnest(range(1, 37)) AS dekad)")
def _(spark, sf):
    g = I.grid(spark, sf).select("px_id", "lat", F.explode(F.sequence(F.lit(1), F.lit(36))).alias("dekad"))
    return g.select("px_id", "dekad", F.round(CM.extraterrestrial_radiation("lat", F.dayofyear(D.dekad_start(F.lit(1999), "dekad")) + 5), 6).alias("ra"))


@query("et2_reference_et", "SELECT px_id, year, dekad, round(et0, 6) AS et0 FROM v_climate")
def _(spark, sf):
    return I.climate(spark, sf).select("px_id", "year", "dekad", F.round("et0", 6).alias("et0"))


@query("kc1_crop_coefficient", f"SELECT o_orderkey, o_orderkey % 16 - 2 AS dsp, round({kc('(o_orderkey % 16 - 2)', MAIZE)}, 6) AS kc FROM orders")
def _(spark, sf):
    dsp = F.col("o_orderkey") % 16 - 2
    return I.table(spark, sf, "orders").select("o_orderkey", dsp.alias("dsp"), F.round(CM.crop_coefficient(dsp, MAIZE), 6).alias("kc"))


# ---- soil ------------------------------------------------------------------------------------
@query("soil1_retention", f"SELECT px_id, top_cm, {r6('fc wp')} FROM ({TEXTURE_SQL})")
def _(spark, sf):
    return rounded(SO.with_texture(I.soil_layers(spark, sf)).select("px_id", "top_cm", "fc", "wp"), "fc", "wp")


SAT = "(fc + (st + (636e-3*st - 107e-3)) - 97e-3*sa + 43e-3)"
KSAT = f"greatest(1930e0 * pow(greatest({SAT} - fc, 1e-4), 3 - greatest(ln(fc) - ln(wp), 1e-4) / (ln(1500e0) - ln(33e0))), 1e-3)"


@query("soil2_saturation_conductivity", f"SELECT px_id, top_cm, round(least(greatest({SAT}, 3e-1), 75e-2), 6) AS sat, round({KSAT}, 6) AS ksat FROM ({TEXTURE_SQL})")
def _(spark, sf):
    return rounded(SO.with_texture(I.soil_layers(spark, sf)).select("px_id", "top_cm", "sat", "ksat"), "sat", "ksat")


@query("soil3_water_capacity", f"SELECT px_id, round(whc_mm, 6) AS whc_mm FROM ({WHC_SQL})")
def _(spark, sf):
    return rounded(SO.texture_whc(I.soil_layers(spark, sf)), "whc_mm")


HYDRO_SQL = f"""
    SELECT px_id, fc_mm, greatest(sat_mm, fc_mm + 10) AS sat_mm, least(greatest(866e-4 * pow(k * 24, 35e-2), 0), 1) AS tau FROM (
      SELECT px_id, sum(fc * th) AS fc_mm, sum(least(greatest({SAT}, 3e-1), 75e-2) * th) AS sat_mm, min({KSAT}) AS k FROM ({TEXTURE_SQL}) GROUP BY ALL)"""


@query("soil4_hydraulics", f"SELECT px_id, {r6('fc_mm sat_mm tau')} FROM ({HYDRO_SQL})")
def _(spark, sf):
    return rounded(SO.hydraulics(I.soil_layers(spark, sf)), "fc_mm", "sat_mm", "tau")


def _nodes_sql(awc: str) -> str:
    return f"""
    SELECT px_id, greatest(sum((a0 + a0 + (a1 - a0) * ((least(bot, 100e0) - top) / (bot - top))) * 5e-1 * ((least(bot, 100e0) - top) * 10)), 25) AS whc_mm FROM (
      SELECT px_id, depth_cm AS top, lead(depth_cm) OVER w AS bot, awc AS a0, lead(awc) OVER w AS a1
      FROM (SELECT *, {awc} AS awc FROM v_nodes) WINDOW w AS (PARTITION BY px_id ORDER BY depth_cm))
    WHERE bot IS NOT NULL AND top < 100 GROUP BY ALL"""


@query("soil5_node_capacity", f"SELECT px_id, round(whc_mm, 6) AS whc_mm FROM ({_nodes_sql('greatest(fc_vol_pct*1e-2 - wp_vol_pct*1e-2, 0)')})")
def _(spark, sf):
    return rounded(SO.node_whc(I.soil_nodes(spark, sf), own_wp=True), "whc_mm")


@query("soil6_capacity_source", f"SELECT px_id, round(whc_mm, 6) AS whc_mm FROM ({_nodes_sql('greatest(fc_vol_pct*1e-2 - fc_vol_pct*1e-2*45e-2, 0)')})")
def _(spark, sf):
    return rounded(SO.water_capacity(None, I.soil_nodes(spark, sf), SoilConfig(source="nodes")), "whc_mm")


# ---- water balance ---------------------------------------------------------------------------
@query("wb1_water_balance", f"SELECT px_id, year, {r6('wrsi deficit_mm aet_mm wr_mm sw_end_mm')}, complete FROM ({balance_sql(PLANT, MAIZE, 7, 15, 'any_value(whc_mm)', whc_from=WHC_SQL)})")
def _(spark, sf):
    cl = I.climate(spark, sf)
    w = B.water_balance(cl, I.planting(spark, sf, cl), MAIZE, 7, 15, SO.texture_whc(I.soil_layers(spark, sf)))
    return rounded(w, "wrsi", "deficit_mm", "aet_mm", "wr_mm", "sw_end_mm")


@query("wb2_wrsi_classes", f"""
    SELECT px_id, year, {wrsi_class('wrsi')} AS wrsi_class, CASE WHEN wrsi >= 80 THEN 5 WHEN wrsi >= 50 THEN 3 WHEN wrsi IS NOT NULL THEN 1 END AS coarse_class
    FROM ({balance_sql(PLANT, MAIZE, 7, 15)})""")
def _(spark, sf):
    cl = I.climate(spark, sf)
    w = B.water_balance(cl, I.planting(spark, sf, cl), MAIZE, 7, 15)
    return w.select("px_id", "year", CL.wrsi_class("wrsi").alias("wrsi_class"), CL.wrsi_class_coarse("wrsi").alias("coarse_class"))


STAGED = [f"{k}_{s}" for k in ("wrsi", "wsi", "aet", "wr") for s in B.STAGES]


@query("wb3_staged_balance", f"WITH RECURSIVE {stepwise_sql(PLANT, MAIZE, 7, 15, 2)} SELECT px_id, year, {r6(' '.join(STAGED))}, complete FROM ({staged_sql(MAIZE)})")
def _(spark, sf):
    cl = I.climate(spark, sf)
    return rounded(B.staged_balance(cl, I.planting(spark, sf, cl), MAIZE, 7, 15), *STAGED)


@query("wb3_staged_short_rains", f"WITH RECURSIVE {stepwise_sql(FALLBACK_SQL, MAIZE_EARLY, 28, 34, 2, col='onset')} SELECT px_id, year, {r6(' '.join(STAGED))}, complete FROM ({staged_sql(MAIZE_EARLY, 28, 34)})")
def _(spark, sf):
    """The cycle runs into the next year; the last season lacks it: NULL and not complete."""
    cl = I.climate(spark, sf)
    pl = short_onset(spark, sf, cl).withColumn("planting", F.col("onset"))
    return rounded(B.staged_balance(cl, pl, MAIZE_EARLY, 28, 34), *STAGED)


@query("wb4_driver", f"SELECT px_id, year, onset AS planting, round(wrsi, 6) AS wrsi, {wrsi_class('wrsi')} AS wrsi_class FROM v_onset LEFT JOIN ({balance_sql(PLANT, MAIZE, 7, 15)}) USING (px_id, year)")
def _(spark, sf):
    cl = I.climate(spark, sf)
    pl = I.planting(spark, sf, cl)
    w = B.water_balance(cl, pl, MAIZE, 7, 15).select("px_id", "year", "wrsi")
    out = pl.drop("onset").join(w, ["px_id", "year"], "left").withColumn("wrsi_class", CL.wrsi_class("wrsi"))
    return rounded(out, "wrsi")


@query("wb5_flowering_failure", f"WITH RECURSIVE {stepwise_sql(PLANT, MAIZE, 7, 15, 2)} SELECT px_id, year, CAST(wrsi_flo < 50 AS INTEGER) AS fail_flo FROM ({staged_sql(MAIZE)})")
def _(spark, sf):
    cl = I.climate(spark, sf)
    s = B.staged_balance(cl, I.planting(spark, sf, cl), MAIZE, 7, 15)
    return s.select("px_id", "year", (F.col("wrsi_flo") < 50).cast("int").alias("fail_flo"))


# ---- thermal clock ---------------------------------------------------------------------------
GDD = "greatest((least(tmax_c, 30e0) + tmin_c) / 2 - 9, 0) * 10"
# longest run on the 72-dekad ring by gaps and islands
LGP_SQL = """
    SELECT px_id, CAST(coalesce(max(n), 0) AS INTEGER) AS lgp FROM (SELECT DISTINCT px_id FROM v_ratio) LEFT JOIN (
      SELECT px_id, grp, least(count(*), 36) AS n FROM (
        SELECT px_id, k - row_number() OVER (PARTITION BY px_id ORDER BY k) AS grp FROM (
          SELECT px_id, dekad AS k FROM v_ratio WHERE p / greatest(et0, 1e-3) >= 5e-1
          UNION ALL SELECT px_id, dekad + 36 FROM v_ratio WHERE p / greatest(et0, 1e-3) >= 5e-1)) GROUP BY ALL) USING (px_id) GROUP BY ALL"""
MAT_SQL = f"""
    SELECT px_id, lgp, CASE WHEN lgp < 7 AND elev_m < 1800 THEN 1 WHEN lgp >= 15 OR (elev_m >= 1800 AND lgp >= 12) THEN 3 ELSE 2 END AS maturity_class
    FROM ({LGP_SQL}) JOIN v_grid USING (px_id)"""
GMAT_SQL = f"SELECT px_id, CASE maturity_class WHEN 1 THEN 13e2 WHEN 3 THEN 17e2 ELSE 15e2 END AS gdd_maturity FROM ({MAT_SQL})"


def maturity(spark, sf):
    lgp = O.growing_period(I.ratio(spark, sf)).join(I.grid(spark, sf), "px_id")
    return lgp.withColumn("maturity_class", CL.maturity_from_lgp("lgp", "elev_m"))


def gdd_target(spark, sf):
    return maturity(spark, sf).select("px_id", CL.gdd_maturity("maturity_class").alias("gdd_maturity"))


def clock_sql(sos: str, lo: int, hi: int) -> str:
    marks = ", ".join(f"min(CASE WHEN cum >= gdd_maturity * {f}::DOUBLE THEN gd END) AS {n}_dekad" for n, f in
                      (("peak_vegetative", 0.45), ("flowering", 0.55), ("grain_filling", 0.65), ("maturity", 1.0)))
    return f"""
    SELECT px_id, year, {marks}, CAST(trunc(CASE WHEN count(*) = {hi - lo + 1} THEN max(cum) END) AS INTEGER) AS gdd_total FROM (
      SELECT *, sum(CASE WHEN gd >= sos THEN {GDD} ELSE 0 END) OVER (PARTITION BY px_id, year ORDER BY gd) AS cum FROM (
        SELECT px_id, year, dekad AS gd, tmax_c, tmin_c FROM v_temps WHERE dekad BETWEEN {lo} AND {hi}
        UNION ALL SELECT px_id, year - 1, dekad + 36, tmax_c, tmin_c FROM v_temps WHERE dekad + 36 BETWEEN {lo} AND {hi})
      JOIN ({sos}) USING (px_id, year) JOIN ({GMAT_SQL}) USING (px_id) WHERE sos IS NOT NULL) GROUP BY ALL"""


CLOCK_SQL = clock_sql("SELECT px_id, year, onset + 1 AS sos FROM v_onset", 1, 36)


def clock(spark, sf):
    cl = I.climate(spark, sf)
    return B.gdd_clock(cl, I.onset(spark, sf, cl).withColumn("sos", F.col("onset") + 1), gdd_target(spark, sf))


@query("gdd1_dekad_degree_days", f"SELECT px_id, year, dekad, round({GDD}, 6) AS gdd FROM v_temps")
def _(spark, sf):
    return I.climate(spark, sf).select("px_id", "year", "dekad", F.round(CM.dekad_gdd("tmax_c", "tmin_c"), 6).alias("gdd"))


@query("gdd2_stage_clock", CLOCK_SQL)
def _(spark, sf):
    return clock(spark, sf)


@query("gdd3_maturity_target", GMAT_SQL)
def _(spark, sf):
    return gdd_target(spark, sf)


@query("gdd4_rain_anchored", clock_sql(f"SELECT px_id, year, onset + 1 AS sos FROM ({FALLBACK_SQL})", 28, 52))
def _(spark, sf):
    cl = I.climate(spark, sf)
    return B.rain_anchored_clock(cl, short_onset(spark, sf, cl), gdd_target(spark, sf))


# the clocks stepped dekad by dekad; a step has four stages: thermal time, juvenile rest, induction, rest after it
PHOTO_SQL = f"""
    WITH RECURSIVE h AS (
      SELECT px_id, year, dekad AS gd, {GDD} AS gdd, least(greatest((135e-1 - 24 / pi() * acos(least(greatest(-tan(radians(lat)) * tan(409e-3 * sin(2 * pi() / 365 * doy - 139e-2)), -1), 1))) / 15e-1, 0), 1) AS rate
      FROM (SELECT *, dayofyear({start('year', 'dekad')}) + 5 AS doy FROM v_temps JOIN v_grid USING (px_id))),
    clock AS (
      SELECT px_id, year, onset AS gd, 0e0 AS j, 0e0 AS i, 0e0 AS t FROM v_onset WHERE onset IS NOT NULL
      UNION ALL
      SELECT px_id, year, gd + 1, j1, i0 + left1 * rate, t0 + CASE WHEN i0 >= 150 THEN left1 WHEN i0 + left1 * rate >= 150 THEN left1 - (150 - i0) / rate ELSE 0 END
      FROM (SELECT c.px_id, c.year, c.gd, c.j + h.gdd AS j1, greatest(c.j + h.gdd - greatest(c.j, 300), 0) AS left1, c.i AS i0, c.t AS t0, h.rate
            FROM clock c JOIN h USING (px_id, year, gd)))
    SELECT px_id, year, CAST(min(CASE WHEN j >= 300 THEN gd - 1 END) AS INTEGER) AS juvenile_dekad, CAST(min(CASE WHEN i >= 150 THEN gd - 1 END) AS INTEGER) AS initiation_dekad,
           CAST(min(CASE WHEN t >= 450 THEN gd - 1 END) AS INTEGER) AS flowering_dekad, CAST(min(CASE WHEN t >= 900 THEN gd - 1 END) AS INTEGER) AS maturity_dekad FROM clock GROUP BY px_id, year"""


@query("gdd2_photothermal_clock", PHOTO_SQL)
def _(spark, sf):
    cl = I.climate(spark, sf)
    return B.photothermal_clock(cl, I.onset(spark, sf, cl).withColumn("sos", F.col("onset")))


@query("gdd2_day_length", """
    SELECT px_id, dekad, round(24 / pi() * acos(-tan(radians(lat)) * tan(409e-3 * sin(2 * pi() / 365 * (dekad * 10) - 139e-2))), 6) AS hours
    FROM v_grid, (SELECT unnest(range(1, 37)) AS dekad)""")
def _(spark, sf):
    g = I.grid(spark, sf).select("px_id", "lat", F.explode(F.sequence(F.lit(1), F.lit(36))).alias("dekad"))
    return g.select("px_id", "dekad", F.round(CM.day_length("lat", F.col("dekad") * 10), 6).alias("hours"))


# ---- agro-ecology ----------------------------------------------------------------------------
@query("aez1_growing_period", LGP_SQL)
def _(spark, sf):
    return O.growing_period(I.ratio(spark, sf))


@query("aez2_maturity_class", MAT_SQL)
def _(spark, sf):
    return maturity(spark, sf).select("px_id", "lgp", "maturity_class")


AEZ_SQL = """
    SELECT *, CASE WHEN zone IS NULL THEN 'unclassified' WHEN belt IN ('TA','UH','LH') THEN CASE WHEN zone <= 3 THEN 'late' ELSE 'medium' END
           WHEN zone <= 2 THEN 'late' WHEN zone <= 4 THEN 'medium' ELSE 'early' END AS maturity_class FROM (
      SELECT *, CASE WHEN belt IS NOT NULL THEN CASE WHEN len(regexp_extract_all(aez, '[0-9]+')) > 0 THEN list_max(list_transform(regexp_extract_all(aez, '[0-9]+'), lambda s: CAST(s AS INTEGER)))
             WHEN aez LIKE '%O' THEN 0 END END AS zone FROM (
        SELECT *, CASE WHEN regexp_extract(aez, '[A-Z]{2}') IN ('TA','UH','LH','UM','LM','IL','CL') THEN regexp_extract(aez, '[A-Z]{2}') END AS belt FROM v_pixels))"""


def with_aez(px):
    p = px.withColumns({"belt": CL.aez_belt("aez"), "zone": CL.aez_zone("aez")})
    return p.withColumn("maturity_class", CL.aez_maturity("belt", "zone"))


@query("aez3_parse_code", f"SELECT px_id, aez, belt, zone FROM ({AEZ_SQL})")
def _(spark, sf):
    return with_aez(I.pixels(spark, sf)).select("px_id", "aez", "belt", "zone")


@query("aez4_maturity_from_zone", f"SELECT px_id, maturity_class FROM ({AEZ_SQL})")
def _(spark, sf):
    return with_aez(I.pixels(spark, sf)).select("px_id", "maturity_class")
