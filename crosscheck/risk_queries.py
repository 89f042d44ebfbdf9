"""Indices, stresses, performance index, alerts."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.balance_queries import CLOCK_SQL, HYDRO_SQL, PLANT, clock
from crosscheck.balance_sql import staged_sql, stepwise_sql
from crosscheck.registry import query
from crosscheck.util import r6, rounded
from crosscheck.views import start
from seasonlens.config import MAIZE
from seasonlens.plans.season import SeasonParams, risk_product
from seasonlens.operators import balance as B, frames as FR, onset as O, rainfall as RA, risk as R, soil as SO

SPI_SQL = """
    SELECT px_id, year, p3, least(greatest((pow(p3 / mu, 1/3e0) - 1 + 1/a9) * sqrt(a9), -35e-1), 35e-1) AS spi3 FROM (
      SELECT *, 9 * greatest(pow(mu / sd, 2), 1e-3) AS a9 FROM (
        SELECT px_id, year, p3, greatest(avg(CASE WHEN year <= 2000 THEN p3 END) OVER w, 1e-3) AS mu, greatest(stddev_pop(CASE WHEN year <= 2000 THEN p3 END) OVER w, 1e-3) AS sd
        FROM (SELECT px_id, year(d) AS year, sum(rain_mm) AS p3 FROM v_rain_rows WHERE month(d) IN (3, 4, 5) GROUP BY ALL) WINDOW w AS (PARTITION BY px_id)))"""


def spi(spark, sf):
    return RA.spi3(RA.three_month_totals(I.rain_rows(spark, sf), 5, absent="dry").drop("coverage"), (1995, 2000))


@query("spi1_three_month_index", f"SELECT px_id, year, p3, round(spi3, 6) AS spi3 FROM ({SPI_SQL})")
def _(spark, sf):
    return rounded(spi(spark, sf), "spi3")


@query("spi2_wet_dry_flags", f"SELECT px_id, year, CAST(spi3 >= 15e-1 AS INTEGER) AS wet, CAST(spi3 <= -1 AS INTEGER) AS dry FROM ({SPI_SQL})")
def _(spark, sf):
    return RA.spi_flags(spi(spark, sf)).select("px_id", "year", "wet", "dry")


@query("exc1_wet_dekads", """
    SELECT px_id, year, round(least(greatest(max(least(greatest((p - 100) / 100, 0), 1) * CASE WHEN dsp < 0 OR dsp >= 12 THEN 0 WHEN dsp < 7 THEN 1 WHEN dsp < 10 THEN 6e-1 ELSE 35e-2 END), 0), 1) * 100, 6) AS waterlog_idx
    FROM (SELECT px_id, year, p, dekad - onset AS dsp FROM v_rain JOIN v_onset USING (px_id, year) WHERE dekad BETWEEN 7 AND 27 AND onset IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    return rounded(B.wet_dekad_exposure(I.rain(spark, sf), I.planting(spark, sf), MAIZE, 7, 15), "waterlog_idx")


ONSETS = "SELECT px_id, year, onset AS planting FROM v_onset WHERE onset IS NOT NULL"
# season start less the fixed emergence lag: may precede dekad 7
GREEN = "SELECT px_id, year, sos - 2 AS planting FROM v_sos WHERE sos IS NOT NULL"


def aeration_sql(drain: str, first: str, days: int, dsp: str, planted: str = ONSETS) -> str:
    """Day-by-day recursion on a dense series of ``days`` days from the date ``first``."""
    filled = "least(greatest(r.w + coalesce(d.rain_mm, 0) - 4, 0), r.sat_mm)"
    return f"""
    base AS MATERIALIZED (SELECT px_id, year, planting, fc_mm, sat_mm, tau, fc_mm + (sat_mm - fc_mm) * 5e-1 AS thr, {first} AS d0
                          FROM ({planted}) JOIN ({HYDRO_SQL}) USING (px_id)),
    wet AS MATERIALIZED (SELECT * FROM v_rain_daily),
    run AS (
      SELECT px_id, year, planting, fc_mm, sat_mm, tau, thr, d0, -1 AS i, fc_mm * 8e-1 AS w, 0e0 AS run, 0e0 AS peak FROM base
      UNION ALL
      SELECT px_id, year, planting, fc_mm, sat_mm, tau, thr, d0, i, w, run, greatest(peak, run) FROM (
        SELECT *, CASE WHEN dsp >= 0 AND dsp < 120 AND w > thr THEN
                 prev + least(greatest((w - thr) / greatest(sat_mm - thr, 1e-3), 0), 1) * CASE WHEN dsp < 70 THEN 1 WHEN dsp < 100 THEN 6e-1 ELSE 35e-2 END ELSE 0e0 END AS run FROM (
          SELECT r.px_id, r.year, r.planting, r.fc_mm, r.sat_mm, r.tau, r.thr, r.d0, r.i + 1 AS i, r.run AS prev, r.peak,
                 {dsp} AS dsp, {drain.format(f=filled)} AS w
          FROM run r LEFT JOIN wet d ON d.px_id = r.px_id AND d.d = r.d0 + CAST(r.i + 1 AS INTEGER) WHERE r.i < {days - 1})))"""


_DRAIN = "({f}) - greatest(({f}) - r.fc_mm, 0) * r.tau"
_CODED = "r.fc_mm + greatest(({f}) - r.fc_mm, 0) * (1 - r.tau)"
_INDEX = (start("year", "7"), 202, "r.i + 1 - (r.planting - 7) * 10")
AER_SQL = aeration_sql(_DRAIN, start("year", "planting"), 120, "r.i + 1")
AER_CODED_SQL = aeration_sql(_CODED, *_INDEX)
AER_OUT = "SELECT px_id, year, round(least(greatest(max(peak) / 4, 0), 1) * 100, 6) AS waterlog_idx FROM run GROUP BY ALL"


def greenness_planting(spark, sf):
    return O.planting_fixed(I.sos(spark, sf), "maize")


def aeration(spark, sf, as_coded=False, planting=None):
    pl = planting if planting is not None else I.planting(spark, sf)
    return B.aeration_stress(pl, I.rain_daily(spark, sf), SO.hydraulics(I.soil_layers(spark, sf)), MAIZE, 7, 15, as_coded=as_coded)


@query("exc2_aeration_stress", f"WITH RECURSIVE {AER_SQL} {AER_OUT}")
def _(spark, sf):
    return rounded(aeration(spark, sf), "waterlog_idx")


@query("exc2_as_coded", f"WITH RECURSIVE {AER_CODED_SQL} {AER_OUT}")
def _(spark, sf):
    return rounded(aeration(spark, sf, True), "waterlog_idx")


@query("exc2_greenness_planting", f"WITH RECURSIVE {aeration_sql(_DRAIN, start('year', 'planting'), 120, 'r.i + 1', GREEN)} {AER_OUT}")
def _(spark, sf):
    """Plantings before the window keep their first days."""
    return rounded(aeration(spark, sf, planting=greenness_planting(spark, sf)), "waterlog_idx")


@query("exc2_greenness_as_coded", f"WITH RECURSIVE {aeration_sql(_CODED, *_INDEX, GREEN)} {AER_OUT}")
def _(spark, sf):
    return rounded(aeration(spark, sf, True, greenness_planting(spark, sf)), "waterlog_idx")


def _heavy_sql(lo: int, hi: int, coded: bool = False, planted: str = ONSETS) -> str:
    first, end = (start("o.year", "7"), 202) if coded else (start("o.year", "o.planting"), 120)
    dsp = f"date_diff('day', {first}, d.d)" + (" - (o.planting - 7) * 10" if coded else "")
    return f"""
    SELECT o.px_id, o.year, count(d.d) AS heavy_rain_days FROM ({planted}) o LEFT JOIN v_rain_daily d ON d.px_id = o.px_id AND d.rain_mm > 50
      AND d.d >= {first} AND d.d < {first} + {end} AND {dsp} BETWEEN {lo} AND {hi - 1} GROUP BY ALL"""


@query("exc3_heavy_rain_days", _heavy_sql(0, 120))
def _(spark, sf):
    return B.heavy_rain_days(I.planting(spark, sf), I.rain_daily(spark, sf), MAIZE, 7, 15)


@query("exc3_flowering_stage", _heavy_sql(70, 100))
def _(spark, sf):
    return B.heavy_rain_days(I.planting(spark, sf), I.rain_daily(spark, sf), MAIZE, 7, 15, stage="flo")


@query("exc3_greenness_planting", _heavy_sql(0, 120, planted=GREEN))
def _(spark, sf):
    return B.heavy_rain_days(greenness_planting(spark, sf), I.rain_records(spark, sf), MAIZE, 7, 15)


@query("exc3_as_coded", _heavy_sql(0, 120, True, GREEN))
def _(spark, sf):
    return B.heavy_rain_days(greenness_planting(spark, sf), I.rain_daily(spark, sf), MAIZE, 7, 15, as_coded=True)


# ---- vegetation ------------------------------------------------------------------------------
def peak_sql(view: str, scale: str) -> str:
    return f"""
    SELECT px_id, y AS year, max(raw) * {scale} AS peak FROM {view}, (SELECT unnest(range(1995, 2002)) AS y)
    WHERE d >= {start('y', '7')} AND d < {start('y', '15')} + 40 GROUP BY ALL"""


def peaks(spark, sf, what="ndvi"):
    obs, scale = (I.ndvi_obs(spark, sf), 0.0001) if what == "ndvi" else (I.fpar_obs(spark, sf), 0.01)
    return R.seasonal_peak(obs, 7, 15, scale)


@query("veg1_seasonal_peak", f"SELECT px_id, year, round(peak, 6) AS peak FROM ({peak_sql('v_ndvi_obs', '1e-4')})")
def _(spark, sf):
    return rounded(peaks(spark, sf), "peak")


@query("veg1_wrapping_season", f"""
    SELECT px_id, y AS year, round(max(raw) * 1e-4, 6) AS peak FROM v_ndvi_obs, (SELECT unnest(range(1995, 2001)) AS y)
    WHERE d >= {start('y', '33')} AND d < {start('y', '38')} + 40 GROUP BY ALL""")
def _(spark, sf):
    """Seasons whose window the record holds whole: 1995 to 2000."""
    return rounded(R.seasonal_peak(I.ndvi_obs(spark, sf), 33, 38, 0.0001, years=(1995, 2000)), "peak")


VCI_SQL = f"""
    SELECT px_id, year, least(greatest((1 - least(greatest((peak - lo) / greatest(hi - lo, 1e-3), 0), 1)) * 4e-1, 0), 1) AS s_veg FROM (
      SELECT *, min(CASE WHEN year <= 2000 THEN peak END) OVER w AS lo, max(CASE WHEN year <= 2000 THEN peak END) OVER w AS hi
      FROM ({peak_sql('v_ndvi_obs', '1e-4')}) WINDOW w AS (PARTITION BY px_id))"""


def veg(spark, sf):
    return R.vci_stress(peaks(spark, sf), (1995, 2000))


@query("veg2_vci_stress", f"SELECT px_id, year, round(s_veg, 6) AS s_veg FROM ({VCI_SQL})")
def _(spark, sf):
    return rounded(veg(spark, sf), "s_veg")


@query("veg3_zfpar_stress", f"""
    SELECT px_id, year, round(least(greatest(least(greatest(-((peak - mu) / greatest(sd, 1e-6)) / 2, 0), 1) * 4e-1, 0), 1), 6) AS s_veg FROM (
      SELECT *, avg(CASE WHEN year <= 2000 THEN peak END) OVER w AS mu, stddev_pop(CASE WHEN year <= 2000 THEN peak END) OVER w AS sd
      FROM ({peak_sql('v_fpar_obs', '1e-2')}) WINDOW w AS (PARTITION BY px_id))""")
def _(spark, sf):
    return rounded(R.zfpar_stress(peaks(spark, sf, "fpar"), (1995, 2000)), "s_veg")


# ---- performance index -----------------------------------------------------------------------
DEF = lambda s: f"least(greatest(1 - aet_{s} / greatest(wr_{s}, 1e-6), 0), 1)"
SW = f"least(greatest({DEF('veg')} * 4e-1 + {DEF('flo')} * 15e-1 + {DEF('grf')} * 5e-1, 0), 1)"
HEAT_SQL = """
    SELECT px_id, year, least(greatest(sum(CASE WHEN dekad - onset >= 7 AND dekad - onset < 10 THEN greatest(tmax_c - 33, 0) ELSE 0 END) * 6e-2, 0), 1) AS s_heat
    FROM v_temps JOIN v_onset USING (px_id, year) WHERE dekad BETWEEN 7 AND 26 AND onset IS NOT NULL GROUP BY ALL"""
STEP = stepwise_sql(PLANT, MAIZE, 7, 15, 2)
CPI_SQL = f"""
    SELECT *, least(greatest((1 - s_water) * (1 - s_heat) * (1 - s_veg), 0), 1) * 100 AS cpi FROM (
      SELECT px_id, year, {SW} AS s_water, s_heat, s_veg FROM ({staged_sql(MAIZE)}) JOIN ({HEAT_SQL}) USING (px_id, year) LEFT JOIN ({VCI_SQL}) USING (px_id, year))"""


def staged(spark, sf, cl=None):
    cl = cl if cl is not None else I.climate(spark, sf)
    return B.staged_balance(cl, I.planting(spark, sf, cl), MAIZE, 7, 15)


def cpi_pixels(spark, sf):
    cl = I.climate(spark, sf)
    return risk_product(cl, I.planting(spark, sf, cl), veg(spark, sf), SeasonParams())


@query("cpi1_water_stress", f"WITH RECURSIVE {STEP} SELECT px_id, year, round({SW}, 6) AS s_water FROM ({staged_sql(MAIZE)})")
def _(spark, sf):
    return staged(spark, sf).select("px_id", "year", F.round(R.water_stress(), 6).alias("s_water"))


@query("cpi1_heat_stress", f"SELECT px_id, year, round(s_heat, 6) AS s_heat FROM ({HEAT_SQL})")
def _(spark, sf):
    cl = I.climate(spark, sf)
    return rounded(R.heat_stress(cl, I.planting(spark, sf, cl), MAIZE, 7, 15), "s_heat")


@query("cpi1_performance_index", f"""
    WITH RECURSIVE {STEP} SELECT px_id, year, {r6('s_water s_heat s_veg cpi')}, round(cpi / 100 * 6, 6) AS yield_tha FROM ({CPI_SQL})""")
def _(spark, sf):
    px = cpi_pixels(spark, sf).select("px_id", "year", "s_water", "s_heat", "s_veg", "cpi", "yield_tha")
    return rounded(px, "s_water", "s_heat", "s_veg", "cpi", "yield_tha")


@query("cpi2_additive_index", f"""
    WITH RECURSIVE {STEP} SELECT px_id, year, round(least(greatest((1 - ({DEF('veg')} * 4e-1 + {DEF('flo')} * 15e-1 + {DEF('grf')} * 5e-1)) * 100, 0), 100), 6) AS cpi FROM ({staged_sql(MAIZE)})""")
def _(spark, sf):
    return staged(spark, sf).select("px_id", "year", F.round(R.performance_index_additive(), 6).alias("cpi"))


@query("cpi3_production", "SELECT county, round(sum(CASE WHEN y BETWEEN 0 AND 15 THEN y END) * 625e-2, 4) AS production_t FROM (SELECT county, yield_tha_x100 / 1e2 AS y FROM v_pixels) GROUP BY ALL")
def _(spark, sf):
    px = I.pixels(spark, sf).withColumn("yield_tha", F.col("yield_tha_x100") / 100.0)
    return rounded(R.production(px, ["county"]), "production_t", n=4)


# ---- alerts ----------------------------------------------------------------------------------
@query("asap1_alert_class", """
    SELECT *, CASE WHEN affected_pct >= 75 THEN 'Critical' WHEN affected_pct >= 50 THEN 'Alert' WHEN affected_pct >= 25 THEN 'Watch' ELSE 'None' END AS asap FROM (
      SELECT constituency, year, round(avg(CASE WHEN cpi < 50 THEN 1e0 ELSE 0e0 END) * 100, 6) AS affected_pct FROM v_pixels GROUP BY ALL)""")
def _(spark, sf):
    px = I.pixels(spark, sf).withColumn("fail", (F.col("cpi") < 50).cast("int"))
    return rounded(R.affected_share(px, "fail", ["constituency", "year"]), "affected_pct")


DRY = "SELECT px_id, year, dekad AS gd, CASE WHEN p < 10 THEN 1 ELSE 0 END AS dry, CASE WHEN tmax_c > 33 THEN 1 ELSE 0 END AS hot FROM v_climate WHERE dekad BETWEEN 7 AND 27"


def hazards(spark, sf):
    cl = FR.season_frame(I.climate(spark, sf), 7, 27)
    return cl.select("px_id", "year", "gd", (F.col("p") < 10).cast("int").alias("dry"), (F.col("tmax_c") > 33).cast("int").alias("hot"))


@query("asap2_persistence", f"""
    SELECT px_id, year, max(CASE WHEN dry = 1 AND prev = 1 THEN 1 ELSE 0 END) AS persistent
    FROM (SELECT *, lag(dry) OVER (PARTITION BY px_id, year ORDER BY gd) AS prev FROM ({DRY})) GROUP BY ALL""")
def _(spark, sf):
    return R.persistent_hazard(hazards(spark, sf), "dry")


@query("asap3_stage_weight", f"""
    SELECT px_id, year, gd, CASE WHEN gd < onset + 1 OR gd > maturity_dekad THEN 0e0 WHEN gd < peak_vegetative_dekad THEN 4e-1 WHEN gd < grain_filling_dekad THEN 15e-1
           WHEN gd <= maturity_dekad THEN 5e-1 END AS ky FROM ({DRY}) JOIN ({CLOCK_SQL}) USING (px_id, year) JOIN v_onset USING (px_id, year)""")
def _(spark, sf):
    marks = clock(spark, sf).join(I.onset(spark, sf).withColumn("sos", F.col("onset") + 1), ["px_id", "year"])
    return R.stage_weight(hazards(spark, sf), marks).select("px_id", "year", "gd", "ky")


@query("asap4_hazard_products", f"""
    SELECT *, greatest(dry, hot) AS hotspot FROM (
      SELECT px_id, year, (gd - 1)//3 + 1 AS month, gd, max(dry) AS dry, max(hot) AS hot, 'dekad' AS product FROM ({DRY}) GROUP BY ALL
      UNION ALL SELECT px_id, year, (gd - 1)//3 + 1, NULL, max(dry), max(hot), 'month' FROM ({DRY}) GROUP BY ALL
      UNION ALL SELECT px_id, year, NULL, NULL, max(dry), max(hot), 'season' FROM ({DRY}) GROUP BY ALL)""")
def _(spark, sf):
    return R.hazard_products(hazards(spark, sf), ["dry", "hot"])
