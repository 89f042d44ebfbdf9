"""End-to-end season products."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosscheck import inputs as I
from crosscheck.balance_queries import PLANT, STAGED, WHC_SQL
from crosscheck.balance_sql import balance_sql, staged_sql, stepwise_sql
from crosscheck.onset_queries import FALLBACK_SQL, GATE_SQL, OFF, TNORM_SQL, _gate_sql, _prior, _sos_sql, _tnorm
from crosscheck.registry import query
from crosscheck.risk_queries import AER_OUT, AER_SQL, SPI_SQL, SW, VCI_SQL, spi, veg
from crosscheck.rollup_queries import skill_sql
from crosscheck.util import r6, rounded
from crosscheck.views import MONTH_LIST, kc, start, wrsi_class
from seasonlens.config import CROPS, MAIZE, MAIZE_EARLY
from seasonlens.operators import observations as OB, rainfall as RA, soil as SO
from seasonlens.plans import season as P
from seasonlens.sources import calendars as CA

OUT = ("mean_onset", "hit_rate", "mean_wrsi", "mean_deficit_mm", "fail_pct")


def zones(spark, sf):
    s = I.table(spark, sf, "supplier").join(I.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("px_id"), F.col("n_name").alias("county"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """When did the rains start, and did the crop get enough water, per county."""
    whc = SO.texture_whc(I.soil_layers(spark, sf))
    return rounded(P.rain_led_product(I.climate(spark, sf), zones(spark, sf), P.SeasonParams(), whc), *OUT)


WB = balance_sql(PLANT, MAIZE, 7, 15, "any_value(whc_mm)", whc_from=WHC_SQL)


@query("plan_rain_led_county", f"""
    SELECT n_name AS county, count(*) AS n_seasons, count(onset) AS n_onset, round(avg(onset), 6) AS mean_onset, round(avg(CASE WHEN onset IS NOT NULL THEN CASE WHEN onset BETWEEN 8 AND 12 THEN 1 ELSE 0 END END), 6) AS hit_rate,
           round(avg(wrsi), 6) AS mean_wrsi, round(avg(deficit_mm), 6) AS mean_deficit_mm, round(avg(CASE WHEN wrsi < 50 THEN 1 WHEN wrsi IS NOT NULL THEN 0 END) * 100, 6) AS fail_pct
    FROM v_onset LEFT JOIN ({WB}) USING (px_id, year) JOIN supplier ON s_suppkey = px_id JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def _(spark, sf):
    return flagship(spark, sf)


# season start with the prior, thermal lag, real-date gate
_PL = f"SELECT px_id, year, sos, sos - {OFF} AS planting FROM ({_sos_sql(True, True)}) LEFT JOIN ({TNORM_SQL}) USING (px_id)"
_GATE = _gate_sql(start("year", "planting"), f"SELECT px_id, year, planting FROM ({_PL}) WHERE planting IS NOT NULL")
_GATED = f"""
    gated AS (SELECT a.px_id, a.year, a.sos, CASE WHEN max_dry_days <= 7 AND onset_acc_mm >= 20 THEN a.planting END AS planting,
              CASE WHEN a.planting IS NULL THEN NULL WHEN max_dry_days <= 7 AND onset_acc_mm >= 20 THEN 0 ELSE 1 END AS false_start
              FROM ({_PL}) a LEFT JOIN diag USING (px_id, year))"""


@query("plan_season_product", f"""
    WITH {_GATE}, {_GATED}, wb AS ({balance_sql('SELECT px_id, year, planting FROM gated', MAIZE, 7, 15)})
    SELECT g.px_id, g.year, g.sos, g.planting, g.false_start, o.onset, {r6('wrsi deficit_mm')}, {wrsi_class('wrsi')} AS wrsi_class
    FROM gated g LEFT JOIN v_onset o USING (px_id, year) LEFT JOIN wb USING (px_id, year)""")
def _(spark, sf):
    cl = I.climate(spark, sf)
    out = P.season_product(I.greenness(spark, sf), cl, I.rain_daily(spark, sf), P.SeasonParams(), _prior(spark, sf), _tnorm(spark, sf))
    return rounded(out.select("px_id", "year", "sos", "planting", "false_start", "onset", "wrsi", "deficit_mm", "wrsi_class"), "wrsi", "deficit_mm")


_CROP = "SELECT px_id FROM v_mask WHERE product = 'maize' AND classification = 100"


def maize(spark, sf):
    return OB.crop_pixels(I.crop_mask(spark, sf), "maize")


@query("plan_season_on_crop", f"""
    WITH {_GATE}, {_GATED}, wb AS ({balance_sql('SELECT px_id, year, planting FROM gated', MAIZE, 7, 15, 'any_value(whc_mm)', whc_from=WHC_SQL)})
    SELECT g.px_id, g.year, g.sos, g.planting, g.false_start, o.onset, {r6('wrsi deficit_mm')}, {wrsi_class('wrsi')} AS wrsi_class
    FROM gated g LEFT JOIN v_onset o USING (px_id, year) LEFT JOIN wb USING (px_id, year) WHERE g.year BETWEEN 1997 AND 2000 AND px_id IN ({_CROP})""")
def _(spark, sf):
    """Crop pixels, own soils, the season years asked for."""
    out = P.season_product(I.greenness(spark, sf), I.climate(spark, sf), I.rain_daily(spark, sf), P.SeasonParams(years=(1997, 2000)),
                           _prior(spark, sf), _tnorm(spark, sf), SO.texture_whc(I.soil_layers(spark, sf)), maize(spark, sf))
    return rounded(out.select("px_id", "year", "sos", "planting", "false_start", "onset", "wrsi", "deficit_mm", "wrsi_class"), "wrsi", "deficit_mm")


_EARLY_WB = balance_sql(FALLBACK_SQL, MAIZE_EARLY, 28, 34, "any_value(whc_mm)", col="onset", whc_from=WHC_SQL)
_VIABLE = f"SELECT px_id, year, CASE WHEN wrsi >= 50 THEN onset END AS planting FROM ({FALLBACK_SQL}) LEFT JOIN ({_EARLY_WB}) USING (px_id, year)"
_HEAT = f"""
    SELECT px_id, year, CASE WHEN count(tmax_c) = {MAIZE_EARLY.flo_end - MAIZE_EARLY.veg_end} THEN least(greatest(sum(greatest(tmax_c - 33, 0)) * 6e-2, 0), 1) END AS s_heat
    FROM viable JOIN (SELECT px_id, year, dekad AS gd, tmax_c FROM v_temps UNION ALL SELECT px_id, year - 1, dekad + 36, tmax_c FROM v_temps) USING (px_id, year)
    WHERE gd - planting >= {MAIZE_EARLY.veg_end} AND gd - planting < {MAIZE_EARLY.flo_end} GROUP BY ALL"""
_SHORT = (*STAGED, "s_water", "s_heat", "s_veg", "cpi", "yield_tha")


@query("plan_short_rains", f"""
    WITH RECURSIVE viable AS MATERIALIZED ({_VIABLE}), {stepwise_sql('SELECT * FROM viable', MAIZE_EARLY, 28, 34, 2, whc_from=WHC_SQL)},
    st AS ({staged_sql(MAIZE_EARLY, 28, 34)}), heat AS ({_HEAT}),
    allpx AS (SELECT f.px_id, f.year, f.onset, v.planting, w.wrsi AS wrsi_early, st.* EXCLUDE (px_id, year, complete), coalesce(st.complete, 0) AS complete, heat.s_heat, g.s_veg
        FROM ({FALLBACK_SQL}) f JOIN viable v USING (px_id, year) LEFT JOIN ({_EARLY_WB}) w USING (px_id, year) LEFT JOIN st USING (px_id, year) LEFT JOIN heat USING (px_id, year)
        LEFT JOIN ({VCI_SQL}) g USING (px_id, year) WHERE f.px_id IN ({_CROP}))
    SELECT px_id, year, onset, planting, CASE WHEN wrsi_early >= 50 THEN 1 ELSE 0 END AS viable, round(wrsi_early, 6) AS wrsi_early, complete, {r6(' '.join(_SHORT[:-1]))}, round(cpi / 100 * 45e-1, 6) AS yield_tha
    FROM (SELECT *, CASE WHEN s_water + s_heat + s_veg IS NOT NULL THEN least(greatest((1 - s_water) * (1 - s_heat) * (1 - s_veg), 0), 1) * 100 END AS cpi
          FROM (SELECT *, CASE WHEN complete = 1 THEN {SW} END AS s_water FROM allpx))""")
def _(spark, sf):
    """The season over the year end: fallback onset, viability, staged balance and CPI on crop pixels and own soils."""
    out = P.short_rains_product(I.climate(spark, sf), I.rain_rows(spark, sf), veg(spark, sf), P.SeasonParams(MAIZE_EARLY, 28, 34, 28, 32), (1995, 2000),
                                SO.texture_whc(I.soil_layers(spark, sf)), maize(spark, sf))
    return rounded(out, "wrsi_early", *_SHORT)


@query("plan_county_report", f"""
    SELECT s.*, mean_wrsi, mean_deficit_mm, fail_pct, poor_or_fail_frac FROM ({skill_sql('county', 15)}) s LEFT JOIN (
      SELECT county, round_even(avg(wrsi), 1) AS mean_wrsi, round_even(avg(deficit_mm), 1) AS mean_deficit_mm, round_even(avg(CASE WHEN wrsi < 50 THEN 1e0 ELSE 0e0 END) * 100, 1) AS fail_pct,
             round_even(avg(CASE WHEN wrsi_class <= 2 THEN 1e0 ELSE 0e0 END), 3) AS poor_or_fail_frac FROM v_pixels WHERE wrsi BETWEEN 0 AND 100 GROUP BY ALL HAVING count(*) >= 15) USING (county)""")
def _(spark, sf):
    return P.county_report(I.pixels(spark, sf), P.SeasonParams())


_TOK = lambda x: f"((list_position({MONTH_LIST}, {x}[1:3]) - 1) * 3 + CAST({x}[6:6] AS INTEGER))"
_WIN = lambda c: f"{_TOK(f'{c}[1:6]')} AS a_{c[0]}, {_TOK(f'{c}[8:13]')} AS b_{c[0]}"
_KC = "CASE crop " + " ".join(f"WHEN '{k}' THEN {kc('dsp', c)}" for k, c in CROPS.items()) + " END"
_LGP = "CASE crop " + " ".join(f"WHEN '{k}' THEN {c.lgp}" for k, c in CROPS.items()) + " END"


@query("plan_calendar_products", f"""
    WITH cal AS (SELECT s_suppkey AS cid, country, lower(crop) AS crop, season, a_s AS sos_start, CASE WHEN b_s < a_s THEN b_s + 36 ELSE b_s END AS sos_end,
                        a_i AS win_start, CASE WHEN b_i < a_i THEN b_i + 36 ELSE b_i END AS win_end
                 FROM (SELECT *, {_WIN('sos_detection_window')}, {_WIN('indicative_planting_window')} FROM v_calendar WHERE crop_viability IN ('High', 'Medium'))),
    px AS (SELECT s_suppkey AS px_id, n_name AS country FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    prod AS (SELECT px_id, cal.* , {_LGP} AS lgp FROM px JOIN cal USING (country)
             WHERE EXISTS (SELECT 1 FROM v_mask m WHERE m.px_id = px.px_id AND m.classification = 100 AND m.product = CASE WHEN crop = 'maize' THEN 'maize' ELSE 'temporarycrops' END)),
    c2 AS (SELECT px_id, year, dekad AS gd, p, et0 FROM v_climate UNION ALL SELECT px_id, year - 1, dekad + 36, p, et0 FROM v_climate WHERE year > 1995),
    ser AS (SELECT c2.*, prod.* EXCLUDE (px_id) FROM c2 JOIN prod USING (px_id) WHERE gd BETWEEN least(sos_start, greatest(sos_start - 1, 1)) AND sos_end + lgp + 1),
    ons AS (SELECT cid, px_id, year, min(CASE WHEN p >= 25 AND p1 + p2 >= 20 AND p / greatest(et0, 1e-3) >= 5e-1 THEN gd END) AS planting
            FROM (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM ser WHERE gd BETWEEN sos_start AND sos_end WINDOW w AS (PARTITION BY cid, px_id, year ORDER BY gd)) GROUP BY ALL),
    dem AS (SELECT *, {_KC} * et0 AS wr FROM (SELECT ser.*, planting, gd - planting AS dsp FROM ser JOIN ons USING (cid, px_id, year) WHERE planting IS NOT NULL)),
    bal AS (SELECT cid, px_id, year, CASE WHEN n = full_n THEN list_reduce(s, lambda a, x: {{'sw': greatest(least(a.sw + x.p - least(a.sw + x.p, x.wr), a.cap), 0e0),
             'aet': a.aet + least(a.sw + x.p, x.wr), 'wr': a.wr + x.wr, 'p': 0e0, 'cap': a.cap}}, {{'sw': 0e0, 'aet': 0e0, 'wr': 0e0, 'p': 0e0, 'cap': cap}}) END AS r
            FROM (SELECT cid, px_id, year, any_value(whc_mm) AS cap, count(*) AS n, any_value(sos_end + lgp + 1 - greatest(sos_start - 1, 1) + 1) AS full_n,
                         list({{'sw': 0e0, 'aet': 0e0, 'wr': wr, 'p': p, 'cap': 0e0}} ORDER BY gd) AS s FROM dem JOIN ({WHC_SQL}) USING (px_id) GROUP BY ALL)),
    yr AS (SELECT DISTINCT px_id, year FROM v_climate),
    one AS (SELECT prod.*, yr.year, planting, r.aet / greatest(r.wr, 1e-6) * 100 AS wrsi FROM prod JOIN yr USING (px_id) LEFT JOIN ons USING (cid, px_id, year) LEFT JOIN bal USING (cid, px_id, year))
    SELECT country, crop, season, sos_start, sos_end, win_start, win_end, count(*) AS n_seasons, count(planting) AS n_onset, count(wrsi) AS n_complete, round(avg(planting), 6) AS mean_onset,
           round(avg(CASE WHEN planting IS NOT NULL THEN CASE WHEN planting BETWEEN win_start AND win_end THEN 1 ELSE 0 END END), 6) AS hit_rate, round(avg(wrsi), 6) AS mean_wrsi,
           round(avg(CASE WHEN wrsi < 50 THEN 1 WHEN wrsi IS NOT NULL THEN 0 END) * 100, 6) AS fail_pct
    FROM one GROUP BY ALL""")
def _(spark, sf):
    """Every viable row of the season calendar, on its country's crop pixels and their soils."""
    z = zones(spark, sf).withColumnRenamed("county", "country")
    out = P.calendar_products(I.climate(spark, sf), z, I.calendar(spark, sf), CA.crop_table(spark), I.crop_mask(spark, sf), SO.texture_whc(I.soil_layers(spark, sf)))
    return rounded(out, "mean_onset", "hit_rate", "mean_wrsi", "fail_pct")


@query("plan_excess_product", f"""
    WITH RECURSIVE {AER_SQL}, {GATE_SQL}, wl AS ({AER_OUT})
    SELECT o.px_id, o.year, CASE WHEN o.onset IS NULL THEN NULL WHEN max_dry_days <= 7 AND onset_acc_mm >= 20 THEN 0 ELSE 1 END AS false_start, onset_acc_mm, waterlog_idx, CAST(spi3 >= 15e-1 AS INTEGER) AS spi3_wet
    FROM v_onset o LEFT JOIN diag USING (px_id, year) LEFT JOIN wl USING (px_id, year) LEFT JOIN ({SPI_SQL}) USING (px_id, year)""")
def _(spark, sf):
    out = P.excess_product(I.planting(spark, sf), I.rain_daily(spark, sf), SO.hydraulics(I.soil_layers(spark, sf)),
                           RA.spi_flags(spi(spark, sf)), P.SeasonParams())
    return rounded(out, "waterlog_idx")
