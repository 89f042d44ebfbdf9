"""Season start, rainfall onset, normals, gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.balance_sql import balance_sql
from crosscheck.registry import query
from crosscheck.util import rounded
from crosscheck.views import start
from seasonlens.config import MAIZE_EARLY
from seasonlens.operators import balance as B, onset as O, rainfall as RA
from seasonlens.functions.dekads import greenup_to_dekad

PHENO_DK = """least(greatest(CAST(ceil((greenup_days - date_diff('day', DATE '1970-01-01', make_date(year, 1, 1))) / 10139e-3) AS INTEGER), 1), 36)"""
PHENO_SQL = f"SELECT px_id, quantile_cont({PHENO_DK}, 0.5) AS pheno_ltn FROM v_pheno WHERE cycle = 1 AND greenup_days <> 32767 GROUP BY ALL"
ONSET2520 = """
    SELECT px_id, year, min(CASE WHEN p >= 25 AND p1 + p2 >= 20 AND dekad <= 13 THEN dekad END) AS onset
    FROM (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM v_rain WHERE dekad BETWEEN 7 AND 15
          WINDOW w AS (PARTITION BY px_id, year ORDER BY dekad)) GROUP BY ALL"""
LTN_SQL = f"SELECT px_id, quantile_cont(onset, 0.5) AS onset_ltn FROM ({ONSET2520}) WHERE onset IS NOT NULL GROUP BY ALL"
PRIOR_SQL = f"SELECT px_id, coalesce((onset_ltn + pheno_ltn) / 2, onset_ltn) AS prior FROM ({LTN_SQL}) FULL JOIN ({PHENO_SQL}) USING (px_id)"
TNORM_SQL = "SELECT px_id, avg((tmax_k + tmin_k) / 2) - 273.15::DOUBLE AS t_norm_c FROM v_temps_daily WHERE year(d) BETWEEN 1995 AND 2000 GROUP BY ALL"
OFF = "CAST(least(greatest(round((22 - t_norm_c) / 6) + 2, 1), 3) AS INTEGER)"


def _pheno(spark, sf):
    p = I.phenology(spark, sf).filter(F.col("cycle") == 1)
    return O.median_over_years(p.withColumn("dk", greenup_to_dekad("greenup_days", "year")), "dk", "pheno_ltn")


def _onset2520(spark, sf):
    return O.rain_onset(I.rain(spark, sf), 7, 15)


def _onset_ltn(spark, sf):
    return O.median_over_years(_onset2520(spark, sf), "onset", "onset_ltn")


def _prior(spark, sf, mode="rainfall_led"):
    return O.season_prior(_onset_ltn(spark, sf), _pheno(spark, sf), mode)


def _tnorm(spark, sf):
    t = I.temps_daily(spark, sf).withColumn("tmean_k", (F.col("tmax_k") + F.col("tmin_k")) / 2)
    return O.temperature_normal(t, (1995, 2000))


# ---- greenness-led ---------------------------------------------------------------------------
@query("sos1_detect", "SELECT px_id, year, sos, round(amp, 6) AS amp FROM v_sos")
def _(spark, sf):
    return rounded(I.sos(spark, sf), "amp")


def _sos_sql(rising: bool, prior: bool) -> str:
    return f"""
    SELECT px_id, year, min(CASE WHEN g >= lo + (hi - lo) * 25e-2 {'AND nxt - g > 0' if rising else ''}
           {'AND coalesce(abs(dekad - prior) <= 2, true)' if prior else ''} THEN dekad END) AS sos
    FROM (SELECT *, min(g) OVER w AS lo, max(g) OVER w AS hi, lead(g) OVER (PARTITION BY px_id, year ORDER BY dekad) AS nxt
          FROM v_g WHERE dekad BETWEEN 7 AND 15 WINDOW w AS (PARTITION BY px_id, year))
    {f'LEFT JOIN ({PRIOR_SQL}) USING (px_id)' if prior else ''} GROUP BY ALL"""


@query("sos1_with_prior", _sos_sql(True, True))
def _(spark, sf):
    return O.detect_sos(I.greenness(spark, sf), 7, 15, _prior(spark, sf)).drop("amp")


@query("sos1_as_coded", _sos_sql(False, False))
def _(spark, sf):
    return O.detect_sos(I.greenness(spark, sf), 7, 15, as_coded=True).drop("amp")


@query("sos2_signal", "SELECT px_id, year, round(amp, 6) AS amp, CASE WHEN sos IS NULL THEN 0 ELSE 1 END AS detected FROM v_sos")
def _(spark, sf):
    return rounded(O.signal_strength(I.sos(spark, sf)).drop("sos"), "amp")


@query("sos3_simple_variant", f"SELECT px_id, year, sos, sos - 2 AS planting FROM ({_sos_sql(False, False)})")
def _(spark, sf):
    return O.planting_fixed(O.detect_sos(I.greenness(spark, sf), 7, 15, as_coded=True), "maize").drop("amp")


@query("plant1_fixed_offset", "SELECT px_id, year, sos, sos - 1 AS planting FROM v_sos")
def _(spark, sf):
    return O.planting_fixed(I.sos(spark, sf), "teff").drop("amp")


@query("plant2_thermal_offset", f"""
    SELECT px_id, year, sos, round(t_norm_c, 6) AS t_norm_c, {OFF} AS emergence_off, sos - {OFF} AS planting FROM v_sos LEFT JOIN ({TNORM_SQL}) USING (px_id)""")
def _(spark, sf):
    return rounded(O.planting_thermal(I.sos(spark, sf), _tnorm(spark, sf), "maize").drop("amp"), "t_norm_c")


@query("plant3_anomaly", """
    SELECT px_id, year, sos - 2 AS planting, sos - 2 - m AS planting_anom FROM v_sos
    LEFT JOIN (SELECT px_id, quantile_cont(sos - 2, 0.5) AS m FROM v_sos WHERE sos IS NOT NULL GROUP BY ALL) USING (px_id)""")
def _(spark, sf):
    pl = O.planting_fixed(I.sos(spark, sf), "maize").drop("sos", "amp")
    n = O.median_over_years(pl, "planting", "normal")
    return O.anomaly(pl, n, "planting", "normal", "planting_anom").drop("normal")


# ---- rainfall --------------------------------------------------------------------------------
@query("rain1_dekad_sum", "SELECT * FROM v_rain")
def _(spark, sf):
    return I.rain(spark, sf)


RUN_SQL = """
    SELECT px_id, sum(rain_mm) AS p FROM (
      SELECT px_id, rain_mm FROM v_rain_daily WHERE d >= DATE '1999-04-11' AND d < DATE '1999-04-17'
      UNION ALL SELECT px_id, rain_mm FROM v_forecast WHERE d >= DATE '1999-04-17' AND d < DATE '1999-04-21') GROUP BY ALL"""


@query("rain2_running_dekad", f"SELECT px_id, 1999 AS year, 11 AS dekad, p FROM ({RUN_SQL})")
def _(spark, sf):
    return RA.running_dekad(I.rain_daily(spark, sf), I.forecast(spark, sf), 1999, 11)


@query("rain3_replaced_dekad", f"""
    SELECT * FROM v_rain WHERE NOT (year = 1999 AND dekad = 11) UNION ALL SELECT px_id, 1999, 11, p FROM ({RUN_SQL})""")
def _(spark, sf):
    run = RA.running_dekad(I.rain_daily(spark, sf), I.forecast(spark, sf), 1999, 11)
    return RA.replace_dekad(I.rain(spark, sf), run, 1999, 11)


@query("rain4_blended_totals", """
    SELECT px_id, coalesce(o, 0) + coalesce(f, 0) AS p
    FROM (SELECT px_id, sum(rain_mm) AS o FROM v_rain_daily WHERE d > DATE '1999-04-10' AND d <= DATE '1999-04-16' GROUP BY ALL)
    FULL JOIN (SELECT px_id, sum(rain_mm) AS f FROM v_forecast WHERE d >= DATE '1999-04-17' AND d < DATE '1999-04-21' GROUP BY ALL) USING (px_id)""")
def _(spark, sf):
    obs = RA.observed_total(I.rain_daily(spark, sf), "1999-04-16")
    fc = I.forecast(spark, sf).filter(F.col("d").between("1999-04-17", "1999-04-20")).groupBy("px_id").agg(F.sum("rain_mm").alias("fc_mm"))
    return RA.blend_totals(obs, fc)


@query("rain5_climatology", "SELECT px_id, dekad, round(p, 6) AS p FROM v_clim")
def _(spark, sf):
    return rounded(RA.dekad_climatology(I.rain_rows(spark, sf), (1995, 2000), absent="dry"), "p")


_DOC = lambda name, value: f"""'"{name}":{{' || string_agg('"' || dekad || '":' || CAST(round({value}, 6) AS VARCHAR), ',' ORDER BY dekad) || '}}'"""


@query("clim1_regional_document", f"""
    SELECT '{{' || {_DOC('p', 'p')} || ',' || {_DOC('t', 't')} || ',' || {_DOC('et0', 'et0')} || '}}' AS doc
    FROM (SELECT dekad, avg(p) AS p, avg((tmax_c + tmin_c) / 2) AS t, avg(et0) AS et0 FROM v_climate GROUP BY ALL)""")
def _(spark, sf):
    return RA.climatology_document(I.climate(spark, sf).withColumn("t", (F.col("tmax_c") + F.col("tmin_c")) / 2), ["p", "t", "et0"])


@query("clim1_regional_means", """
    SELECT dekad, round(avg(p), 6) AS p, round(avg((tmax_c + tmin_c) / 2), 6) AS t, round(avg(et0), 6) AS et0 FROM v_climate GROUP BY ALL""")
def _(spark, sf):
    """The document of ``climatology_document`` read back into rows."""
    doc = RA.climatology_document(I.climate(spark, sf).withColumn("t", (F.col("tmax_c") + F.col("tmin_c")) / 2), ["p", "t", "et0"])
    m = doc.select(F.from_json("doc", "p map<string,double>, t map<string,double>, et0 map<string,double>").alias("m"))
    k = m.select("m", F.explode(F.map_keys("m.p")).alias("k"))
    return k.select(F.col("k").cast("int").alias("dekad"), *[F.element_at(F.col(f"m.{v}"), F.col("k")).alias(v) for v in ("p", "t", "et0")])


@query("onset1_rain_rule", ONSET2520)
def _(spark, sf):
    return _onset2520(spark, sf)


@query("onset2_pet_gate", "SELECT px_id, year, onset FROM v_onset")
def _(spark, sf):
    return I.onset(spark, sf)


# short-rains window 28..34: candidates 28..32
def _short_sql(src: str) -> str:
    return f"""
    SELECT px_id, year, min(CASE WHEN p >= 25 AND p1 + p2 >= 20 AND p / greatest(et0, 1e-3) >= 5e-1 AND dekad <= 32 THEN dekad END) AS onset
    FROM (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM ({src}) WHERE dekad BETWEEN 28 AND 34
          WINDOW w AS (PARTITION BY px_id, year ORDER BY dekad)) GROUP BY ALL"""


SHORT_SQL = _short_sql("SELECT px_id, year, dekad, p, et0 FROM v_climate")
SHORT_NORMAL_SQL = _short_sql("SELECT c.px_id, c.year, c.dekad, k.p, c.et0 FROM v_climate c JOIN v_clim k USING (px_id, dekad)")
FALLBACK_SQL = f"SELECT a.px_id, a.year, coalesce(a.onset, n.onset) AS onset FROM ({SHORT_SQL}) a LEFT JOIN ({SHORT_NORMAL_SQL}) n USING (px_id, year)"


def short_onset(spark, sf, cl=None):
    cl = cl if cl is not None else I.climate(spark, sf)
    normal = O.climatological_onset(RA.dekad_climatology(I.rain_rows(spark, sf), (1995, 2000), absent="dry"), cl, 28, 34)
    return O.onset_with_fallback(O.rain_onset(cl, 28, 34, "et0"), normal)


@query("onset3_normal_fallback", FALLBACK_SQL)
def _(spark, sf):
    return short_onset(spark, sf)


@query("onset4_never_onset", f"SELECT px_id, year FROM ({SHORT_SQL}) WHERE onset IS NULL")
def _(spark, sf):
    on = O.rain_onset(I.climate(spark, sf), 28, 34, "et0")
    seasons = I.grid(spark, sf).select("px_id", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return O.never_onset(seasons, on)


# ---- normals ---------------------------------------------------------------------------------
@query("ltn1_phenology_normal", PHENO_SQL)
def _(spark, sf):
    return _pheno(spark, sf)


@query("ltn2_onset_normal", LTN_SQL)
def _(spark, sf):
    return _onset_ltn(spark, sf).filter(F.col("onset_ltn").isNotNull())


@query("ltn3_onset_anomaly", f"SELECT px_id, year, onset, onset - onset_ltn AS onset_anom FROM ({ONSET2520}) LEFT JOIN ({LTN_SQL}) USING (px_id)")
def _(spark, sf):
    return O.anomaly(_onset2520(spark, sf), _onset_ltn(spark, sf), "onset", "onset_ltn", "onset_anom").drop("onset_ltn")


@query("ltn4_temperature_normal", f"SELECT px_id, round(t_norm_c, 6) AS t_norm_c FROM ({TNORM_SQL})")
def _(spark, sf):
    return rounded(_tnorm(spark, sf), "t_norm_c")


@query("ltn5_prior_rainfall_led", PRIOR_SQL)
def _(spark, sf):
    return _prior(spark, sf)


@query("ltn5_prior_phenology_led", f"SELECT px_id, coalesce(pheno_ltn, onset_ltn) AS prior FROM ({LTN_SQL}) FULL JOIN ({PHENO_SQL}) USING (px_id)")
def _(spark, sf):
    return _prior(spark, sf, "phenology_led")


# ---- gates -----------------------------------------------------------------------------------
def _gate_sql(first_day: str, src: str = "SELECT px_id, year, onset AS planting FROM v_onset WHERE onset IS NOT NULL", keep: str = "true") -> str:
    """Longest dry run and trigger rain, by gaps and islands on a dense day series."""
    return f"""
    days AS (SELECT px_id, year, planting, i, CAST({first_day} + CAST(i AS INTEGER) AS DATE) AS d FROM ({src}), (SELECT unnest(range(0, 20)) AS i) WHERE {keep}),
    dense AS (SELECT days.*, coalesce(rain_mm, 0) AS p FROM days LEFT JOIN v_rain_daily USING (px_id, d)),
    isl AS (SELECT px_id, year, i - row_number() OVER (PARTITION BY px_id, year ORDER BY i) AS grp FROM dense WHERE p < 1),
    runs AS (SELECT px_id, year, max(n) AS mx FROM (SELECT px_id, year, grp, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
    acc AS (SELECT px_id, year, sum(CASE WHEN i < 5 THEN p ELSE 0 END) AS acc FROM dense GROUP BY ALL),
    diag AS (SELECT px_id, year, planting, coalesce(mx, 0) AS max_dry_days, coalesce(acc, 0) AS onset_acc_mm
             FROM ({src}) LEFT JOIN acc USING (px_id, year) LEFT JOIN runs USING (px_id, year))"""


GATE_SQL = _gate_sql(start("year", "planting"))
# day index (planting - 7) * 10 from the start of dekad 7, scan of (17 - 7) * 10 + 22 days; the SOS-based planting may precede it
CODED_SQL = _gate_sql(f"{start('year', '7')} + CAST((planting - 7) * 10 AS INTEGER)",
                      "SELECT px_id, year, sos - 2 AS planting FROM v_sos WHERE sos IS NOT NULL",
                      "(planting - 7) * 10 + i BETWEEN 0 AND 121")


@query("gate1_dry_spell", f"WITH {GATE_SQL} SELECT px_id, year, max_dry_days FROM diag")
def _(spark, sf):
    return O.post_onset_rain(I.planting(spark, sf), I.rain_daily(spark, sf)).drop("onset_acc_mm")


@query("gate2_trigger_rain", f"WITH {GATE_SQL} SELECT px_id, year, onset_acc_mm FROM diag")
def _(spark, sf):
    return O.post_onset_rain(I.planting(spark, sf), I.rain_daily(spark, sf)).drop("max_dry_days")


@query("gate2_index_mode", f"WITH {CODED_SQL} SELECT px_id, year, max_dry_days, onset_acc_mm FROM diag")
def _(spark, sf):
    pl = O.planting_fixed(I.sos(spark, sf), "maize")
    return O.post_onset_rain(pl, I.rain_daily(spark, sf), scan=(7, 17), as_coded=True)


@query("gate3_false_start", f"""
    WITH {GATE_SQL} SELECT o.px_id, o.year, CASE WHEN max_dry_days <= 7 AND onset_acc_mm >= 20 THEN onset END AS planting,
         CASE WHEN onset IS NULL THEN NULL WHEN max_dry_days <= 7 AND onset_acc_mm >= 20 THEN 0 ELSE 1 END AS false_start
    FROM v_onset o LEFT JOIN diag USING (px_id, year)""")
def _(spark, sf):
    return O.gate_false_starts(I.planting(spark, sf), I.rain_daily(spark, sf), bounds=(7, 15)).select("px_id", "year", "planting", "false_start")


@query("gate3_continuity_only", f"""
    WITH {GATE_SQL} SELECT o.px_id, o.year, CASE WHEN max_dry_days <= 7 THEN onset END AS planting FROM v_onset o LEFT JOIN diag USING (px_id, year)""")
def _(spark, sf):
    return O.gate_false_starts(I.planting(spark, sf), I.rain_daily(spark, sf), trigger_mm=0).select("px_id", "year", "planting")


def viability(spark, sf):
    cl = I.climate(spark, sf)
    pl = short_onset(spark, sf, cl).withColumn("planting", F.col("onset"))
    w = B.water_balance(cl, pl, MAIZE_EARLY, 28, 34)
    return O.viability_gate(pl.drop("onset"), w)


VIABLE_SQL = f"""
    SELECT px_id, year, CASE WHEN wrsi >= 50 THEN onset END AS planting, wrsi, coalesce(CAST(wrsi >= 50 AS INTEGER), 0) AS viable
    FROM ({FALLBACK_SQL}) LEFT JOIN ({balance_sql(FALLBACK_SQL, MAIZE_EARLY, 28, 34, col='onset')}) USING (px_id, year)"""


@query("gate4_viability", f"SELECT px_id, year, planting, round(wrsi, 6) AS wrsi_early, viable FROM ({VIABLE_SQL})")
def _(spark, sf):
    return rounded(viability(spark, sf), "wrsi_early")


@query("lvpd1_last_viable_planting", """
    SELECT px_id, max(CASE WHEN p / greatest(et0, 1e-3) >= 5e-1 THEN gd END) - 6 AS lvpd
    FROM (SELECT *, CASE WHEN dekad >= 28 THEN dekad ELSE dekad + 36 END AS gd FROM v_ratio) WHERE gd BETWEEN 28 AND 42 GROUP BY ALL""")
def _(spark, sf):
    return O.last_viable_planting(I.ratio(spark, sf))
