"""Zonal statistics, admin rows, skill, agro-ecological zones, validation, ablation."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.balance_queries import AEZ_SQL, with_aez
from crosscheck.onset_queries import TNORM_SQL, _onset2520, _pheno, _prior, _sos_sql, _tnorm
from crosscheck.registry import query
from crosscheck.util import r6, rounded
from crosscheck.views import label
from seasonlens.functions.classes import name_key
from seasonlens.functions.dekads import date_to_dekad
from seasonlens.operators import observations as OB, onset as O, rollup as U
from seasonlens.sources.tables import new_path

Z3 = ["county", "constituency", "name"]


def hist(spark, sf, keys=Z3):
    return U.dekad_histogram(I.pixels(spark, sf), keys)


# the statistics straight from the pixels, not from a histogram
MODE = "first(planting ORDER BY n DESC, planting)"


def stats_sql(keys: str, src: str = "v_pixels") -> str:
    on = f"USING ({keys})" if keys else "ON true"
    k = keys + "," if keys else ""
    return f"""
    SELECT {k} mode, p10, p50, p90, mean, std, count FROM (
      SELECT {k} quantile_cont(planting, 0.1) AS p10, quantile_cont(planting, 0.5) AS p50, quantile_cont(planting, 0.9) AS p90,
             avg(planting) AS mean, stddev_pop(planting) AS std, count(*) AS count FROM {src} WHERE planting BETWEEN 1 AND 36 GROUP BY ALL)
    JOIN (SELECT {k} planting AS mode FROM (SELECT {k} planting, count(*) AS n FROM {src} WHERE planting BETWEEN 1 AND 36 GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY {keys or '1'} ORDER BY n DESC, planting) = 1) {on}"""


@query("zst1_zonal_distribution", f"SELECT county, constituency, name, mode, {r6('p10 p50 p90')}, count FROM ({stats_sql('county, constituency, name')})")
def _(spark, sf):
    return rounded(U.describe(hist(spark, sf), Z3).drop("mean", "std"), "p10", "p50", "p90")


@query("zst2_zonal_describe", f"SELECT county, constituency, mode, {r6('p10 p50 p90 mean std')}, count FROM ({stats_sql('county, constituency')})")
def _(spark, sf):
    return rounded(U.describe(hist(spark, sf, Z3[:2]), Z3[:2]), "p10", "p50", "p90", "mean", "std")


BANDS = "wrsi deficit_mm cpi s_water s_heat s_veg hit bias abserr fail good"
METRIC_SQL = """
    SELECT *, CASE WHEN planting IS NULL THEN NULL WHEN planting BETWEEN 8 AND 12 THEN 1 ELSE 0 END AS hit, planting - 10 AS bias, abs(planting - 10) AS abserr,
           CASE WHEN wrsi_class <= 2 THEN 1 ELSE 0 END AS fail, CASE WHEN wrsi_class >= 4 THEN 1 ELSE 0 END AS good FROM v_pixels"""


def metrics(spark, sf):
    return U.wrsi_flags(U.pixel_skill(I.pixels(spark, sf), 8, 12))


def _avgs(cols: str) -> str:
    return ", ".join(f"round(avg({c}), 6) AS {c}" for c in cols.split())


@query("zst3_zonal_means", f"SELECT county, {_avgs(BANDS)} FROM ({METRIC_SQL}) GROUP BY ALL")
def _(spark, sf):
    return rounded(U.zonal_means(metrics(spark, sf), ["county"], BANDS.split()), *BANDS.split())


@query("zst4_driver_attributes", f"""
    SELECT px_id, year, {r6('ndvi_mean ndre1_mean vv_mean vh_mean rvi_mean fpar_mean g_mean g_amp t_norm_c', 9)}, pheno_ltn, sos, sos - 2 AS planting FROM (
      SELECT px_id, year, avg(ndvi) AS ndvi_mean, avg(ndre1) AS ndre1_mean, avg(vv) AS vv_mean, avg(vh) AS vh_mean, avg(rvi) AS rvi_mean, avg(fpar) AS fpar_mean, avg(g) AS g_mean, max(g) - min(g) AS g_amp
      FROM v_s1 LEFT JOIN v_s2 USING (px_id, year, dekad) LEFT JOIN v_fpar USING (px_id, year, dekad) JOIN v_g USING (px_id, year, dekad) WHERE dekad BETWEEN 7 AND 15 GROUP BY ALL)
    LEFT JOIN (SELECT px_id, quantile_cont(least(greatest(CAST(ceil((greenup_days - date_diff('day', DATE '1970-01-01', make_date(year, 1, 1))) / 10139e-3) AS INTEGER), 1), 36), 0.5) AS pheno_ltn
               FROM v_pheno WHERE cycle = 1 AND greenup_days <> 32767 GROUP BY ALL) USING (px_id)
    LEFT JOIN ({TNORM_SQL}) USING (px_id) LEFT JOIN v_sos USING (px_id, year)""")
def _(spark, sf):
    keys = ["px_id", "year", "dekad"]
    s2, s1, fp = I.s2(spark, sf), I.s1(spark, sf), I.fpar(spark, sf)
    g = OB.fused_greenness(s2, s1, fp)
    by = s1.join(s2.select(*keys, "ndvi", "ndre1"), keys, "left").join(fp, keys, "left").join(g, keys)
    m = U.driver_windows(by, ["ndvi", "ndre1", "vv", "vh", "rvi", "fpar", "g"], 7, 15, ["px_id", "year"], "g")
    sos = O.planting_fixed(O.detect_sos(g, 7, 15), "maize").drop("amp")
    out = m.join(_pheno(spark, sf), "px_id", "left").join(_tnorm(spark, sf), "px_id", "left").join(sos, ["px_id", "year"], "left")
    return rounded(out, "ndvi_mean", "ndre1_mean", "vv_mean", "vh_mean", "rvi_mean", "fpar_mean", "g_mean", "g_amp", "t_norm_c", n=9)


@query("zst5_describe_with_means", f"""
    SELECT county, mode, {r6('p10 p50 p90 mean std')}, count, wrsi, hit FROM ({stats_sql('county')}) JOIN (SELECT county, {_avgs('wrsi hit')} FROM ({METRIC_SQL}) GROUP BY ALL) USING (county)""")
def _(spark, sf):
    d = U.describe(hist(spark, sf, ["county"]), ["county"])
    out = d.join(U.zonal_means(metrics(spark, sf), ["county"], ["wrsi", "hit"]), "county")
    return rounded(out, "p10", "p50", "p90", "mean", "std", "wrsi", "hit")


@query("zst6_national_row", f"""
    SELECT mode, {r6('p10 p50 p90 mean std')}, count, wrsi, hit, bias, 'All' AS country, 8 AS cal_win_start, 12 AS cal_win_end
    FROM ({stats_sql('')}) JOIN (SELECT {_avgs('wrsi hit bias')} FROM ({METRIC_SQL})) ON true""")
def _(spark, sf):
    out = U.national_row(hist(spark, sf), metrics(spark, sf), ["wrsi", "hit", "bias"], {"country": "All", "cal_win_start": 8, "cal_win_end": 12})
    return rounded(out, "p10", "p50", "p90", "mean", "std", "wrsi", "hit", "bias")


SK = """
    count(*) AS n_px, round_even(avg(planting), 2) AS mean_dekad, round_even(quantile_cont(planting, 0.1), 1) AS p10, round_even(quantile_cont(planting, 0.5), 1) AS p50,
    round_even(quantile_cont(planting, 0.9), 1) AS p90, round_even(avg(CASE WHEN planting BETWEEN 8 AND 12 THEN 1e0 ELSE 0e0 END), 3) AS hit_rate,
    round_even(avg(planting - 10), 2) AS bias_dek, round_even(avg(abs(planting - 10)), 2) AS mae_dek"""


def skill_sql(keys: str, min_px: int, src: str = "v_pixels") -> str:
    return f"""
    SELECT *, {label('modal_dekad')} AS modal_label FROM (
      SELECT {keys}, {SK} FROM {src} WHERE planting BETWEEN 1 AND 36 GROUP BY ALL HAVING count(*) >= {min_px})
    JOIN (SELECT {keys}, planting AS modal_dekad FROM (SELECT {keys}, planting, count(*) AS n FROM {src} WHERE planting BETWEEN 1 AND 36 GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, planting) = 1) USING ({keys})"""


@query("zst7_levels", " UNION ALL ".join(
    f"SELECT {lvl} AS level, {cols}, n_px, modal_dekad, mean_dekad, p10, p50, p90, hit_rate, bias_dek, mae_dek, modal_label FROM ({skill_sql(keys, 15, src)})"
    for lvl, keys, cols, src in (
        (3, "county, constituency, name", "county, constituency, name", "v_pixels"),
        (2, "county, constituency", "county, constituency, NULL AS name", "v_pixels"),
        (1, "county", "county, NULL AS constituency, NULL AS name", "v_pixels"),
        (0, "nat", "NULL AS county, NULL AS constituency, NULL AS name", "(SELECT 1 AS nat, planting FROM v_pixels)"))))
def _(spark, sf):
    return U.planting_skill_levels(hist(spark, sf), 8, 12)


# ---- admin rows ------------------------------------------------------------------------------
@query("adm1_planting_skill", skill_sql("county, constituency, name", 15))
def _(spark, sf):
    return U.planting_skill(hist(spark, sf), Z3, 8, 12)


@query("adm2_wrsi_rows", """
    SELECT county, constituency, count(*) AS n_px, round_even(avg(wrsi), 1) AS mean_wrsi, round_even(avg(deficit_mm), 1) AS mean_deficit_mm,
           round_even(avg(CASE WHEN wrsi < 50 THEN 1e0 ELSE 0e0 END) * 100, 1) AS fail_pct, round_even(avg(CASE WHEN wrsi_class <= 2 THEN 1e0 ELSE 0e0 END), 3) AS poor_or_fail_frac
    FROM v_pixels WHERE wrsi BETWEEN 0 AND 100 GROUP BY ALL HAVING count(*) >= 8""")
def _(spark, sf):
    return U.wrsi_rows(I.pixels(spark, sf), Z3[:2])


@query("adm3_spi_rows", """
    SELECT county, constituency, round_even(avg(CASE WHEN spi3 <= -1 THEN 1e0 ELSE 0e0 END) * 100, 1) AS spi3_dry_pct, round_even(avg(spi3), 2) AS spi3_mean
    FROM v_pixels WHERE planting BETWEEN 1 AND 36 GROUP BY ALL HAVING count(*) >= 5""")
def _(spark, sf):
    return U.spi_rows(I.pixels(spark, sf), Z3[:2])


def med(x: str, lo: int, hi: int, out: str, d: int = 1, ok: str = "true") -> str:
    v = f"CASE WHEN {ok} AND {x} BETWEEN {lo} AND {hi} THEN {x} END"
    return f"CASE WHEN count({v}) >= 5 THEN round_even(quantile_cont({v}, 0.5), {d}) END AS {out}"


STAGE = (("peak_vegetative_dekad", "pkv_dekad"), ("flowering_dekad", "flo_dekad"), ("grain_filling_dekad", "grf_dekad"), ("maturity_dekad", "mat_dekad"))


@query("adm4_stage_rows", f"SELECT county, constituency, name, {', '.join(med(b, 1, 54, o) for b, o in STAGE)} FROM v_pixels GROUP BY ALL")
def _(spark, sf):
    return U.stage_rows(I.pixels(spark, sf), Z3)


def cpi_sql(ok: str = "true") -> str:
    v = f"CASE WHEN {ok} AND yield_tha_x100 BETWEEN 0 AND 1500 THEN yield_tha_x100 END"
    f = f"CASE WHEN {ok} AND wrsi_flo BETWEEN 0 AND 100 THEN CASE WHEN wrsi_flo < 50 THEN 1e0 ELSE 0e0 END END"
    return ", ".join([*[med(b, 0, 100, b, ok=ok) for b in U.CPI_BANDS],
                      f"CASE WHEN count({v}) >= 5 THEN round_even(quantile_cont({v}, 0.5), 0) / 100 END AS yield_tha",
                      f"CASE WHEN count({v}) >= 5 THEN round_even(sum({v}) * 625e-2 / 100, 0) END AS total_yield_t",
                      f"CASE WHEN count({f}) >= 5 THEN round_even(avg({f}) * 100, 1) END AS failflo_pct"])


@query("adm5_cpi_rows", f"SELECT county, constituency, name, {cpi_sql()} FROM v_pixels WHERE planting BETWEEN 1 AND 36 GROUP BY ALL")
def _(spark, sf):
    return U.cpi_rows(I.pixels(spark, sf), Z3)


@query("adm6_excess_rows", """
    SELECT county, constituency, round_even(avg(false_start) * 100, 1) AS false_start_pct, round_even(avg(waterlog_idx), 1) AS waterlog_idx,
           round_even(avg(CASE WHEN waterlog_idx >= 25 THEN 1e0 ELSE 0e0 END) * 100, 1) AS waterlog_pct, round_even(avg(spi3_wet) * 100, 1) AS spi_wet_pct FROM v_pixels GROUP BY ALL""")
def _(spark, sf):
    return U.excess_rows(I.pixels(spark, sf), Z3[:2])


@query("adm7_fcci_rows", "SELECT county, constituency, round_even(avg(CASE WHEN fcci > 0 AND fcci <= 100 THEN fcci END), 1) AS fcci FROM v_pixels GROUP BY ALL")
def _(spark, sf):
    return U.fcci_rows(I.pixels(spark, sf), Z3[:2])


PIX_GATED = "(SELECT * REPLACE (CASE WHEN false_start = 0 THEN planting END AS planting) FROM v_pixels)"


@query("adm8_season_table", f"""
    SELECT * FROM ({skill_sql('county, constituency, name', 5, PIX_GATED)}) JOIN (
      SELECT county, constituency, name, round_even(count(CASE WHEN planting BETWEEN 1 AND 36 THEN 1 END) / count(*), 4) AS crop_area_frac,
             round_even(count(CASE WHEN planting BETWEEN 1 AND 36 THEN 1 END) * 100e0 / count(CASE WHEN planting_all BETWEEN 1 AND 36 THEN 1 END), 1) AS crop_viable_pct,
             {med('lvpd', 1, 54, 'lvpd_dekad')}, round_even(avg(CASE WHEN spi3 <= -1 THEN 1e0 ELSE 0e0 END) * 100, 1) AS spi3_dry_pct, round_even(avg(spi3), 2) AS spi3_mean,
             {', '.join(med(b, 1, 54, o) for b, o in STAGE)}, {cpi_sql('planting_all BETWEEN 1 AND 36')} FROM {PIX_GATED} GROUP BY ALL) USING (county, constituency, name)""")
def _(spark, sf):
    px = I.pixels(spark, sf).withColumn("planting", F.when(F.col("false_start") == 0, F.col("planting")))
    return U.season_table(px, Z3, 8, 12)


@query("adm9_column_merge", """
    SELECT t.county, t.constituency, t.name, t.n_px, e.wrsi FROM (SELECT county, constituency, name, count(*) AS n_px FROM v_pixels GROUP BY ALL) t
    LEFT JOIN (SELECT county, constituency, name, wrsi FROM v_pixels WHERE cpi > 100 QUALIFY row_number() OVER (PARTITION BY county, constituency, name ORDER BY px_id) = 1) e USING (county, constituency, name)""")
def _(spark, sf):
    px = I.pixels(spark, sf)
    t = px.groupBy(*Z3).agg(F.count(F.lit(1)).alias("n_px"))
    return U.merge_columns(t, px.filter(F.col("cpi") > 100), Z3, "px_id", ["wrsi"])


# ---- skill -----------------------------------------------------------------------------------
@query("skl1_pixel_skill", f"SELECT px_id, hit, CAST(bias AS DOUBLE) AS bias, CAST(abserr AS DOUBLE) AS abserr FROM ({METRIC_SQL})")
def _(spark, sf):
    return metrics(spark, sf).select("px_id", "hit", "bias", "abserr")


@query("skl2_wrsi_flags", f"SELECT px_id, fail, good FROM ({METRIC_SQL})")
def _(spark, sf):
    return metrics(spark, sf).select("px_id", "fail", "good")


UNIT_SQL = f"""
    SELECT county, constituency, year, count(planting) AS n_px, avg(hit) AS hit, avg(bias) AS bias, avg(abserr) AS mae FROM ({METRIC_SQL}) GROUP BY ALL"""


def units(spark, sf):
    return metrics(spark, sf).groupBy("county", "constituency", "year").agg(
        F.count("planting").alias("n_px"), F.avg("hit").alias("hit"), F.avg("bias").alias("bias"), F.avg("abserr").alias("mae"))


@query("skl3_weighted_by_product", f"SELECT year, {', '.join(f'round(sum({m} * n_px) / sum(n_px), 6) AS {m}' for m in ('hit', 'bias', 'mae'))}, sum(n_px) AS n FROM ({UNIT_SQL}) WHERE n_px > 0 GROUP BY ALL")
def _(spark, sf):
    return rounded(U.weighted_skill(units(spark, sf), ["year"], ["hit", "bias", "mae"]), "hit", "bias", "mae")


@query("skl4_cross_product", "SELECT constituency, " + ", ".join(f"round(max(CASE WHEN year = {y} THEN hit END), 6) AS \"{y}\"" for y in range(1995, 2002)) + f" FROM ({UNIT_SQL}) GROUP BY ALL")
def _(spark, sf):
    out = U.skill_by_product(units(spark, sf), "constituency", "year", list(range(1995, 2002)), "hit")
    return rounded(out, *[str(y) for y in range(1995, 2002)])


@query("skl5_histogram", f"""
    SELECT CAST(least(floor((bias - lo) * 25 / (hi - lo)), 24) AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT bias, min(bias) OVER () AS lo, max(bias) OVER () AS hi FROM ({UNIT_SQL})) WHERE bias IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return U.equal_width_bins(units(spark, sf), "bias", 25)


@query("skl6_area_distribution", f"""
    SELECT t.county, t.n_px, t.n_px * 625e-2 AS area_ha, m.planting AS modal_dekad, round(t.mean_dekad, 6) AS mean_dekad, q.p10, q.p50, q.p90, round(t.in_window_pct, 6) AS in_window_pct
    FROM (SELECT county, count(*) AS n_px, avg(planting) AS mean_dekad, sum(CASE WHEN planting BETWEEN 8 AND 12 THEN 1 ELSE 0 END) * 100e0 / count(*) AS in_window_pct FROM v_pixels WHERE planting IS NOT NULL GROUP BY ALL) t
    JOIN (SELECT county, planting FROM (SELECT county, planting, count(*) AS n FROM v_pixels WHERE planting IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY county ORDER BY n DESC, planting) = 1) m USING (county)
    JOIN (SELECT county, min(CASE WHEN cum >= tot * 1e-1 THEN planting END) AS p10, min(CASE WHEN cum >= tot * 5e-1 THEN planting END) AS p50, min(CASE WHEN cum >= tot * 9e-1 THEN planting END) AS p90
          FROM (SELECT county, planting, sum(n) OVER (PARTITION BY county ORDER BY planting) AS cum, sum(n) OVER (PARTITION BY county) AS tot
                FROM (SELECT county, planting, count(*) AS n FROM v_pixels WHERE planting IS NOT NULL GROUP BY ALL)) GROUP BY ALL) q USING (county)""")
def _(spark, sf):
    return rounded(U.area_distribution(hist(spark, sf), 8, 12, ["county"]), "mean_dekad", "in_window_pct")


@query("skl7_worst_units", f"SELECT constituency, year, round(bias, 6) AS bias FROM ({UNIT_SQL}) WHERE bias IS NOT NULL ORDER BY abs(bias) DESC, constituency, year LIMIT 8")
def _(spark, sf):
    return rounded(U.worst_units(units(spark, sf), "bias", 8, ["constituency", "year"]).select("constituency", "year", "bias"), "bias")


@query("skl7_lowest_hit_rate", f"SELECT constituency, year, round(hit, 6) AS hit FROM ({UNIT_SQL}) ORDER BY hit NULLS FIRST, constituency, year LIMIT 4")
def _(spark, sf):
    return rounded(U.lowest_units(units(spark, sf), "hit", 4, ["constituency", "year"]).select("constituency", "year", "hit"), "hit")


# ---- agro-ecological zones -------------------------------------------------------------------
AEZ_STATS = f"""
    SELECT aez, belt, zone, maturity_class, n_px, modal_dekad, modal_label, p10, p50 AS median, p90, mean_dekad
    FROM ({skill_sql('aez, belt, zone, maturity_class', 15, f"(SELECT *  REPLACE (coalesce(zone, -1) AS zone) FROM ({AEZ_SQL}) WHERE belt IS NOT NULL)")})"""


def aez_stats(spark, sf):
    px = I.pixels(spark, sf)
    meta = with_aez(px.select("aez").distinct())
    return U.aez_planting(U.dekad_histogram(px, ["aez"]), meta)


@query("aez5_planting_by_zone", f"SELECT aez, belt, zone, maturity_class, n_px, modal_dekad, modal_label, p10, median, p90, mean_dekad FROM ({AEZ_STATS})")
def _(spark, sf):
    return aez_stats(spark, sf)


@query("aez6_by_maturity", f"""
    SELECT maturity_class, sum(n_px) AS pixels, round_even(sum(modal_dekad * n_px) / sum(n_px), 2) AS wtd_modal_dekad, count(DISTINCT aez) AS n_zones,
           array_to_string(list_slice(list_sort(list(DISTINCT aez)), 1, 6), ',') AS samples FROM ({AEZ_STATS}) GROUP BY ALL""")
def _(spark, sf):
    return U.aez_by_maturity(aez_stats(spark, sf)).withColumn("samples", F.array_join("samples", ","))


@query("aez7_wrsi_by_zone", f"""
    SELECT aez, maturity_class, count(*) AS n_px, round_even(avg(wrsi), 1) AS mean_wrsi, round_even(avg(CASE WHEN wrsi_class <= 2 THEN 1e0 ELSE 0e0 END) * 100, 1) AS fail_pct
    FROM ({AEZ_SQL}) WHERE wrsi > 0 AND wrsi <= 100 AND belt IS NOT NULL GROUP BY ALL HAVING count(*) >= 15""")
def _(spark, sf):
    return U.aez_wrsi(with_aez(I.pixels(spark, sf)))


@query("aez7_wrsi_by_maturity", f"""
    SELECT maturity_class, round(sum(mean_wrsi * n_px) / sum(n_px), 6) AS mean_wrsi, round(sum(fail_pct * n_px) / sum(n_px), 6) AS fail_pct, sum(n_px) AS n FROM (
      SELECT aez, maturity_class, count(*) AS n_px, round_even(avg(wrsi), 1) AS mean_wrsi, round_even(avg(CASE WHEN wrsi_class <= 2 THEN 1e0 ELSE 0e0 END) * 100, 1) AS fail_pct
      FROM ({AEZ_SQL}) WHERE wrsi > 0 AND wrsi <= 100 AND belt IS NOT NULL GROUP BY ALL HAVING count(*) >= 15) GROUP BY ALL""")
def _(spark, sf):
    rows = U.aez_wrsi(with_aez(I.pixels(spark, sf)))
    return rounded(U.weighted_skill(rows, ["maturity_class"], ["mean_wrsi", "fail_pct"]), "mean_wrsi", "fail_pct")


def influence(spark, sf):
    return U.aez_influence(U.dekad_histogram(with_aez(I.pixels(spark, sf)).filter(F.col("belt").isNotNull()), ["maturity_class", "belt", "zone"]))


AEZ_OK = f"({AEZ_SQL}) WHERE planting IS NOT NULL AND belt IS NOT NULL"
QUART = "quantile_cont(planting, 0.25) AS q25, quantile_cont(planting, 0.5) AS median, quantile_cont(planting, 0.75) AS q75, count(*) AS n_px"


@query("aez8_by_maturity", f"SELECT maturity_class, {QUART} FROM {AEZ_OK} GROUP BY ALL")
def _(spark, sf):
    return influence(spark, sf)["maturity"]


@query("aez8_by_belt", f"SELECT belt, {QUART} FROM {AEZ_OK} GROUP BY ALL HAVING count(*) > 30")
def _(spark, sf):
    return influence(spark, sf)["belt"]


@query("aez8_by_moisture_zone", f"SELECT zone, round(avg(planting), 6) AS mean_dekad, round(stddev_pop(planting), 6) AS sd_dekad, count(*) AS n_px FROM {AEZ_OK} AND zone IS NOT NULL GROUP BY ALL HAVING count(*) > 30")
def _(spark, sf):
    return rounded(influence(spark, sf)["zone"], "mean_dekad", "sd_dekad")


@query("aez8_verdict", f"""
    SELECT spread, CASE WHEN abs(spread) < 1 THEN 'negligible' ELSE 'modest' END AS verdict FROM (
      SELECT quantile_cont(CASE WHEN maturity_class = 'early' THEN planting END, 0.5) - quantile_cont(CASE WHEN maturity_class = 'late' THEN planting END, 0.5) AS spread FROM {AEZ_OK})""")
def _(spark, sf):
    return influence(spark, sf)["verdict"]


@query("aez9_class_shares", f"""
    SELECT maturity_class, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS share_pct, round(sum(sum(wrsi)) OVER () / sum(count(*)) OVER (), 6) AS mean_wrsi FROM ({AEZ_SQL}) GROUP BY maturity_class""")
def _(spark, sf):
    return rounded(U.class_shares(with_aez(I.pixels(spark, sf)), "maturity_class", "wrsi"), "share_pct", "mean_wrsi")


# ---- farmer validation -----------------------------------------------------------------------
@query("val1_name_key", "SELECT px_id, trim(replace(replace(replace(upper(name || ' St.'), '''', ''), '-', ' '), '.', '')) AS key FROM v_pixels")
def _(spark, sf):
    return I.pixels(spark, sf).select("px_id", name_key(F.concat("name", F.lit(" St."))).alias("key"))


# observed dekad: median day of year of all records; wards numbered 0 and 3 have no observations of their own
OBS_SQL = """
    SELECT {k} CAST((month(d)-1)*3 + least(3, (day(d)-1)//10 + 1) AS INTEGER) AS dk, farmers FROM (
      SELECT {k} DATE '1996-12-31' + CAST(floor(quantile_cont(planting_all * 10 - 5, 0.5)) AS INTEGER) AS d, count(*) AS farmers FROM v_pixels {w} GROUP BY ALL)"""
COUNTY_OBS, WARD_OBS = OBS_SQL.format(k="county,", w=""), OBS_SQL.format(k="county, name,", w="WHERE right(name, 1) IN ('1', '2', '4')")
EST_SQL = f"SELECT county, name, modal_dekad, n_px FROM ({skill_sql('county, constituency, name', 1)})"
VAL_SQL = f"""
    SELECT e.county, e.name, e.modal_dekad, coalesce(w.dk, c.dk) AS obs_plant_dk, e.modal_dekad - coalesce(w.dk, c.dk) AS plant_err, w.farmers
    FROM ({EST_SQL}) e LEFT JOIN ({WARD_OBS}) w ON w.county = e.county AND w.name = e.name LEFT JOIN ({COUNTY_OBS}) c ON c.county = e.county"""


def counts(spark, sf):
    """Pixels per ward, planting and record, stored: every estimate and observation below reads this table."""
    path = new_path(spark, "counts")
    I.pixels(spark, sf).groupBy(*Z3, "planting", "planting_all").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path)


def estimates(c, keys):
    h = c.filter(F.col("planting").between(1, 36)).groupBy(*keys, F.col("planting").alias("dekad")).agg(F.sum("n").alias("n"))
    return U.planting_skill(h, keys, 8, 12, 1)


def observed(c, keys):
    o = c.groupBy(*keys).agg(F.floor(F.percentile(F.col("planting_all") * 10 - 5, F.lit(0.5), F.col("n"))).cast("int").alias("m"), F.sum("n").alias("farmers"))
    return o.select(*keys, date_to_dekad(F.date_add(F.lit("1996-12-31").cast("date"), F.col("m"))).alias("dk"), "farmers")


def validated(spark, sf):
    c = counts(spark, sf)
    wards = observed(c.filter(F.substring("name", -1, 1).isin("1", "2", "4")), ["county", "name"]).withColumnRenamed("name", "ward")
    est = estimates(c, Z3).select("county", "name", "modal_dekad")
    out = U.observed_dekads(est, wards, observed(c, ["county"]))
    return out.join(wards.select("county", F.col("ward").alias("name"), "farmers"), ["county", "name"], "left")


@query("val2_observed_with_fallback", f"SELECT county, name, modal_dekad, obs_plant_dk, plant_err, farmers FROM ({VAL_SQL})")
def _(spark, sf):
    return validated(spark, sf)


@query("val3_metrics", f"""
    SELECT count(*) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(CASE WHEN abs(e) <= 1 THEN 1e0 ELSE 0e0 END) * 100, 6) AS within1_pct,
           round(avg(CASE WHEN abs(e) <= 2 THEN 1e0 ELSE 0e0 END) * 100, 6) AS within2_pct, round(corr(modal_dekad, obs_plant_dk), 6) AS r FROM (SELECT *, plant_err AS e FROM ({VAL_SQL})) WHERE e IS NOT NULL""")
def _(spark, sf):
    m = U.validation_metrics(validated(spark, sf), (), "modal_dekad", "obs_plant_dk")
    return rounded(m, "bias", "mae", "rmse", "within1_pct", "within2_pct", "r")


@query("val4_farmer_weighted", f"""
    SELECT county, round(sum(plant_err * w) / greatest(sum(w), 1), 6) AS bias_w, round(sum(abs(plant_err) * w) / greatest(sum(w), 1), 6) AS mae_w
    FROM (SELECT *, greatest(coalesce(farmers, 0), 0) AS w FROM ({VAL_SQL})) WHERE plant_err IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return rounded(U.farmer_weighted(validated(spark, sf), ["county"], "modal_dekad", "obs_plant_dk"), "bias_w", "mae_w")


# live medians exist where a county has at least 20 pixels
LIVE_SQL = "SELECT county, quantile_cont(planting, 0.5) AS est_dk FROM v_pixels WHERE planting IS NOT NULL GROUP BY ALL HAVING count(*) >= {n}"
OBS5_SQL = f"SELECT o.county, o.dk AS obs_dk, s.modal_dekad FROM ({COUNTY_OBS}) o JOIN ({skill_sql('county', 1)}) s USING (county)"


def _live(spark, sf, n):
    c = counts(spark, sf)
    planted = c.filter(F.col("planting").isNotNull())
    live = planted.groupBy("county").agg(F.percentile("planting", F.lit(0.5), F.col("n")).alias("est_dk"), F.sum("n").alias("_n")).filter(F.col("_n") >= n)
    obs = observed(c, ["county"]).select("county", F.col("dk").alias("obs_dk")).join(estimates(c, ["county"]).select("county", "modal_dekad"), "county")
    return U.live_or_shipped(obs, live)


@query("val5_live_estimate", f"SELECT county, obs_dk, est_dk, 'live' AS source FROM ({OBS5_SQL}) JOIN ({LIVE_SQL.format(n=20)}) USING (county)")
def _(spark, sf):
    return _live(spark, sf, 20)


@query("val5_shipped_estimate", f"SELECT county, obs_dk, CAST(modal_dekad AS DOUBLE) AS est_dk, 'shipped' AS source FROM ({OBS5_SQL})")
def _(spark, sf):
    return _live(spark, sf, 10 ** 15)


# ---- ablation --------------------------------------------------------------------------------
def _abl(view: str, v: str) -> str:
    return (f"SELECT year, round(avg({v}), 6) AS mean, round(avg(CASE WHEN {v} BETWEEN 8 AND 12 THEN 1e0 WHEN {v} IS NOT NULL THEN 0e0 END), 6) AS hit "
            f"FROM ({view}) GROUP BY ALL")


@query("abl1_onset_gate", f"""
    SELECT a.year, a.mean AS rule_mean, a.hit AS rule_hit, b.mean AS gated_mean, b.hit AS gated_hit
    FROM ({_abl('''SELECT px_id, year, min(CASE WHEN p >= 25 AND p1 + p2 >= 20 AND dekad <= 13 THEN dekad END) AS onset FROM (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM v_rain
    WHERE dekad BETWEEN 7 AND 15 WINDOW w AS (PARTITION BY px_id, year ORDER BY dekad)) GROUP BY ALL''', 'onset')}) a JOIN ({_abl('v_onset', 'onset').replace('(v_onset)', 'v_onset')}) b USING (year)""")
def _(spark, sf):
    def score(df):
        v = F.col("onset")
        return df.groupBy("year").agg(F.avg(v).alias("mean"), F.avg(F.when(v.isNotNull(), v.between(8, 12).cast("int"))).alias("hit"))
    out = U.ablation({"rule": score(_onset2520(spark, sf)), "gated": score(I.onset(spark, sf))}, ["year"], ["mean", "hit"])
    return rounded(out, "rule_mean", "rule_hit", "gated_mean", "gated_hit")


@query("abl1_season_prior", f"""
    SELECT a.year, a.mean AS base_mean, a.hit AS base_hit, b.mean AS prior_mean, b.hit AS prior_hit
    FROM ({_abl('SELECT year, sos - 2 AS pl FROM v_sos', 'pl')}) a JOIN ({_abl('SELECT year, sos - 2 AS pl FROM (' + _sos_sql(True, True) + ')', 'pl')}) b USING (year)""")
def _(spark, sf):
    def score(df):
        v = O.planting_fixed(df, "maize")
        p = F.col("planting")
        return v.groupBy("year").agg(F.avg(p).alias("mean"), F.avg(F.when(p.isNotNull(), p.between(8, 12).cast("int"))).alias("hit"))
    g = I.greenness(spark, sf)
    out = U.ablation({"base": score(O.detect_sos(g, 7, 15)), "prior": score(O.detect_sos(g, 7, 15, _prior(spark, sf)))}, ["year"], ["mean", "hit"])
    return rounded(out, "base_mean", "base_hit", "prior_mean", "prior_hit")


@query("zst1_sketched_percentiles", """
    SELECT county, CAST(q AS INTEGER) AS q, count(*) AS n, true AS within FROM v_pixels, (SELECT unnest([10, 50, 90]) AS q) WHERE wrsi IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """County percentiles of a continuous band from ward sketches: their ranks among the pixels, within 0.01."""
    px = I.pixels(spark, sf).select("county", "constituency", "name", "wrsi")
    wards = U.value_sketch(px, ["county", "constituency", "name"], "wrsi")
    q = U.sketch_quantiles(U.merge_sketches(wards, ["county"]), {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    at = q.select("county", F.explode(F.array(*[F.struct(F.lit(p).alias("q"), F.col(f"p{p}").alias("v")) for p in (10, 50, 90)])).alias("e")).select("county", "e.*")
    below, upto = F.avg((F.col("wrsi") < F.col("v")).cast("double")), F.avg((F.col("wrsi") <= F.col("v")).cast("double"))
    return px.join(at, "county").groupBy("county", "q").agg(
        F.count(F.lit(1)).alias("n"), (F.col("q") / 100).between(below - 0.01, upto + 0.01).alias("within"))
