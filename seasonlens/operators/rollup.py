"""Admin roll-ups: zonal statistics, skill rows, season tables, validation, agro-ecological zones.

Planting dekads take at most a few dozen values, so every planting statistic (mode, percentiles,
mean, skill) is computed from a (zone, dekad, n) histogram: one counting pass over the pixels that
combines map-side, then arithmetic on histograms.  A zone with a third of all pixels costs no more
than a small one.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seasonlens import config as C
from seasonlens.functions.classes import maturity_rank, name_key
from seasonlens.functions.dekads import dekad_label
from seasonlens.functions.masks import flag

LEVELS = (("county",), ("county", "constituency"), ("county", "constituency", "name"))


def dekad_histogram(pixels: DataFrame, keys: Sequence[str], value: str = "planting",
                    lo: int = 1, hi: int = 36) -> DataFrame:
    """(keys, dekad, n) over valid pixels."""
    dk = F.col(value).cast("int").alias("dekad")
    return pixels.filter(F.col(value).between(lo, hi)).groupBy(*keys, dk).agg(F.count(F.lit(1)).alias("n"))


def _mean(x: Column) -> Column:
    return F.sum(x * F.col("n")) / F.sum("n")


def mode_dekad() -> Column:
    """Most frequent dekad, the lowest on a tie."""
    return F.min_by("dekad", F.struct(-F.col("n"), F.col("dekad")))


def percentile_dekad(q: float) -> Column:
    return F.percentile("dekad", F.lit(q), F.col("n"))


def describe(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mode, P10/50/90, mean, population SD and count per zone."""
    mean = _mean(F.col("dekad"))
    var = _mean(F.col("dekad") * F.col("dekad")) - mean * mean
    return hist.groupBy(*keys).agg(
        mode_dekad().alias("mode"), percentile_dekad(0.1).alias("p10"), percentile_dekad(0.5).alias("p50"),
        percentile_dekad(0.9).alias("p90"), mean.alias("mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.sum("n").alias("count"))


def value_sketch(pixels: DataFrame, keys: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """(keys, n, sketch) of a continuous band: a KLL quantile sketch per zone, masked and NaN pixels left out.

    A sketch keeps a few thousand bytes however many pixels a zone has, and is built map-side, so no
    zone's values are gathered.  Stored, it stands for its pixels: levels and later dekads merge (``merge_sketches``).  Rank error is
    about 2.3 / k^0.97 (0.7 % of the pixels at 400) 99 times in 100; up to k values are kept as they are.
    """
    v = F.col(value).cast("double")
    return pixels.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser zones (or longer times) from those of finer ones, without their pixels."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketch's columns with one column per name -> rank (0 to 1) in its place."""
    return sketches.withColumns({n: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for n, q in quantiles.items()}).drop("sketch")


def skill_aggs(win_start: int, win_end: int) -> list[Column]:
    centre = (win_start + win_end) / 2.0
    off = F.col("dekad") - centre
    return [_mean(flag(F.col("dekad").between(win_start, win_end))).alias("hit_rate"),
            _mean(off).alias("bias_dek"), _mean(F.abs(off)).alias("mae_dek")]


def planting_skill(hist: DataFrame, keys: Sequence[str], win_start: int, win_end: int,
                   min_px: int = 15) -> DataFrame:
    """One shipped-format row per zone, best hit rate first."""
    r = hist.groupBy(*keys).agg(
        F.sum("n").alias("n_px"), mode_dekad().alias("modal_dekad"), _mean(F.col("dekad")).alias("mean_dekad"),
        percentile_dekad(0.1).alias("p10"), percentile_dekad(0.5).alias("p50"), percentile_dekad(0.9).alias("p90"),
        *skill_aggs(win_start, win_end)).filter(F.col("n_px") >= min_px)
    digits = {"mean_dekad": 2, "p10": 1, "p50": 1, "p90": 1, "hit_rate": 3, "bias_dek": 2, "mae_dek": 2}
    cols = [F.bround(c, digits[c]).alias(c) if c in digits else F.col(c) for c in r.columns]
    return r.select(*cols, dekad_label("modal_dekad").alias("modal_label")).orderBy(F.col("hit_rate").desc(), *keys)


def planting_skill_levels(hist: DataFrame, win_start: int, win_end: int, min_px: int = 15) -> DataFrame:
    """Levels 1-3 and the national row from one histogram at the finest level (grouping sets)."""
    keys = LEVELS[-1]
    coarse = hist.groupingSets(
        [[*LEVELS[2], "dekad"], [*LEVELS[1], "dekad"], [*LEVELS[0], "dekad"], ["dekad"]], *keys, "dekad"
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, 3).when(F.col("_g") == 2, 2).when(F.col("_g") == 6, 1).otherwise(0)
    return planting_skill(coarse.withColumn("level", level).drop("_g"), ("level", *keys), win_start, win_end, min_px)


def pixel_skill(pixels: DataFrame, win_start: int, win_end: int, value: str = "planting") -> DataFrame:
    centre = (win_start + win_end) / 2.0
    v = F.col(value)
    return pixels.withColumns({
        "hit": v.between(win_start, win_end).cast("int"), "bias": v - centre, "abserr": F.abs(v - centre)})


def wrsi_flags(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({
        "fail": (F.col("wrsi_class") <= 2).cast("int"), "good": (F.col("wrsi_class") >= 4).cast("int")})


def zonal_means(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Mean of every band per zone in one pass."""
    return pixels.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands])


def driver_windows(by_dekad: DataFrame, bands: Sequence[str], start: int, end: int,
                   keys: Sequence[str], amplitude: str | None = None) -> DataFrame:
    """Season-window mean of each driver per pixel, and the amplitude of one of them."""
    aggs = [F.avg(b).alias(f"{b}_mean") for b in bands]
    if amplitude:
        aggs.append((F.max(amplitude) - F.min(amplitude)).alias(f"{amplitude}_amp"))
    return by_dekad.filter(F.col("dekad").between(start, end)).groupBy(*keys).agg(*aggs)


def national_row(hist: DataFrame, pixels: DataFrame, bands: Sequence[str], constants: dict) -> DataFrame:
    """Distribution and band means over everything, plus run constants: one row."""
    one = F.lit(1).alias("_one")
    means = pixels.agg(*[F.avg(b).alias(b) for b in bands]).select("*", one)
    whole = describe(hist.groupBy("dekad").agg(F.sum("n").alias("n")), ()).select("*", one)
    return whole.join(means, "_one").drop("_one").withColumns({k: F.lit(v) for k, v in constants.items()})


def wrsi_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 8, positive: bool = False) -> DataFrame:
    """Mean WRSI, mean deficit, % below 50 and the class-based failure share."""
    w = F.col("wrsi")
    ok = (w > 0 if positive else w >= 0) & (w <= 100) & ~F.isnan(w.cast("double"))
    return pixels.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_px"), F.bround(F.avg("wrsi"), 1).alias("mean_wrsi"),
        F.bround(F.avg("deficit_mm"), 1).alias("mean_deficit_mm"),
        F.bround(F.avg(flag(w < 50)) * 100, 1).alias("fail_pct"),
        F.bround(F.avg(flag(F.col("wrsi_class") <= 2)), 3).alias("poor_or_fail_frac"),
    ).filter(F.col("n_px") >= min_px)


def spi_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 5) -> DataFrame:
    s = pixels.filter(F.col("planting").between(1, 36) & F.col("spi3").isNotNull() & ~F.isnan("spi3"))
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.bround(F.avg(flag(F.col("spi3") <= -1)) * 100, 1).alias("spi3_dry_pct"),
        F.bround(F.avg("spi3"), 2).alias("spi3_mean")).filter(F.col("_n") >= min_px).drop("_n")


def median_where(band: str, lo: float, hi: float, min_px: int, digits: int = 1, scale: float = 1.0) -> Column:
    """Median of the valid values, NULL below the minimum count.  ``percentile`` keeps value
    counts, and these bands are stored as integers, so its state is at most a few hundred entries."""
    v = F.col(band) * scale if scale != 1.0 else F.col(band)
    v = F.when(v.between(lo, hi), v)
    return F.when(F.count(v) >= min_px, F.bround(F.percentile(v, F.lit(0.5)), digits))


def stage_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 5, hi: int = 54) -> DataFrame:
    names = {"peak_vegetative_dekad": "pkv_dekad", "flowering_dekad": "flo_dekad",
             "grain_filling_dekad": "grf_dekad", "maturity_dekad": "mat_dekad"}
    return pixels.groupBy(*keys).agg(*[median_where(b, 1, hi, min_px).alias(o) for b, o in names.items()])


CPI_BANDS = ("wrsi_veg", "wrsi_flo", "wrsi_grf", "wsi_veg", "wsi_flo", "wsi_grf", "cpi",
             "s_water", "s_heat", "s_veg")


def cpi_aggs(min_px: int = 5) -> list[Column]:
    y = F.when(F.col("yield_tha_x100").between(0, 1500), F.col("yield_tha_x100"))  # hundredths, exact
    flo = F.col("wrsi_flo")
    fail = F.when(flo.between(0, 100), flag(flo < 50))
    return [
        *[median_where(b, 0, 100, min_px).alias(b) for b in CPI_BANDS],
        F.when(F.count(y) >= min_px, F.bround(F.percentile(y, F.lit(0.5)), 0) / 100).alias("yield_tha"),
        F.when(F.count(y) >= min_px, F.bround(F.sum(y) * C.PIXEL_HA / 100, 0)).alias("total_yield_t"),
        F.when(F.count(fail) >= min_px, F.bround(F.avg(fail) * 100, 1)).alias("failflo_pct"),
    ]


def cpi_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 5) -> DataFrame:
    return pixels.filter(F.col("planting").between(1, 36)).groupBy(*keys).agg(*cpi_aggs(min_px))


def excess_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 5, watch: float = 25.0) -> DataFrame:
    return pixels.filter(F.col("waterlog_idx").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.bround(F.avg("false_start") * 100, 1).alias("false_start_pct"),
        F.bround(F.avg("waterlog_idx"), 1).alias("waterlog_idx"),
        F.bround(F.avg(flag(F.col("waterlog_idx") >= watch)) * 100, 1).alias("waterlog_pct"),
        F.bround(F.avg("spi3_wet") * 100, 1).alias("spi_wet_pct")).filter(F.col("_n") >= min_px).drop("_n")


def fcci_rows(pixels: DataFrame, keys: Sequence[str], min_px: int = 5) -> DataFrame:
    v = F.when((F.col("fcci") > 0) & (F.col("fcci") <= 100), F.col("fcci"))
    return pixels.groupBy(*keys).agg(F.when(F.count(v) >= min_px, F.bround(F.avg(v), 1)).alias("fcci"))


def season_table(pixels: DataFrame, keys: Sequence[str], win_start: int, win_end: int,
                 min_px: int = 5) -> DataFrame:
    """The full season row per zone, in one pass over the pixels and one shuffle.

    pixels: keys, planting (gated), planting_all (ungated), lvpd, spi3, stage markers, CPI bands.
    Every aggregate combines map-side; mode and percentile buffers hold value counts of small
    integers.
    """
    pl = F.when(F.col("planting").between(1, 36), F.col("planting").cast("int"))
    centre = (win_start + win_end) / 2.0
    q = F.percentile(pl, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    crop = F.col("planting_all").between(1, 36)
    n_ok, n_all = F.count(pl), F.count(F.when(crop, 1))
    spi = F.when(~F.isnan("spi3"), F.col("spi3"))
    names = {"peak_vegetative_dekad": "pkv_dekad", "flowering_dekad": "flo_dekad",
             "grain_filling_dekad": "grf_dekad", "maturity_dekad": "mat_dekad"}
    masked = pixels.withColumns({b: F.when(crop, F.col(b)) for b in (*CPI_BANDS, "yield_tha_x100")})
    rows = masked.groupBy(*keys).agg(
        n_ok.alias("n_px"), F.mode(pl, deterministic=True).alias("modal_dekad"),
        F.bround(F.avg(pl), 2).alias("mean_dekad"), q.alias("_q"),
        F.bround(F.avg(flag(pl.between(win_start, win_end))), 3).alias("hit_rate"),
        F.bround(F.avg(pl - centre), 2).alias("bias_dek"), F.bround(F.avg(F.abs(pl - centre)), 2).alias("mae_dek"),
        F.bround(n_ok / F.count(F.lit(1)), 4).alias("crop_area_frac"),
        F.bround(F.try_divide(n_ok * 100.0, n_all), 1).alias("crop_viable_pct"),
        median_where("lvpd", 1, 54, min_px).alias("lvpd_dekad"),
        F.when(F.count(spi) >= min_px, F.bround(F.avg(flag(spi <= -1)) * 100, 1)).alias("spi3_dry_pct"),
        F.when(F.count(spi) >= min_px, F.bround(F.avg(spi), 2)).alias("spi3_mean"),
        *[median_where(b, 1, 54, min_px).alias(o) for b, o in names.items()],
        *cpi_aggs(min_px),
    ).filter(F.col("n_px") >= min_px)
    return rows.withColumns({
        "p10": F.bround(F.col("_q")[0], 1), "p50": F.bround(F.col("_q")[1], 1), "p90": F.bround(F.col("_q")[2], 1),
        "modal_label": dekad_label("modal_dekad")}).drop("_q")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the first row per key.  ``min_by`` of the whole row combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_columns(table: DataFrame, extra: DataFrame, keys: Sequence[str], order: str,
                  columns: Sequence[str]) -> DataFrame:
    """Left-merge columns into a table by its full key, the extra side de-duplicated first."""
    one = first_per_key(extra.select(*dict.fromkeys([*keys, order, *columns])), keys, order)
    return table.join(one.select(*keys, *columns), list(keys), "left")


# ---- skill across products --------------------------------------------------------------------
def weighted_skill(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], weight: str = "n_px") -> DataFrame:
    """Count-weighted average of zone rows, empty zones skipped."""
    w = F.col(weight)
    return rows.filter(w > 0).groupBy(*by).agg(
        *[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in metrics], F.sum(w).alias("n"))


def skill_by_product(rows: DataFrame, zone: str, product: str, values: Sequence[str], metric: str) -> DataFrame:
    """Zones down, products across."""
    return rows.groupBy(zone).pivot(product, list(values)).agg(F.max(metric))


def equal_width_bins(rows: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Histogram over [min, max], the maximum falling in the last bin."""
    if keys:
        x = rows.join(rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), list(keys))
    else:
        ends = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        x = rows.withColumn("_e", ends).withColumns({"_lo": F.col("_e.lo"), "_hi": F.col("_e.hi")}).drop("_e")
    at = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    idx = F.least(F.coalesce(at, F.lit(bins // 2)), F.lit(bins - 1))  # a constant lies in the middle
    return x.filter(F.col(value).isNotNull()).groupBy(*keys, idx.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def area_distribution(hist: DataFrame, win_start: int, win_end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Area, mode, weighted quantile dekads and share inside the window.

    A quantile is the first dekad whose cumulative count reaches q x total.  The running sum is
    over at most 36 rows per key.
    """
    total = hist.groupBy(*keys, "dekad").agg(F.sum("n").alias("n"))
    h = F.array_sort(F.collect_list(F.struct("dekad", "n")))
    s = total.groupBy(*keys).agg(
        h.alias("_h"), F.sum("n").alias("n_px"), mode_dekad().alias("modal_dekad"),
        _mean(F.col("dekad")).alias("mean_dekad"),
        (F.sum(F.when(F.col("dekad").between(win_start, win_end), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("in_window_pct"))

    def quantile(q: float) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("int").alias("at"))
        return F.aggregate("_h", zero, lambda a, x: F.struct(
            (a["cum"] + x["n"]).alias("cum"),
            F.coalesce(a["at"], F.when(a["cum"] + x["n"] >= F.col("n_px") * q, x["dekad"])).alias("at")))["at"]

    return s.select(*keys, "n_px", (F.col("n_px") * C.PIXEL_HA).alias("area_ha"), "modal_dekad", "mean_dekad",
                    quantile(0.1).alias("p10"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"), "in_window_pct")


def worst_units(rows: DataFrame, error: str, k: int, tie: Sequence[str]) -> DataFrame:
    return rows.filter(F.col(error).isNotNull()).orderBy(F.abs(F.col(error)).desc(), *tie).limit(k)


def lowest_units(rows: DataFrame, metric: str, k: int, tie: Sequence[str]) -> DataFrame:
    return rows.orderBy(F.col(metric).asc(), *tie).limit(k)


# ---- agro-ecological zones --------------------------------------------------------------------
def aez_planting(hist: DataFrame, meta: DataFrame, min_px: int = 15) -> DataFrame:
    """Planting statistics per zone code, ordered early, medium, late, then by pixels."""
    r = hist.groupBy("aez").agg(
        F.sum("n").alias("n_px"), mode_dekad().alias("modal_dekad"),
        F.bround(percentile_dekad(0.1), 1).alias("p10"), F.bround(percentile_dekad(0.5), 1).alias("median"),
        F.bround(percentile_dekad(0.9), 1).alias("p90"), F.bround(_mean(F.col("dekad")), 2).alias("mean_dekad"),
    ).filter(F.col("n_px") >= min_px)
    return r.join(meta.filter(F.col("belt").isNotNull()), "aez").withColumn(
        "modal_label", dekad_label("modal_dekad")
    ).orderBy(maturity_rank("maturity_class"), F.col("n_px").desc(), "aez")


def aez_by_maturity(aez_rows: DataFrame) -> DataFrame:
    """Pixel-weighted modal dekad, zone count and up to six sample codes."""
    return aez_rows.groupBy("maturity_class").agg(
        F.sum("n_px").alias("pixels"),
        F.bround(F.sum(F.col("modal_dekad") * F.col("n_px")) / F.sum("n_px"), 2).alias("wtd_modal_dekad"),
        F.count_distinct("aez").alias("n_zones"),
        F.slice(F.array_sort(F.collect_set("aez")), 1, 6).alias("samples"))


def aez_wrsi(pixels: DataFrame, min_px: int = 15) -> DataFrame:
    w = F.col("wrsi")
    return pixels.filter((w > 0) & (w <= 100) & F.col("belt").isNotNull()).groupBy("aez", "maturity_class").agg(
        F.count(F.lit(1)).alias("n_px"), F.bround(F.avg("wrsi"), 1).alias("mean_wrsi"),
        F.bround(F.avg(flag(F.col("wrsi_class") <= 2)) * 100, 1).alias("fail_pct")).filter(F.col("n_px") >= min_px)


def aez_influence(hist: DataFrame) -> dict[str, DataFrame]:
    """Timing by maturity class, by belt (> 30 pixels) and by moisture zone, and the early-late
    verdict.  hist: maturity_class, belt, zone, dekad, n."""
    def quartiles(by: str) -> DataFrame:
        return hist.groupBy(by).agg(
            percentile_dekad(0.25).alias("q25"), percentile_dekad(0.5).alias("median"),
            percentile_dekad(0.75).alias("q75"), F.sum("n").alias("n_px"))

    mat = quartiles("maturity_class")
    med = lambda name: F.max(F.when(F.col("maturity_class") == name, F.col("median")))
    mean = _mean(F.col("dekad"))
    return {
        "maturity": mat,
        "belt": quartiles("belt").filter(F.col("n_px") > 30),
        "zone": hist.filter(F.col("zone").isNotNull()).groupBy("zone").agg(
            mean.alias("mean_dekad"),
            F.sqrt(F.greatest(_mean(F.col("dekad") * F.col("dekad")) - mean * mean, F.lit(0.0))).alias("sd_dekad"),
            F.sum("n").alias("n_px")).filter(F.col("n_px") > 30),
        "verdict": mat.agg((med("early") - med("late")).alias("spread")).withColumn(
            "verdict", F.when(F.abs("spread") < 1, "negligible").otherwise("modest")),
    }


def class_shares(pixels: DataFrame, cls: str, value: str) -> DataFrame:
    """Share of pixels per class and the mean of a value over all pixels."""
    by = pixels.filter(F.col(cls).isNotNull()).groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("_s"))
    every = Window.partitionBy(F.lit(1))  # a handful of class rows
    n, total = F.sum("n").over(every), F.sum("_s").over(every)
    return by.select(cls, "n", (F.col("n") * 100.0 / n).alias("share_pct"), (total / n).alias(f"mean_{value}"))


# ---- farmer validation ------------------------------------------------------------------------
def observed_dekads(units: DataFrame, ward_obs: DataFrame, county_obs: DataFrame) -> DataFrame:
    """Attach the observed dekad (ward, else county) and the error of the estimate.

    units: county, name, modal_dekad; ward_obs: county, ward, dk; county_obs: county, dk.
    """
    u = units.withColumns({"_c": name_key("county"), "_w": name_key("name")})
    w = ward_obs.select(name_key("county").alias("_c"), name_key("ward").alias("_w"), F.col("dk").alias("_dw"))
    c = county_obs.select(name_key("county").alias("_c"), F.col("dk").alias("_dc"))
    return u.join(w, ["_c", "_w"], "left").join(c, "_c", "left").withColumn(
        "obs_plant_dk", F.coalesce("_dw", "_dc")
    ).withColumn("plant_err", F.col("modal_dekad") - F.col("obs_plant_dk")).drop("_c", "_w", "_dw", "_dc")


def validation_metrics(rows: DataFrame, keys: Sequence[str] = (), est: str = "est_dk", obs: str = "obs_dk") -> DataFrame:
    e = F.col(est) - F.col(obs)
    r = rows.filter(F.col(est).isNotNull() & F.col(obs).isNotNull())
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(flag(F.abs(e) <= 1)) * 100).alias("within1_pct"),
        (F.avg(flag(F.abs(e) <= 2)) * 100).alias("within2_pct"), F.try_divide(F.covar_pop(est, obs), F.stddev_pop(est) * F.stddev_pop(obs)).alias("r"))


def farmer_weighted(rows: DataFrame, keys: Sequence[str] = (), est: str = "est_dk", obs: str = "obs_dk",
                    farmers: str = "farmers") -> DataFrame:
    w = F.greatest(F.coalesce(F.col(farmers), F.lit(0)), F.lit(0))
    e = F.col(est) - F.col(obs)
    n = F.greatest(F.sum(w), F.lit(1))
    return rows.filter(e.isNotNull()).groupBy(*keys).agg(
        (F.sum(e * w) / n).alias("bias_w"), (F.sum(F.abs(e) * w) / n).alias("mae_w"))


def live_or_shipped(obs: DataFrame, live: DataFrame, key: str = "county", min_match: int = 5) -> DataFrame:
    """Live estimates when at least min_match units match, else the shipped estimate of every unit.

    The match count is a scalar subquery, so the choice is made inside one plan.
    """
    matched = obs.join(live.select(key, F.col("est_dk").alias("_live")), key)
    use_live = matched.agg(F.count(F.lit(1)) >= min_match).scalar()
    both = obs.join(live.select(key, F.col("est_dk").alias("_live")), key, "left").withColumn("_use", use_live)
    est = F.when(F.col("_use"), F.col("_live").cast("double")).otherwise(F.col("modal_dekad").cast("double"))
    return both.filter(~F.col("_use") | F.col("_live").isNotNull()).select(
        key, "obs_dk", est.alias("est_dk"),
        F.when(F.col("_use"), "live").otherwise("shipped").alias("source"))


def ablation(variants: dict[str, DataFrame], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Same metrics for each variant, side by side."""
    stacked = None
    for name, df in variants.items():
        rows = df.select(*keys, *metrics, F.lit(name).alias("variant"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy(*keys).pivot("variant", list(variants)).agg(
        *[F.max(m).alias(m) for m in metrics])
