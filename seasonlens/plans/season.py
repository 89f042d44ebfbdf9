"""End-to-end season products, each one lazy plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seasonlens.config import MAIZE, YM_MAIN_THA, YM_SHORT_THA, CropParams
from seasonlens.functions.classes import wrsi_class
from seasonlens.operators import balance as B, observations as OB, onset as O, rainfall as RA, risk as R, rollup as U
from seasonlens.sources import calendars as CA


@dataclass(frozen=True)
class SeasonParams:
    crop: CropParams = MAIZE
    sos_start: int = 7
    sos_end: int = 15
    win_start: int = 8
    win_end: int = 12
    use_prior: bool = True
    ppet_gate: bool = True
    false_start_gate: bool = True
    ltn_pad: int = 2
    years: tuple[int, int] | None = None  # season years; None: all that the data hold
    absent: str = "dry"  # what a day without a rain row is: "dry" (records of rainy days) or "unknown" (full records)


def _seasons(climate: DataFrame, p: SeasonParams) -> DataFrame:
    """Season rows with the ordered dekads of the balance and the rainfall onset."""
    lo, hi = B.balance_range(p.crop, p.sos_start, p.sos_end)
    aggs = O.onset_aggs(p.sos_start, p.sos_end, "et0" if p.ppet_gate else None)
    return B.season_series(climate, lo, hi, extra=aggs, years=p.years).select(
        "px_id", "year", "s", O.onset_rule(p.sos_start, p.sos_end, p.ppet_gate).alias("onset"))


def on_crop(crop: DataFrame | None, *tables: DataFrame) -> list[DataFrame]:
    """The tables' crop pixels, taken before anything else moves; all pixels without a mask."""
    return [t if crop is None else OB.masked_to(t, crop) for t in tables]


def rain_led_product(climate: DataFrame, zones: DataFrame, p: SeasonParams, whc: DataFrame | None = None,
                     min_px: int = 1, crop: DataFrame | None = None) -> DataFrame:
    """When did the rains start and did the crop get enough water, per zone and level 'county'.

    climate: px_id, year, dekad, p, et0; zones: px_id, county.  Seasons without an onset stay in
    the counts.  ``crop``: pixels of the crop mask.
    """
    climate, = on_crop(crop, climate)
    seasons = _seasons(climate, p).withColumn("planting", F.col("onset"))
    # one shuffle per season serves the onset rule and the balance; no self-join
    px = B.add_water_balance(B.with_capacity(seasons, whc), p.crop, B.balance_range(p.crop, p.sos_start, p.sos_end))
    px = px.select("px_id", "year", "planting", "wrsi", "deficit_mm").join(zones.select("px_id", "county"), "px_id")
    ok = F.col("planting").isNotNull()
    return px.groupBy("county").agg(
        F.count(F.lit(1)).alias("n_seasons"), F.count("planting").alias("n_onset"),
        F.avg("planting").alias("mean_onset"),
        F.avg(F.when(ok, F.col("planting").between(p.win_start, p.win_end).cast("int"))).alias("hit_rate"),
        F.avg(F.when(ok, F.col("wrsi"))).alias("mean_wrsi"), F.avg(F.when(ok, F.col("deficit_mm"))).alias("mean_deficit_mm"),
        (F.avg(F.when(ok & F.col("wrsi").isNotNull(), (F.col("wrsi") < 50).cast("int"))) * 100).alias("fail_pct"),
    ).filter(F.col("n_seasons") >= min_px)


def planting_product(g: DataFrame, daily: DataFrame, p: SeasonParams, prior: DataFrame | None = None,
                     t_normal: DataFrame | None = None) -> DataFrame:
    """Greenness-led planting: season start -> emergence lag -> false-start gate."""
    sos = O.detect_sos(g, p.sos_start, p.sos_end, prior if p.use_prior else None, p.ltn_pad)
    pl = O.planting_thermal(sos, t_normal, p.crop.crop) if t_normal is not None else O.planting_fixed(sos, p.crop.crop)
    return O.gate_false_starts(pl, daily, bounds=planting_bounds(p), absent=p.absent) if p.false_start_gate else pl


def planting_bounds(p: SeasonParams) -> tuple[int, int]:
    """Possible planting dekads: the season window less the longest emergence lag."""
    return p.sos_start - 3, p.sos_end


def season_product(g: DataFrame, climate: DataFrame, daily: DataFrame, p: SeasonParams,
                   prior: DataFrame | None = None, t_normal: DataFrame | None = None,
                   whc: DataFrame | None = None, crop: DataFrame | None = None) -> DataFrame:
    """Planting, the rainfall onset it is checked against, and the seasonal water balance.

    ``g`` may come from any fusion (cue fusion, or ``fusion.fused_series`` and ``calibrated_fill``).
    """
    g, climate, daily = on_crop(crop, g, climate, daily)
    if p.years:
        g = g.filter(F.col("year").between(*p.years))
    planting = planting_product(g, daily, p, prior, t_normal)
    px = B.with_capacity(planting.join(_seasons(climate, p), ["px_id", "year"], "left"), whc)
    return B.add_water_balance(px, p.crop, B.balance_range(p.crop, p.sos_start, p.sos_end)).drop("s", "whc_mm").withColumn("wrsi_class", wrsi_class("wrsi"))


def risk_product(climate: DataFrame, planting: DataFrame, veg: DataFrame, p: SeasonParams,
                 whc: DataFrame | None = None, ym: float = YM_MAIN_THA) -> DataFrame:
    """Staged balance, three stresses, CPI and yield per pixel and planted season.

    climate: px_id, year, dekad, p, et0, tmax_c; veg: px_id, year, s_veg.  Water and heat stress
    read one gathered series.
    """
    lo, hi = B.balance_range(p.crop, p.sos_start, p.sos_end, staged=True)
    series = B.season_series(climate, lo, hi, fields=("p", "et0", "tmax_c"))
    pl = planting.filter(F.col("planting").isNotNull()).select("px_id", "year", F.col("planting").cast("int").alias("planting"))
    px = B.add_staged_balance(B.with_capacity(series.join(pl, ["px_id", "year"]), whc), p.crop, (lo, hi))
    px = R.add_heat_stress(px, p.crop).withColumn("s_water", R.water_stress()).drop("s", "whc_mm")
    return R.performance_index(px.join(veg, ["px_id", "year"], "left"), ym)


def short_rains_product(climate: DataFrame, daily: DataFrame, veg: DataFrame, p: SeasonParams, clim: tuple[int, int],
                        whc: DataFrame | None = None, crop: DataFrame | None = None, ym: float = YM_SHORT_THA,
                        min_wrsi: float = 50.0) -> DataFrame:
    """The rain-anchored season that runs over the year end: onset with climatological fallback, viability of the
    early variety, and for viable plantings the staged balance, stresses, CPI and yield.

    climate: px_id, year, dekad, p, et0, tmax_c; daily: px_id, d, rain_mm; ``p`` holds the early variety and
    the wrapping window.  A season whose next-year dekads are missing is NULL from the balance on.
    """
    climate, daily = on_crop(crop, climate, daily)
    pet = "et0" if p.ppet_gate else None
    normal = O.climatological_onset(RA.dekad_climatology(daily, clim, absent=p.absent), climate, p.sos_start, p.sos_end, pet)
    onset = O.onset_with_fallback(O.rain_onset(climate, p.sos_start, p.sos_end, pet), normal)
    lo, hi = B.balance_range(p.crop, p.sos_start, p.sos_end, staged=True)
    series = B.season_series(climate, lo, hi, fields=("p", "et0", "tmax_c"), years=p.years)
    px = B.with_capacity(series.join(onset.withColumn("planting", F.col("onset")), ["px_id", "year"]), whc)
    # one gathered series serves the early balance, the staged one and the heat
    px = B.add_water_balance(px, p.crop, B.balance_range(p.crop, p.sos_start, p.sos_end)).withColumnRenamed("wrsi", "wrsi_early")
    px = px.withColumns({"viable": F.coalesce((F.col("wrsi_early") >= min_wrsi).cast("int"), F.lit(0)),
                         "planting": F.when(F.col("wrsi_early") >= min_wrsi, F.col("planting"))})
    px = R.add_heat_stress(B.add_staged_balance(px, p.crop, (lo, hi)), p.crop).withColumn("s_water", R.water_stress())
    out = R.performance_index(px.join(veg, ["px_id", "year"], "left"), ym)
    return out.select("px_id", "year", "onset", "planting", "viable", "wrsi_early", "complete", *B.STAGED, "s_water", "s_heat", "s_veg", "cpi", "yield_tha")


def calendar_products(climate: DataFrame, zones: DataFrame, calendar: DataFrame, crops: DataFrame, mask: DataFrame | None = None,
                      whc: DataFrame | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Onset, planting skill and water balance of every viable product of a season calendar, in one plan.

    calendar: rows of ``sources.calendars``; crops: ``crop_table``; zones: px_id, country; mask: px_id, product,
    classification.  Windows and crop parameters are columns, so a product is a row and not a plan; a pixel's
    dekads are gathered once for all its products: only of pixels with a product, and only from the calendar's first
    to its last dekad (the calendar is read for these two numbers).  Calendar rows that say the same are computed once
    and count as often as they occur, so the work follows the pixels and a country's different products.
    """
    same = ("country", "_crop", "season", "sos_start", "sos_end", "win_start", "win_end")
    cal = CA.with_windows(CA.viable_products(calendar)).withColumn("_crop", F.lower("crop")).groupBy(*same).agg(F.count(F.lit(1)).alias("_times"))
    cal = cal.join(crops.withColumnRenamed("crop", "_crop"), "_crop")
    px = zones.select("px_id", "country").join(cal, "country")
    if mask is not None:
        product = F.when(F.col("_crop") == "maize", "maize").otherwise("temporarycrops")
        held = mask.filter(F.col("classification") == 100).select("px_id", F.col("product").alias("_mask"))
        px = px.withColumn("_mask", product).join(held, ["px_id", "_mask"], "left_semi")
    c = CA.crop_columns()
    ss, se = F.col("sos_start"), F.col("sos_end")
    lo, hi = F.greatest(ss - 1, F.lit(1)), se + c.lgp + 1
    span = cal.agg(F.min(F.least(lo, ss)).alias("lo"), F.max(hi).alias("hi")).first()
    held = climate.join(px.select("px_id"), "px_id", "left_semi")
    rows = B.season_series(held, max(1, span.lo or 1), min(72, span.hi or 72), years=years).join(px, "px_id").withColumns({
        "_w": F.filter("s", lambda x: x["gd"].between(ss, se)), "s": F.filter("s", lambda x: x["gd"].between(lo, hi))})
    after = lambda i, n: F.get(F.col("_w"), i + n)
    starts = F.filter("_w", lambda x, i: O.rains_start(x["p"], after(i, 1)["p"], after(i, 2)["p"], x["et0"]) & (after(i, 2)["gd"] == x["gd"] + 2))
    rows = rows.withColumn("planting", F.get(starts, F.lit(0))["gd"])
    px = B.add_water_balance(B.with_capacity(rows, whc), c, (lo, hi))
    on, times = F.col("planting").isNotNull(), F.max("_times")  # one number per group: averages need no weight
    return px.groupBy("country", F.col("_crop").alias("crop"), "season", "sos_start", "sos_end", "win_start", "win_end").agg(
        (F.count(F.lit(1)) * times).alias("n_seasons"), (F.count("planting") * times).alias("n_onset"), (F.sum("complete") * times).alias("n_complete"),
        F.avg("planting").alias("mean_onset"), F.avg(F.when(on, F.col("planting").between(F.col("win_start"), F.col("win_end")).cast("int"))).alias("hit_rate"),
        F.avg(F.when(on, F.col("wrsi"))).alias("mean_wrsi"),
        (F.avg(F.when(on & F.col("wrsi").isNotNull(), (F.col("wrsi") < 50).cast("int"))) * 100).alias("fail_pct"))


def excess_product(planting: DataFrame, daily: DataFrame, hydro: DataFrame, spi: DataFrame,
                   p: SeasonParams) -> DataFrame:
    """False start, waterlogging, wet-season flag and trigger rain per pixel and season.  Each step
    adds its columns to the season rows, so the planting table is computed once."""
    px = O.add_false_start(planting, daily, bounds=planting_bounds(p), absent=p.absent)
    px = B.add_aeration_stress(px, daily, hydro, p.crop, p.sos_start, p.sos_end, absent=p.absent)
    wet = spi.select("px_id", "year", F.col("wet").alias("spi3_wet"))
    return px.select("px_id", "year", "false_start", "onset_acc_mm", "waterlog_idx").join(wet, ["px_id", "year"], "left")


def county_report(px: DataFrame, p: SeasonParams, min_px: int = 15) -> DataFrame:
    """Planting skill joined with the water-balance row of each county."""
    hist = U.dekad_histogram(px, ("county",))
    skill = U.planting_skill(hist, ("county",), p.win_start, p.win_end, min_px)
    return skill.join(U.wrsi_rows(px, ("county",), min_px).drop("n_px"), "county", "left")
