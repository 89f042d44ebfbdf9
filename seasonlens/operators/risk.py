"""Stress fractions, crop performance index, production, alert classes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seasonlens import config as C
from seasonlens.config import CropParams
from seasonlens.functions.classes import asap_class
from seasonlens.functions.dekads import dekad_start
from seasonlens.functions.masks import clamp, floor_at
from seasonlens.operators.balance import STAGES, season_series
from seasonlens.operators.frames import BITS, PX, bit_set, in_years
from seasonlens.operators.onset import SEASON


def stage_deficit(stage: str) -> Column:
    """1 - AET/WR of a stage; a stage without demand counts as fully short."""
    return clamp(1 - F.col(f"aet_{stage}") / floor_at(f"wr_{stage}", 1e-6), 0.0, 1.0)


def water_stress() -> Column:
    return clamp(sum((stage_deficit(s) * C.KY[s] for s in STAGES), F.lit(0.0)), 0.0, 1.0)


def heat_stress(
    temps: DataFrame, planting: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Heat-degree-dekads above the cap during flowering -> loss fraction, of planted seasons."""
    s = season_series(temps, max(1, sos_start), sos_end + p.flo_end + 1, keys, fields=("tmax_c",))
    pl = planting.filter(F.col("planting").isNotNull()).select(*keys, "planting")
    return add_heat_stress(s.join(pl, list(keys)), p).select(*keys, "s_heat")


def add_heat_stress(seasons: DataFrame, p: CropParams, series: str = "s") -> DataFrame:
    """Add s_heat from a season's array of dekads that carry gd and tmax_c; NULL where a flowering dekad
    is masked or missing."""
    dsp = lambda x: x["gd"] - F.col("planting")
    flowering = F.filter(series, lambda x: (dsp(x) >= p.veg_end) & (dsp(x) < p.flo_end))
    hot = F.aggregate("_flo", F.lit(0.0), lambda a, x: a + floor_at(x["tmax_c"] - C.HEAT_CAP_C, 0.0))
    return seasons.withColumn("_flo", flowering).withColumn(
        "_hot", F.when(F.size("_flo") == p.flo_end - p.veg_end, hot)).withColumn(
        "s_heat", clamp(F.col("_hot") * C.HEAT_LOSS, 0.0, 1.0)).drop("_hot", "_flo")


def season_of(d: Column, sos_start: int, sos_end: int, years: Sequence[int]) -> Column:
    """Season years whose [start of window, start of its last dekad + 40 d) holds day d."""
    end_year = 0 if sos_end <= 36 else 1
    last = (sos_end - 1) % 36 + 1
    return F.filter(
        F.array(F.year(d), F.year(d) - 1),
        lambda y: (d >= dekad_start(y, F.lit(sos_start)))
        & (d < F.date_add(dekad_start(y + end_year, F.lit(last)), 40)),
    )


def seasonal_peak(
    obs: DataFrame, sos_start: int, sos_end: int, scale: float, date_col: str = "d",
    keys: Sequence[str] = PX, years: tuple[int, int] | None = None,
) -> DataFrame:
    """Season peak of a raw index per pixel and season year.  ``years``: the season years whose whole
    window the record covers; the first and last year of a wrapping season are not among them."""
    d = F.col(date_col)
    rows = obs.filter(in_years(date_col, years[0], years[1] + 1)) if years else obs
    rows = rows.withColumn("year", F.explode(season_of(d, sos_start, sos_end, ())))
    return (
        (rows.filter(F.col("year").between(*years)) if years else rows)
        .groupBy(*keys, "year").agg((F.max("raw") * scale).alias("peak"))
    )


def _peak_history(peaks: DataFrame, clim: tuple[int, int], keys: Sequence[str]) -> DataFrame:
    """A pixel has one peak a year: its history is a window over a few dozen rows, and peaks are read once."""
    past, w = F.when(F.col("year").between(*clim), F.col("peak")), Window.partitionBy(*keys)
    return peaks.withColumns({"_lo": F.min(past).over(w), "_hi": F.max(past).over(w),
                              "_mu": F.avg(past).over(w), "_sd": F.stddev_pop(past).over(w)})


def vci_stress(peaks: DataFrame, clim: tuple[int, int], keys: Sequence[str] = PX) -> DataFrame:
    """Down-weighted 1 - VCI (position between the historical minimum and maximum peak)."""
    vci = clamp((F.col("peak") - F.col("_lo")) / floor_at(F.col("_hi") - F.col("_lo"), 1e-3), 0.0, 1.0)
    return _peak_history(peaks, clim, keys).select(*keys, "year", clamp((1 - vci) * C.VEG_WEIGHT, 0.0, 1.0).alias("s_veg"))


def zfpar_stress(peaks: DataFrame, clim: tuple[int, int], keys: Sequence[str] = PX) -> DataFrame:
    """Down-weighted shortfall of the standardised canopy peak; z = -2 is full stress."""
    z = (F.col("peak") - F.col("_mu")) / floor_at("_sd", 1e-6)
    return _peak_history(peaks, clim, keys).select(
        *keys, "year", clamp(clamp(-z / C.ZFPAR_FULL, 0.0, 1.0) * C.VEG_WEIGHT, 0.0, 1.0).alias("s_veg"))


def performance_index(stresses: DataFrame, ym: float = C.YM_SHORT_THA) -> DataFrame:
    """Multiplicative CPI 0..100 and yield, from s_water, s_heat, s_veg."""
    rel = (1 - F.col("s_water")) * (1 - F.col("s_heat")) * (1 - F.col("s_veg"))
    return stresses.withColumn("cpi", clamp(rel, 0.0, 1.0) * 100).withColumn("yield_tha", F.col("cpi") / 100 * ym)


def performance_index_additive() -> Column:
    """Additive variant: 100 (1 - sum of Ky x stage deficit)."""
    return clamp((1 - sum((stage_deficit(s) * C.KY[s] for s in STAGES), F.lit(0.0))) * 100, 0.0, 100.0)


def production(pixels: DataFrame, keys: Sequence[str], pixel_ha: float = C.PIXEL_HA) -> DataFrame:
    """Tonnes per zone from pixel yields inside the plausible range."""
    y = F.when(F.col("yield_tha").between(0, 15), F.col("yield_tha"))
    return pixels.groupBy(*keys).agg((F.sum(y) * pixel_ha).alias("production_t"))


# ---- alerts -----------------------------------------------------------------------------------
def affected_share(flags: DataFrame, hazard: str, keys: Sequence[str]) -> DataFrame:
    """Percent of crop pixels with the hazard, and its alert class."""
    pct = F.avg(F.col(hazard).cast("double")) * 100
    return flags.groupBy(*keys).agg(pct.alias("affected_pct")).withColumn("asap", asap_class("affected_pct"))


def persistent_hazard(flags: DataFrame, hazard: str, keys: Sequence[str] = SEASON, index: str = "gd",
                      last: int = 2 * (BITS - 1)) -> DataFrame:
    """Hazard active in two consecutive dekads at some point of the season, up to dekad ``last``.

    Active dekads become bitmaps that overlap by one dekad; one meets itself shifted by one exactly
    when two dekads are adjacent.  A hazard past ``last`` is an error.
    """
    i, step = F.col(index), BITS - 1
    words = range(-(-last // step))
    on = (F.col(hazard) == 1) & F.when(i.between(0, last), True).otherwise(F.raise_error(F.lit("dekad past the last one")).cast("boolean"))
    bits = [bit_set(i - k * step, on & i.between(k * step, (k + 1) * step)).alias(f"_b{k}") for k in words]
    met = [F.col(f"_b{k}").bitwiseAND(F.shiftleft(f"_b{k}", 1)) != 0 for k in words]
    return flags.groupBy(*keys).agg(*bits).select(*keys, F.greatest(*met, F.lit(False)).cast("int").alias("persistent"))


def stage_weight(rows: DataFrame, markers: DataFrame, keys: Sequence[str] = SEASON) -> DataFrame:
    """Ky of the growth interval each dekad falls in; 0 outside sos..maturity.

    Equi-join on the season, then interval tests on its four markers.
    """
    gd = F.col("gd")
    ky = (
        F.when((gd < F.col("sos")) | (gd > F.col("maturity_dekad")), 0.0)
        .when(gd < F.col("peak_vegetative_dekad"), C.KY["veg"])
        .when(gd < F.col("grain_filling_dekad"), C.KY["flo"])
        .when(gd <= F.col("maturity_dekad"), C.KY["grf"])
    )
    m = markers.select(*keys, "sos", "peak_vegetative_dekad", "grain_filling_dekad", "maturity_dekad")
    return rows.join(m, list(keys)).withColumn("ky", ky)


def hazard_products(rows: DataFrame, hazards: Sequence[str], keys: Sequence[str] = SEASON) -> DataFrame:
    """Dekad, month (3 dekads) and season hazard flags, plus the any-hazard hotspot, in one pass."""
    month = F.floor((F.col("gd") - 1) / 3).cast("int") + 1
    base = rows.withColumn("month", month)
    flags = [F.max(F.col(h)).alias(h) for h in hazards]
    out = base.groupingSets(
        [[*keys, "month", "gd"], [*keys, "month"], list(keys)], *keys, "month", "gd"
    ).agg(*flags, F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "dekad").when(F.col("_g") == 1, "month").otherwise("season")
    return out.withColumns({"product": level, "hotspot": F.greatest(*[F.col(h) for h in hazards])}).drop("_g")
