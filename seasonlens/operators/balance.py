"""Per-pixel ordered recurrences: crop water balance, staged monitor, aeration stress; thermal clock.

A season is at most a few dozen dekads (or ~200 days) per pixel, so each recurrence gathers that
bounded series into one sorted array and folds it with ``aggregate``.  The gathered key is
(pixel, season); its length is fixed by the calendar, not by the size of the data.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seasonlens import config as C
from seasonlens.config import SOIL, CropParams, SoilConfig
from seasonlens.functions.climate import crop_coefficient, day_length, dekad_gdd, induction_rate
from seasonlens.functions.masks import clamp, floor_at
from seasonlens.functions.dekads import dekad_start
from seasonlens.operators.frames import PX, day_record, own_year, season_days, season_frame
from seasonlens.operators.onset import SEASON


def zero() -> Column:
    return F.lit(0.0)


def season_series(climate: DataFrame, gd_lo: int, gd_hi: int, keys: Sequence[str] = SEASON,
                  extra: Sequence[Column] = (), fields: Sequence[str] = ("p", "et0"),
                  years: tuple[int, int] | None = None) -> DataFrame:
    """One row per season with its ordered dekads ``s``: array<struct<gd, fields...>>.

    climate: px_id, year, dekad, fields.  ``extra`` aggregates (such as ``onset_aggs``) ride on the
    same shuffle.  A season without a dekad in its own calendar year is none.
    """
    return season_frame(climate.select(*PX, "year", "dekad", *fields), gd_lo, gd_hi, years).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("gd", *fields))).alias("s"), own_year().alias("_own"), *extra).filter("_own").drop("_own")


def with_demand(seasons: DataFrame, p: CropParams) -> DataFrame:
    """Add ``demand``: array<struct<dsp, p, wr>>, from ``s`` and ``planting`` on the same row."""
    dsp = lambda x: x["gd"] - F.col("planting")
    return seasons.withColumn("demand", F.transform("s", lambda x: F.struct(
        dsp(x).alias("dsp"), x["p"].alias("p"), (crop_coefficient(dsp(x), p) * x["et0"]).alias("wr"))))


def _complete(span: tuple[int, int]) -> Column:
    """Every dekad of the span once, and no masked rain, demand or capacity in the season: a gap or a mask
    anywhere masks the whole result, so it is tested once and the folds below run on plain numbers."""
    inside = F.transform(F.filter("s", lambda x: x["gd"].between(*span)), lambda x: x["gd"])
    n = span[1] - span[0] + 1
    whole = (F.size(inside) == n) & (F.size(F.array_distinct(inside)) == n)
    return F.col("whc_mm").isNotNull() & whole & ~F.exists("demand", lambda x: (x["p"] + x["wr"]).isNull())


def with_capacity(rows: DataFrame, whc: DataFrame | None, soil: SoilConfig = SOIL) -> DataFrame:
    """Attach whc_mm: a table (px_id, whc_mm), else the configured constant."""
    if whc is None:
        return rows.withColumn("whc_mm", F.lit(soil.default_whc_mm))
    return rows.join(whc.select(*PX, "whc_mm"), list(PX), "left")


def _planted(planting: DataFrame, keys: Sequence[str]) -> DataFrame:
    return planting.filter(F.col("planting").isNotNull()).select(*keys, F.col("planting").cast("int").alias("planting"))


def water_balance(
    climate: DataFrame, planting: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    whc: DataFrame | None = None, soil: SoilConfig = SOIL, keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Seasonal WRSI, deficit, AET, WR and closing soil water, and whether the season is complete.

    A NULL anywhere in the season's rain or demand, or a dekad that is not there, makes the result
    NULL and ``complete`` 0.
    """
    span = balance_range(p, sos_start, sos_end)
    rows = with_capacity(season_series(climate, *span, keys).join(_planted(planting, keys), list(keys)), whc, soil)
    return add_water_balance(rows, p, span, soil).select(*keys, *BALANCE)


BALANCE = ("wrsi", "deficit_mm", "aet_mm", "wr_mm", "sw_end_mm", "complete")


def balance_range(p: CropParams, sos_start: int, sos_end: int, staged: bool = False) -> tuple[int, int]:
    return max(1, sos_start - 1), sos_end + p.lgp + (2 if staged else 1)


def add_water_balance(seasons: DataFrame, p: CropParams, span: tuple[int, int], soil: SoilConfig = SOIL) -> DataFrame:
    """The recurrence over rows that hold ``s``, planting and whc_mm; other columns are kept.

    ``span``: the dekads the balance needs.  ``s`` may run past it: demand is 0 outside the cycle.
    """
    start = F.struct((F.col("whc_mm") * soil.init_frac).alias("sw"), zero().alias("aet"), zero().alias("wr"))

    def step(a: Column, x: Column) -> Column:
        water = a["sw"] + x["p"]
        aet = F.least(water, x["wr"])
        return F.struct(
            F.greatest(F.least(water - aet, F.col("whc_mm")), zero()).alias("sw"),
            (a["aet"] + aet).alias("aet"), (a["wr"] + x["wr"]).alias("wr"))

    r = with_demand(seasons, p).withColumn(
        "_r", F.when(_complete(span), F.aggregate("demand", start, step))).drop("demand")
    return r.withColumns({
        "complete": F.col("_r").isNotNull().cast("int"),
        "wrsi": F.col("_r.aet") / floor_at(F.col("_r.wr"), 1e-6) * 100,
        "deficit_mm": F.col("_r.wr") - F.col("_r.aet"),
        "aet_mm": F.col("_r.aet"), "wr_mm": F.col("_r.wr"), "sw_end_mm": F.col("_r.sw"),
    }).drop("_r")


STAGES = ("veg", "flo", "grf")


def staged_balance(
    climate: DataFrame, planting: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    whc: DataFrame | None = None, soil: SoilConfig = SOIL, keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Running WRSI at each stage end, peak dekad water stress and AET/WR per stage.

    The snapshot at a stage end is taken once the first dekad after it has been added.
    """
    span = balance_range(p, sos_start, sos_end, staged=True)
    rows = with_capacity(season_series(climate, *span, keys).join(_planted(planting, keys), list(keys)), whc, soil)
    return add_staged_balance(rows, p, span, soil).select(*keys, *STAGED, "complete")


STAGED = tuple(f"{k}_{s}" for k in ("wrsi", "wsi", "aet", "wr") for s in STAGES)


def add_staged_balance(seasons: DataFrame, p: CropParams, span: tuple[int, int], soil: SoilConfig = SOIL) -> DataFrame:
    """The staged recurrence over rows that hold ``s``, planting and whc_mm; others are kept.
    ``span`` as in ``add_water_balance``."""
    bounds = {"veg": (0, p.veg_end), "flo": (p.veg_end, p.flo_end), "grf": (p.flo_end, p.lgp)}
    init = [(F.col("whc_mm") * soil.init_frac).alias("sw"), zero().alias("aet"), zero().alias("wr")]
    init += [zero().alias(f"{k}_{s}") for s in STAGES for k in ("wrsi", "wsi", "aet", "wr")]

    def step(a: Column, x: Column) -> Column:
        water = a["sw"] + x["p"]
        aet = F.least(water, x["wr"])
        cum_aet, cum_wr = a["aet"] + aet, a["wr"] + x["wr"]
        running = cum_aet / F.greatest(cum_wr, F.lit(1e-6)) * 100
        wsi = F.least(F.greatest(1 - aet / F.greatest(x["wr"], F.lit(1e-6)), zero()), F.lit(1.0)) * 100
        out = [F.greatest(F.least(water - aet, F.col("whc_mm")), zero()).alias("sw"),
               cum_aet.alias("aet"), cum_wr.alias("wr")]
        for s, (b, e) in bounds.items():
            on = (x["dsp"] >= b) & (x["dsp"] < e)
            out += [
                F.when(x["dsp"] == e, running).otherwise(a[f"wrsi_{s}"]).alias(f"wrsi_{s}"),
                F.when(on, F.greatest(a[f"wsi_{s}"], wsi)).otherwise(a[f"wsi_{s}"]).alias(f"wsi_{s}"),
                F.when(on, a[f"aet_{s}"] + aet).otherwise(a[f"aet_{s}"]).alias(f"aet_{s}"),
                F.when(on, a[f"wr_{s}"] + x["wr"]).otherwise(a[f"wr_{s}"]).alias(f"wr_{s}"),
            ]
        return F.struct(*out)

    r = with_demand(seasons, p).withColumn(
        "_r", F.when(_complete(span), F.aggregate("demand", F.struct(*init), step))).drop("demand")
    return r.withColumns({c: F.col(f"_r.{c}") for c in STAGED} | {"complete": F.col("_r").isNotNull().cast("int")}).drop("_r")


def aeration_stress(planting: DataFrame, daily: DataFrame, hydro: DataFrame, p: CropParams,
                    sos_start: int, sos_end: int, keys: Sequence[str] = SEASON, **kw) -> DataFrame:
    """Waterlogging index of planted seasons on soils with known hydraulics."""
    pl = planting.filter(F.col("planting").isNotNull()).select(*keys, "planting")
    out = add_aeration_stress(pl, daily, hydro, p, sos_start, sos_end, keys=keys, **kw)
    return out.filter(F.col("waterlog_idx").isNotNull()).drop("planting")


def add_aeration_stress(
    seasons: DataFrame, daily: DataFrame, hydro: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    et_mm: float = C.AER_ET_MM, scale_days: float = C.AER_SCALE_DAYS, as_coded: bool = False,
    absent: str = "dry", keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Add waterlog_idx 0..100: peak of a stage-weighted run of saturated days that resets when the
    soil drains below the anaerobiosis point; NULL without planting or soil, and where a day of the balance is unknown
    (masked; with ``absent="unknown"`` also without a row).

    Default: the balance starts on the first day of the planting dekad, by real dates, and only water
    above field capacity drains.  ``as_coded``: it starts at sos_start, the cycle's days are counted as
    (planting - sos_start) * 10 from there, so that a planting before it loses its first days, and soil
    below field capacity is lifted to it every day.  Plantings up to three dekads before sos_start are
    served.  Only rainy days are shuffled, summed by day; the fold restores the dry ones.
    """
    first, reach = (sos_start, (sos_end - sos_start + p.lgp) * 10 + 2) if as_coded else _scan(p, sos_start, sos_end)
    wet = (
        season_days(day_record(daily, absent), first, reach)
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "rain_mm"))).alias("_rain"))
    )
    n = reach if as_coded else p.lgp * 10
    opening = F.lit(0) if as_coded else planting_day(first)
    rows = seasons.join(wet, list(keys), "left").join(hydro.select(*PX, "fc_mm", "sat_mm", "tau"), list(PX), "left").withColumns({
        "onset_day": (F.col("planting") - sos_start) * 10 if as_coded else F.lit(0),
        "_open": opening,
        "thr": F.col("fc_mm") + (F.col("sat_mm") - F.col("fc_mm")) * C.AER_START,
        "_rain": F.coalesce("_rain", F.create_map().cast("map<int,double>")),
    })
    # per-day stress weight, 0 outside the crop cycle
    days = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(
            F.coalesce(F.try_element_at("_rain", F.col("_open") + i), zero()).alias("p"),
            F.when((i < F.col("onset_day")) | (i >= F.col("onset_day") + p.lgp * 10), zero())
            .when(i - F.col("onset_day") < p.veg_end * 10, C.EXCESS_WEIGHT["veg"])
            .when(i - F.col("onset_day") < p.flo_end * 10, C.EXCESS_WEIGHT["flo"])
            .otherwise(C.EXCESS_WEIGHT["grf"]).alias("w"),
        ),
    )
    fc, sat, thr, tau = F.col("fc_mm"), F.col("sat_mm"), F.col("thr"), F.col("tau")

    def run_of(a: Column) -> Column:
        # stress is 0 at and below the threshold, so the reset and the weight use one test
        stress = F.least((a["w"] - thr) / F.greatest(sat - thr, F.lit(1e-3)), F.lit(1.0))
        return F.when((a["wt"] > 0) & (a["w"] > thr), a["run"] + stress * a["wt"]).otherwise(zero())

    def step(a: Column, x: Column) -> Column:
        # the run lags the water by a day, so that it reads a stored value, not a re-evaluated one
        filled = F.least(F.greatest(a["w"] + x["p"] - et_mm, zero()), sat)
        above = F.greatest(filled - fc, zero())
        water = fc + above * (1 - tau) if as_coded else filled - above * tau
        return F.struct(water.alias("w"), x["w"].alias("wt"), run_of(a).alias("run"),
                        F.greatest(a["peak"], a["run"]).alias("peak"))

    start = F.struct((fc * C.AER_W0).alias("w"), zero().alias("wt"), zero().alias("run"), zero().alias("peak"))
    last = lambda a: F.greatest(a["peak"], a["run"], run_of(a))
    inside = lambda k: (k >= F.col("_open")) & (k < F.col("_open") + n)
    if absent == "unknown":
        whole = F.size(F.map_filter("_rain", lambda k, v: inside(k) & v.isNotNull())) == n
    else:
        whole = F.size(F.map_filter("_rain", lambda k, v: inside(k) & v.isNull())) == 0
    known = F.col("planting").isNotNull() & (fc + sat + tau).isNotNull() & whole
    return (
        rows.withColumn("_days", days).withColumn("_peak", F.when(known, F.aggregate("_days", start, step, last)))
        .withColumn("waterlog_idx", clamp(F.col("_peak") / scale_days, 0.0, 1.0) * 100)
        .select(*seasons.columns, "waterlog_idx")
    )


def _scan(p: CropParams, sos_start: int, sos_end: int) -> tuple[int, int]:
    """(first dekad, days) that hold the whole cycle of every planting from sos_start - 3 to sos_end."""
    return sos_start - 3, (sos_end - sos_start + 4) * 11 + p.lgp * 10


def planting_day(first_gd: int) -> Column:
    """Days from the start of dekad first_gd to that of the planting dekad, by the calendar."""
    return F.datediff(dekad_start("year", F.col("planting").cast("int")), dekad_start("year", F.lit(first_gd)))


def wet_dekad_exposure(
    rain: DataFrame, planting: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    wet_mm: float = C.WET_DEKAD_MM, keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Experimental dekad-based waterlogging index: worst stage-weighted wet dekad, 0..100."""
    rows = season_frame(rain.select(*PX, "year", "dekad", "p"), max(1, sos_start), sos_end + p.lgp)
    dsp = F.col("gd") - F.col("planting")
    w = (
        F.when((dsp < 0) | (dsp >= p.lgp), zero()).when(dsp < p.veg_end, C.EXCESS_WEIGHT["veg"])
        .when(dsp < p.flo_end, C.EXCESS_WEIGHT["flo"]).otherwise(C.EXCESS_WEIGHT["grf"])
    )
    over = clamp((F.coalesce(F.col("p"), zero()) - wet_mm) / wet_mm, 0.0, 1.0)
    pl = planting.filter(F.col("planting").isNotNull()).select(*keys, "planting")
    return rows.join(pl, list(keys)).groupBy(*keys).agg(
        (clamp(F.max(over * w), 0.0, 1.0) * 100).alias("waterlog_idx"))


def heavy_rain_days(
    planting: DataFrame, daily: DataFrame, p: CropParams, sos_start: int, sos_end: int,
    heavy_mm: float = 50.0, stage: str | None = None, as_coded: bool = False, absent: str = "dry", keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Days above heavy_mm in the cycle, or in one stage of it, by real dates from the planting dekad on
    (``as_coded``: by day index from sos_start).  Seasons without any get 0, seasons with an unknown day in it NULL."""
    lo = {None: 0, "veg": 0, "flo": p.veg_end, "grf": p.flo_end}[stage] * 10
    hi = {None: p.lgp, "veg": p.veg_end, "flo": p.flo_end, "grf": p.lgp}[stage] * 10
    first, reach = (sos_start, (sos_end - sos_start + p.lgp) * 10 + 2) if as_coded else _scan(p, sos_start, sos_end)
    pl = planting.filter(F.col("planting").isNotNull()).select(*keys, "planting")
    # heavy days are rare: the threshold is applied to the day's sum before the seasons meet them
    hits = season_days(day_record(daily, absent, heavy_mm), first, reach).select(*keys, "i", "rain_mm", F.lit(1).alias("_day"))
    dsp = F.col("i") - ((F.col("planting") - sos_start) * 10 if as_coded else planting_day(first))
    inside = (dsp >= lo) & (dsp < hi)
    known = F.count(F.when(inside, F.col("rain_mm"))) == hi - lo if absent == "unknown" else \
        F.count(F.when(inside, F.col("_day"))) == F.count(F.when(inside, F.col("rain_mm")))
    return pl.join(hits, list(keys), "left").groupBy(*keys).agg(
        F.when(known, F.count(F.when(inside & (F.col("rain_mm") > heavy_mm), 1))).alias("heavy_rain_days"))


# ---- thermal clock ----------------------------------------------------------------------------
def gdd_clock(
    temps: DataFrame, sos: DataFrame, maturity: DataFrame, dk_lo: int = 1, dk_hi: int = 36,
    keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Global dekad at which each growth stage is reached, and total degree-days.

    temps: px_id, year, dekad, tmax_c, tmin_c (already lapse-corrected).  A masked or absent dekad masks
    every marker not reached before it, and the total.  The running sum and the aggregate after it
    share one partitioning by season.
    """
    rows = season_frame(temps.select(*PX, "year", "dekad", "tmax_c", "tmin_c"), dk_lo, dk_hi)
    anchor = sos.filter(F.col("sos").isNotNull()).select(*keys, "sos").join(
        maturity.select(*PX, "gdd_maturity"), list(PX))
    w = Window.partitionBy(*keys).orderBy("gd").rowsBetween(Window.unboundedPreceding, 0)
    gdd = dekad_gdd("tmax_c", "tmin_c")
    active = F.when(F.col("gd") >= F.col("sos"), gdd).otherwise(zero())
    # unbroken so far: as many values as dekads since the first one
    sound = F.count(gdd).over(w) == F.col("gd") - (dk_lo - 1)
    cum = rows.join(anchor, list(keys)).withColumn("cum", F.when(sound, F.sum(active).over(w)))
    marks = [
        F.min(F.when(F.col("cum") >= F.col("gdd_maturity") * frac, F.col("gd"))).alias(f"{name}_dekad")
        for name, frac in C.STAGE_FRACTION.items()
    ]
    whole = F.count("cum") == dk_hi - dk_lo + 1
    return cum.groupBy(*keys).agg(*marks, F.when(whole, F.max("cum")).cast("int").alias("gdd_total"))


def rain_anchored_clock(temps: DataFrame, onset: DataFrame, maturity: DataFrame,
                        dk_lo: int = 28, dk_hi: int = 52) -> DataFrame:
    """Clock anchored one dekad after rainfall onset, running into the next year."""
    return gdd_clock(temps, onset.withColumn("sos", F.col("onset") + 1), maturity, dk_lo, dk_hi)


# ---- photothermal clock -----------------------------------------------------------------------
@dataclass(frozen=True)
class PhotoParams:
    """A short-day cultivar: degree-days of the juvenile phase, of induction under short days, and from initiation to
    flowering and maturity; day lengths in hours with and without response."""

    juvenile: float = 300.0
    induction: float = 150.0
    flowering: float = 450.0
    maturity: float = 900.0
    base_h: float = 12.0
    ceiling_h: float = 13.5
    elevation_deg: float = 0.0


PHASES = ("juvenile", "initiation", "flowering", "maturity")


def photothermal_clock(temps: DataFrame, sos: DataFrame, p: PhotoParams = PhotoParams(), dk_lo: int = 1, dk_hi: int = 36,
                       keys: Sequence[str] = SEASON) -> DataFrame:
    """Global dekad at which a day-length-sensitive crop ends each of its phases, NULL where it does not in dk_lo..dk_hi.

    temps: px_id, year, dekad, tmax_c, tmin_c, lat.  Degree-days from sos on first end the juvenile phase; what a dekad has left then
    drives induction, slowed by the day length, and after it the thermal time to flowering and maturity.  One
    fold carries the three clocks.  An absent, repeated or masked dekad from sos on masks the marks after it.
    """
    fields = ("tmax_c", "tmin_c", "lat")
    s = season_series(temps, dk_lo, dk_hi, keys, fields=fields).join(sos.filter(F.col("sos").isNotNull()).select(*keys, "sos"), list(keys))
    real = lambda x: (x["gd"] - 1) % 36 + 1
    doy = lambda x: F.dayofyear(dekad_start(F.col("year") + F.floor((x["gd"] - 1) / 36).cast("int"), real(x))) + 5
    # functions of a dekad are worked out before the fold, so that the fold runs on numbers
    run = F.transform(F.filter("s", lambda x: x["gd"] >= F.col("sos")), lambda x: F.struct(
        x["gd"].alias("gd"), dekad_gdd(x["tmax_c"], x["tmin_c"]).alias("gdd"),
        induction_rate(day_length(x["lat"], doy(x), p.elevation_deg), p.base_h, p.ceiling_h).alias("rate")))
    none = F.lit(None).cast("int")
    start = F.struct(zero().alias("j"), zero().alias("i"), zero().alias("t"), F.col("sos").cast("int").alias("next"),
                     *[none.alias(n) for n in PHASES])

    def step(a: Column, x: Column) -> Column:
        # an unknown dekad makes every clock NULL from here on
        gdd = F.when((x["gd"] == a["next"]) & x["rate"].isNotNull(), x["gdd"])
        j = a["j"] + gdd
        left = F.when(gdd.isNotNull(), F.greatest(j - F.greatest(a["j"], F.lit(p.juvenile)), zero()))
        i = a["i"] + left * x["rate"]
        over = F.when(a["i"] >= p.induction, left).when(
            i >= p.induction, left - (p.induction - a["i"]) / x["rate"]).when(left.isNotNull(), zero())
        t = a["t"] + over
        mark = lambda n, done: F.coalesce(a[n], F.when(done, x["gd"])).alias(n)
        return F.struct(j.alias("j"), i.alias("i"), t.alias("t"), (x["gd"] + 1).cast("int").alias("next"),
                        mark("juvenile", j >= p.juvenile), mark("initiation", i >= p.induction),
                        mark("flowering", t >= p.flowering), mark("maturity", t >= p.maturity))

    return s.withColumn("_run", run).withColumn("_r", F.aggregate("_run", start, step)).select(
        *keys, *[F.col(f"_r.{n}").alias(f"{n}_dekad") for n in PHASES])
