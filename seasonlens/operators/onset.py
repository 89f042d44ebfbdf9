"""Season start, planting dekad, rainfall onset, long-term normals and false-start gates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens import config as C
from seasonlens.functions.climate import thermal_offset
from seasonlens.functions.dekads import dekad_start
from seasonlens.functions.masks import floor_at, unmask
from seasonlens.operators.frames import (
    BITS, PX, bit_set, day_record, first_true, in_years, longest_run, own_year, season_days, season_frame, wide, wide_aggs)

SEASON = (*PX, "year")


# ---- greenness-based season start -------------------------------------------------------------
def detect_sos(
    g: DataFrame, start: int, end: int, prior: DataFrame | None = None, pad: int = 2,
    amp_frac: float = 0.25, as_coded: bool = False, keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Earliest window dekad with G past the amplitude threshold, rising, and near the prior.

    ``as_coded`` drops the rising test.  Pixels without a prior pass on the window alone.
    Output: keys, sos, amp.
    """
    s = wide(season_frame(g, start, end), keys, "gd", start, end, g="g")
    cols = {k: F.col(f"g_{k}") for k in range(start, end + 1)}
    gmin = F.least(*cols.values()) if len(cols) > 1 else cols[start]
    gmax = F.greatest(*cols.values()) if len(cols) > 1 else cols[start]
    s = s.withColumns({"_lo": gmin, "amp": gmax - gmin})
    if prior is not None:
        on = [k for k in keys if k in prior.columns]
        s = s.join(prior.select(*on, "prior"), on, "left")
    conds = {}
    for k, cur in cols.items():
        cond = cur >= F.col("_lo") + F.col("amp") * amp_frac
        if not as_coded:
            cond = cond & ((cols[k + 1] - cur > 0) if k < end else F.lit(False))
        if prior is not None:
            cond = cond & unmask(F.abs(F.lit(k) - F.col("prior")) <= pad, True)
        conds[k] = cond
    return s.select(*keys, first_true(conds).alias("sos"), "amp")


def signal_strength(sos: DataFrame) -> DataFrame:
    """Amplitude and a 0/1 detected flag."""
    return sos.withColumn("detected", F.col("sos").isNotNull().cast("int"))


def emergence_offset(crop: str) -> int:
    return C.EMERGENCE_OFFSET.get(crop, C.DEFAULT_EMERGENCE)


def planting_fixed(sos: DataFrame, crop: str) -> DataFrame:
    return sos.withColumn("planting", F.col("sos") - emergence_offset(crop))


def planting_thermal(sos: DataFrame, t_normal: DataFrame, crop: str) -> DataFrame:
    """Planting = season start minus a temperature-dependent emergence lag."""
    return sos.join(t_normal.select(*PX, "t_norm_c"), list(PX), "left").withColumns({
        "emergence_off": thermal_offset(emergence_offset(crop), "t_norm_c"),
        "planting": F.col("sos") - thermal_offset(emergence_offset(crop), "t_norm_c"),
    })


def anomaly(rows: DataFrame, normal: DataFrame, value: str, normal_col: str, out: str,
            on: Sequence[str] = PX) -> DataFrame:
    """value - normal; positive is later than usual."""
    return rows.join(normal.select(*on, normal_col), list(on), "left").withColumn(
        out, F.col(value) - F.col(normal_col))


# ---- rainfall onset ---------------------------------------------------------------------------
# Rain of the first dekad and of the next two together, and the least P / PET of the first.
FIRST_MM, NEXT_MM, RATIO_MIN = 25.0, 20.0, 0.5


def rains_start(p0: Column, p1: Column, p2: Column, et0: Column | None = None, ratio_min: float = RATIO_MIN,
                first_mm: float = FIRST_MM, next_mm: float = NEXT_MM) -> Column:
    """The 25/20 rule on three successive dekads; with ``et0`` also P0 / PET."""
    rule = (p0 >= first_mm) & (p1 + p2 >= next_mm)
    return rule if et0 is None else rule & (p0 / F.greatest(et0, F.lit(1e-3)) >= ratio_min)


def onset_aggs(start: int, end: int, pet: str | None = None) -> list[Column]:
    """Season aggregates that ``onset_rule`` reads (rows keyed by gd)."""
    return wide_aggs("gd", start, end, p="p", **({"e": pet} if pet else {}))


def onset_rule(start: int, end: int, pet: bool = False, ratio_min: float = RATIO_MIN,
               first_mm: float = FIRST_MM, next_mm: float = NEXT_MM) -> Column:
    """25/20 rule: P0 >= 25 mm and P1 + P2 >= 20 mm, all inside the window; candidates are
    start..end-2.  With ``pet`` also P0 / PET >= ratio_min.  NULL when none."""
    conds = {}
    for k in range(start, end - 1):
        p0, p1, p2 = (F.col(f"p_{k + j}") for j in range(3))
        conds[k] = rains_start(p0, p1, p2, F.col(f"e_{k}") if pet else None, ratio_min, first_mm, next_mm)
    return first_true(conds)


def rain_onset(
    by_dekad: DataFrame, start: int, end: int, pet: str | None = None, ratio_min: float = 0.5,
    keys: Sequence[str] = SEASON,
) -> DataFrame:
    """Rainfall onset per season; ``pet`` names the column of the optional P / PET gate."""
    s = season_frame(by_dekad, start, end).groupBy(*keys).agg(*onset_aggs(start, end, pet), own_year().alias("_own")).filter("_own")
    return s.select(*keys, onset_rule(start, end, pet is not None, ratio_min).alias("onset"))


def climatological_onset(
    clim: DataFrame, this_year: DataFrame, start: int, end: int, pet: str | None = "et0"
) -> DataFrame:
    """Onset of the normal rainfall series, gated with this year's PET; one row per season."""
    rows = this_year.drop("p").join(clim.select(*PX, "dekad", "p"), [*PX, "dekad"])
    return rain_onset(rows, start, end, pet)


def onset_with_fallback(onset: DataFrame, normal: DataFrame, keys: Sequence[str] = SEASON) -> DataFrame:
    """This year's onset, else the onset of the normal series."""
    n = normal.select(*keys, F.col("onset").alias("_n"))
    return onset.join(n, list(keys), "left").select(*keys, unmask("onset", F.col("_n")).alias("onset"))


def never_onset(pixels: DataFrame, onset: DataFrame, keys: Sequence[str] = SEASON) -> DataFrame:
    """Seasons with no onset at all."""
    return pixels.join(onset.filter(F.col("onset").isNotNull()), list(keys), "left_anti")


def median_over_years(rows: DataFrame, value: str, out: str, years: tuple[int, int] | None = None,
                      keys: Sequence[str] = PX) -> DataFrame:
    """Long-term normal: median over years (a handful of values per pixel)."""
    if years:
        rows = rows.filter(F.col("year").between(*years))
    return rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(out))


def temperature_normal(daily: DataFrame, years: tuple[int, int], keys: Sequence[str] = PX) -> DataFrame:
    return daily.filter(in_years("d", *years)).groupBy(*keys).agg(
        (F.avg("tmean_k") - 273.15).alias("t_norm_c"))


def season_prior(rain: DataFrame, pheno: DataFrame, mode: str = "rainfall_led",
                 keys: Sequence[str] = PX) -> DataFrame:
    """Blend the rainfall normal r and the phenology normal p into one prior.

    rainfall_led: mean of both where both exist, else r.  phenology_led: p, else r.
    """
    both = rain.select(*keys, F.col("onset_ltn").alias("_r")).join(
        pheno.select(*keys, F.col("pheno_ltn").alias("_p")), list(keys), "full")
    r, p = F.col("_r"), F.col("_p")
    out = unmask((r + p) / 2, r) if mode == "rainfall_led" else unmask(p, r)
    return both.select(*keys, out.alias("prior"))


# ---- false-start and viability gates ----------------------------------------------------------
def carried(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Aggregates that keep the season's other columns through a group-by on its key."""
    return [F.first(c).alias(c) for c in df.columns if c not in keys]


def _post_onset(
    seasons: DataFrame, daily: DataFrame, window_days: int = 20, trigger_days: int = 5,
    dry_mm: float = 1.0, bounds: tuple[int, int] = (-2, 54), scan: tuple[int, int] | None = None,
    as_coded: bool = False, absent: str = "dry", keys: Sequence[str] = SEASON,
) -> DataFrame:
    """The seasons with _least and _most (longest dry run if unknown days were wet, or dry), _acc (known trigger rain)
    and _open (whether a trigger day is unknown)."""
    if not 1 <= window_days < BITS:
        raise ValueError(f"window_days must be 1..{BITS - 1}")
    days = day_record(daily, absent)
    planting = F.col("planting").cast("int")
    if as_coded:
        lo, n = scan[0], (scan[1] - scan[0]) * 10 + window_days + 2
        rows = season_days(days, lo, n)
        j = F.col("_i") - (planting - lo) * 10
        opening = F.greatest(F.least((lo - planting) * 10, F.lit(window_days)), F.lit(0))
    else:
        rows = season_days(days, bounds[0], (bounds[1] - bounds[0] + 1) * 11 + window_days)
        j = F.datediff("_d", dekad_start("year", planting))
        opening = F.lit(0)
    rows = rows.select(*keys, F.col("d").alias("_d"), F.col("i").alias("_i"), F.col("rain_mm").alias("_r"))
    inside, seen = (F.col("_j") >= 0) & (F.col("_j") < window_days), F.col("_r").isNotNull()
    out = seasons.join(rows, list(keys), "left").withColumn("_j", j).groupBy(*keys).agg(
        *carried(seasons, keys),
        bit_set(F.col("_j"), inside & (F.col("_r") >= dry_mm)).alias("_wet"),
        bit_set(F.col("_j"), inside & (seen if absent == "unknown" else ~seen)).alias("_told"),
        F.coalesce(F.sum(F.when(inside & (F.col("_j") < trigger_days), F.col("_r"))), F.lit(0.0)).alias("_acc"))
    window, trigger = (F.lit((1 << k) - 1).cast("long") for k in (window_days, trigger_days))
    before = F.call_function("shiftleft", F.lit(1).cast("long"), opening) - 1  # days the scan does not reach
    gaps = (F.bitwise_not(F.col("_told")) if absent == "unknown" else F.col("_told")).bitwiseAND(window).bitwiseAND(F.bitwise_not(before))
    most = window.bitwiseAND(F.bitwise_not(F.col("_wet"))).bitwiseAND(F.bitwise_not(before))
    planted = F.col("planting").isNotNull()
    return out.withColumns({
        "_least": F.when(planted, longest_run(most.bitwiseAND(F.bitwise_not(gaps)), window_days)),
        "_most": F.when(planted, longest_run(most, window_days)),
        "_open": F.when(planted, gaps.bitwiseAND(trigger) != 0)}).drop("_wet", "_told")


def _diagnosed(out: DataFrame) -> DataFrame:
    return out.withColumns({
        "max_dry_days": F.when(F.col("_least") == F.col("_most"), F.col("_least")),
        "onset_acc_mm": F.when(~F.col("_open"), F.col("_acc"))}).drop("_least", "_most", "_acc", "_open")


def add_post_onset_rain(seasons: DataFrame, daily: DataFrame, **how) -> DataFrame:
    """Add max_dry_days (longest dry run in the window that opens at planting) and onset_acc_mm
    (rain over its first trigger days); NULL where there is no planting, or where unknown days could change the value.

    Default: real dates from the start of the planting dekad.  ``as_coded``: day index
    (planting - scan_lo) * 10 from the start of the scan, cut to the scan's length, so a planting
    before the scan loses its leading days.

    A masked (NULL) day is unknown.  A day without a row is dry, as records of rainy days leave such days out; with
    ``absent="unknown"`` (full records) it is unknown as well.  Only rainy and masked days move where absent days are dry:
    the dry bitmap is the complement of the wet one and no day spine is built.  The join and the aggregate share the
    season key, and the season table is read once.  Readings of one pixel and day are summed first;
    ``bounds`` are the possible planting dekads and prune days before the shuffle.
    """
    return _diagnosed(_post_onset(seasons, daily, **how))


def post_onset_rain(planting: DataFrame, daily: DataFrame, keys: Sequence[str] = SEASON, **kw) -> DataFrame:
    """The two diagnostics alone, for planted seasons."""
    pl = planting.filter(F.col("planting").isNotNull()).select(*keys, "planting")
    return add_post_onset_rain(pl, daily, keys=keys, **kw).drop("planting")


def add_false_start(seasons: DataFrame, daily: DataFrame, max_dry_days: int = 7, trigger_mm: float = 20.0, **kw) -> DataFrame:
    """Add the diagnostics and false_start: 0 where the rains held whatever the unknown days were, 1 where they did not,
    NULL where that hangs on unknown days.  A trigger of 0 turns the accumulation half off."""
    ok = F.when(F.col("_most") <= max_dry_days, True).when(F.col("_least") > max_dry_days, False)
    if trigger_mm > 0:
        ok = ok & F.when(F.col("_acc") >= trigger_mm, True).when(~F.col("_open"), False)
    return _diagnosed(_post_onset(seasons, daily, **kw).withColumn("false_start", F.when(F.col("planting").isNotNull(), F.when(ok, 0).when(~ok, 1))))


def gate_false_starts(planting: DataFrame, daily: DataFrame, max_dry_days: int = 7,
                      trigger_mm: float = 20.0, keys: Sequence[str] = SEASON, **kw) -> DataFrame:
    """Planting masked where the rains that triggered it did not hold; adds false_start 0/1.  Where missing days leave that
    open (false_start NULL) the planting stays: crops are masked on evidence, not on gaps."""
    out = add_false_start(planting, daily, max_dry_days, trigger_mm, keys=keys, **kw)
    return out.withColumn("planting", F.when(F.coalesce(F.col("false_start") == 0, F.lit(True)), F.col("planting")))


def viability_gate(planting: DataFrame, wrsi_early: DataFrame, min_wrsi: float = 50.0,
                   keys: Sequence[str] = SEASON) -> DataFrame:
    """Keep a planting only where the early variety would not fail."""
    ok = F.col("wrsi_early") >= min_wrsi
    return planting.join(wrsi_early.select(*keys, F.col("wrsi").alias("wrsi_early")), list(keys), "left").withColumns({
        "viable": unmask(ok.cast("int"), 0), "planting": F.when(ok, F.col("planting"))})


def last_viable_planting(
    ratio_rows: DataFrame, first: int = 28, last: int = 42, threshold: float = 0.5,
    residual: int = 3, cycle: int = 9, keys: Sequence[str] = PX,
) -> DataFrame:
    """Last dekad (global) with normal P / PET past the threshold, + residual - cycle.

    Input: keys, dekad 1..36, p, et0.  NULL where no dekad qualifies.
    """
    gd = F.when(F.col("dekad") >= first, F.col("dekad")).otherwise(F.col("dekad") + 36)
    ok = F.col("p") / floor_at("et0", 1e-3) >= threshold
    return ratio_rows.withColumn("gd", gd).filter(F.col("gd") <= last).groupBy(*keys).agg(
        (F.max(F.when(ok, F.col("gd"))) + (residual - cycle)).alias("lvpd"))


def growing_period(ratio_rows: DataFrame, threshold: float = 0.5, keys: Sequence[str] = PX) -> DataFrame:
    """Longest run of dekads with P / PET past the threshold, the year taken as a ring."""
    ok = F.col("p") / floor_at("et0", 1e-3) >= threshold
    return ratio_rows.groupBy(*keys).agg(bit_set(F.col("dekad") - 1, ok).alias("_b")).select(
        *keys, longest_run(F.col("_b"), 36, ring=True).alias("lgp"))
