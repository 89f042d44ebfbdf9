"""Dekad rainfall: sums, running dekad, climatology, three-month index."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seasonlens import config as C
from seasonlens.functions.climate import KELVIN, hargreaves_et0
from seasonlens.functions.dekads import date_to_dekad, dekad_days, dekad_start
from seasonlens.functions.masks import clamp, unmask
from seasonlens.operators.frames import PX, dekadal, in_years, known_days


def rain_by_dekad(daily: DataFrame, keys: Sequence[str] = PX, mode: str = "calendar") -> DataFrame:
    return dekadal(daily, [F.sum("rain_mm").alias("p")], "d", keys, mode)


def climate_by_dekad(rows: DataFrame, keys: Sequence[str] = PX, carry: Sequence[str] = ()) -> DataFrame:
    """Rain sum and mean temperatures in one pass over daily (or unioned sparse) rows; ``carry``
    names pixel constants to keep (NULL on some rows is fine)."""
    return dekadal(
        rows,
        [F.sum("rain_mm").alias("p"), (F.avg("tmax_k") - KELVIN).alias("tmax_c"),
         (F.avg("tmin_k") - KELVIN).alias("tmin_c"), *[F.max(c).alias(c) for c in carry]],
        "d", keys,
    )


def with_et0(by_dekad: DataFrame, lat: str = "lat") -> DataFrame:
    return by_dekad.withColumn("et0", hargreaves_et0(lat, "tmax_c", "tmin_c", "year", "dekad"))


def running_dekad(
    obs: DataFrame, forecast: DataFrame, year: int, dekad: int, obs_days: int = 6, fc_days: int = 4,
    keys: Sequence[str] = PX,
) -> DataFrame:
    """Current dekad = its first observed days plus the forecast for the days after them."""
    start = dekad_start(F.lit(year), F.lit(dekad))
    mid, end = F.date_add(start, obs_days), F.date_add(start, obs_days + fc_days)
    seen = obs.filter((F.col("d") >= start) & (F.col("d") < mid)).select(*keys, "rain_mm")
    ahead = forecast.filter((F.col("d") >= mid) & (F.col("d") < end)).select(*keys, "rain_mm")
    return (
        seen.unionByName(ahead).groupBy(*keys).agg(F.sum("rain_mm").alias("p"))
        .select(*keys, F.lit(year).alias("year"), F.lit(dekad).alias("dekad"), "p")
    )


def replace_dekad(by_dekad: DataFrame, running: DataFrame, year: int, dekad: int) -> DataFrame:
    """Year series with the current dekad swapped for its running blend."""
    past = by_dekad.filter(~((F.col("year") == year) & (F.col("dekad") == dekad)))
    return past.unionByName(running.select(*by_dekad.columns))


def observed_total(daily: DataFrame, end_date: str, days: int = 6, keys: Sequence[str] = PX) -> DataFrame:
    """Rain over the N days ending at a date."""
    last = F.lit(end_date).cast("date")
    return (
        daily.filter((F.col("d") > F.date_sub(last, days)) & (F.col("d") <= last))
        .groupBy(*keys).agg(F.sum("rain_mm").alias("obs_mm"))
    )


def blend_totals(obs: DataFrame, forecast: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    """Observed + forecast totals on one grid; a missing side counts as 0."""
    return obs.join(forecast, list(keys), "full").select(
        *keys, (unmask(F.nanvl("obs_mm", F.lit(0.0)), 0.0) + unmask(F.nanvl("fc_mm", F.lit(0.0)), 0.0)).alias("p"))


def yearly_dekads(daily: DataFrame, years: tuple[int, int], keys: Sequence[str] = PX, absent: str = "unknown") -> DataFrame:
    """Dekad sums of single years and how much of the dekad is known; an incomplete one has no sum.  One pass, combined map-side."""
    year, dekad = F.year("d"), date_to_dekad("d")
    start = dekad_start(F.col("year"), F.col("dekad"))
    rows = daily.filter(in_years("d", *years)).select(*keys, dekad.alias("dekad"), year.alias("year"), "d", "rain_mm")
    days = dekad_days(F.col("year"), F.col("dekad"))
    per = rows.withColumns({"_i": F.datediff("d", start), "_n": days}).groupBy(*keys, "dekad", "year", "_n").agg(
        F.sum("rain_mm").alias("_p"), known_days(F.col("_i"), F.col("rain_mm"), F.col("_n"), 11, absent).alias("_known"))
    whole = F.col("_known") == F.col("_n")
    return per.select(*keys, "dekad", "year", F.when(whole, F.coalesce("_p", F.lit(0.0))).alias("p"), (F.col("_known") / F.col("_n")).alias("coverage"))


def dekad_climatology(
    daily: DataFrame, years: tuple[int, int], keys: Sequence[str] = PX, absent: str = "unknown"
) -> DataFrame:
    """Mean over years of the dekad sum, from the years whose dekad is complete: sums per year first, then their mean."""
    return moments(yearly_dekads(daily, years, keys, absent), "p", [*keys, "dekad"]).select(*keys, "dekad", F.col("mean").alias("p"))


# ---- mergeable normals ------------------------------------------------------------------------
def moments(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, mean, m2 (sum of squared deviations) of the known values: what a stored normal holds.  Keys without any are left out."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")).filter("n > 0")


def _sides(whole: DataFrame, part: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    other = part.select(*by, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2"))
    return whole.select(*by, "n", "mean", "m2").join(other, list(by), how)


def merge_moments(stored: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of both samples together: a year is added to stored normals without reading the years before it."""
    both = _sides(stored, new, by, "full").fillna(0, ["n", "_n"]).fillna(0.0, ["m2", "_m2"])
    n = F.col("n") + F.col("_n")
    a, b = F.coalesce("mean", "_mean"), F.coalesce("_mean", "mean")
    return both.select(*by, n.alias("n"), (a + (b - a) * F.col("_n") / n).alias("mean"),
                       (F.col("m2") + F.col("_m2") + (b - a) * (b - a) * F.col("n") * F.col("_n") / n).alias("m2"))


def remove_moments(stored: DataFrame, old: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments without a sample that was merged before (the oldest year of a rolling normal); keys left without values go."""
    both = _sides(stored, old, by, "left").fillna(0, ["_n"]).fillna(0.0, ["_m2"]).withColumn("_left", F.col("n") - F.col("_n")).filter("_left > 0")
    gone = F.coalesce("_mean", "mean")
    rest = F.col("mean") + (F.col("mean") - gone) * F.col("_n") / F.col("_left")
    d = gone - rest
    return both.select(*by, F.col("_left").alias("n"), rest.alias("mean"),
                       F.greatest(F.col("m2") - F.col("_m2") - d * d * F.col("_left") * F.col("_n") / F.col("n"), F.lit(0.0)).alias("m2"))


def update_climatology(stored: DataFrame, daily: DataFrame, year: int, drop: int | None = None, keys: Sequence[str] = PX,
                       absent: str = "unknown") -> DataFrame:
    """Dekad normals (n, mean, m2) with one more year, and without year ``drop``.  Only the days of these years are read."""
    by = [*keys, "dekad"]
    out = merge_moments(stored, moments(yearly_dekads(daily, (year, year), keys, absent), "p", by), by)
    return out if drop is None else remove_moments(out, moments(yearly_dekads(daily, (drop, drop), keys, absent), "p", by), by)


def climatology_document(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Regional mean per dekad -> one JSON document {variable: {dekad: value}} (36 entries each)."""
    means = rows.groupBy("dekad").agg(*[F.avg(v).alias(v) for v in variables])
    entries = F.array_sort(F.collect_list(F.struct("dekad", *variables)))

    def by_dekad(v: str):
        return F.map_from_entries(F.transform("e", lambda x: F.struct(x["dekad"].cast("string"), F.round(x[v], 6)))).alias(v)

    return means.agg(entries.alias("e")).select(F.to_json(F.struct(*[by_dekad(v) for v in variables])).alias("doc"))


def three_month_totals(daily: DataFrame, end_month: int, keys: Sequence[str] = PX, absent: str = "unknown") -> DataFrame:
    """Rain over the three months ending in end_month, labelled by the ending year, and the share of its days that is known.

    A window with an unknown day has no total.  Where absent days are dry, the record of a pixel is taken to reach
    over a window only if each of its months has a row; other windows are left out.
    """
    months = [(end_month - k - 1) % 12 + 1 for k in range(3)]
    m, first = F.month("d"), (end_month - 3) % 12 + 1
    ending = F.year("d") + F.when(m > end_month, 1).otherwise(0)
    opening = F.make_date(F.col("year") - (1 if first > end_month else 0), F.lit(first), F.lit(1))
    days = F.datediff(F.last_day(F.make_date("year", F.lit(end_month), F.lit(1))), opening) + 1
    rows = daily.filter(m.isin(*months)).select(*keys, "d", "rain_mm", ending.alias("year")).withColumns({"_i": F.datediff("d", opening), "_n": days})
    out = rows.groupBy(*keys, "year", "_n").agg(
        F.sum("rain_mm").alias("_p"), known_days(F.col("_i"), F.col("rain_mm"), F.col("_n"), 92, absent).alias("_known"),
        *[F.max(m == k).alias(f"_m{k}") for k in months])
    if absent == "dry":
        out = out.filter(" AND ".join(f"_m{k}" for k in months))
    whole = F.col("_known") == F.col("_n")
    return out.select(*keys, "year", F.when(whole, F.coalesce("_p", F.lit(0.0))).alias("p3"), (F.col("_known") / F.col("_n")).alias("coverage"))


def spi3(
    totals: DataFrame, clim: tuple[int, int], keys: Sequence[str] = PX
) -> DataFrame:
    """Wilson-Hilferty standardised index of the three-month total against the climatology years (known totals only)."""
    w = Window.partitionBy(*keys)
    base = F.when(F.col("year").between(*clim), F.col("p3"))
    return _standardised(totals.withColumns({"_mu": F.avg(base).over(w), "_sd": F.stddev_pop(base).over(w)}))


def spi3_from_moments(totals: DataFrame, normals: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    """The same against stored moments of the three-month totals: one year is indexed without its past."""
    known = normals.select(*keys, F.col("mean").alias("_mu"), F.sqrt(F.col("m2") / F.col("n")).alias("_sd"))
    return _standardised(totals.join(known, list(keys), "left"))


def _standardised(rows: DataFrame) -> DataFrame:
    least = F.lit(1e-3)
    return (
        rows.withColumns({"_mu": F.greatest("_mu", least), "_sd": F.greatest("_sd", least)})
        .withColumn("_a9", 9 * F.greatest(F.pow(F.col("_mu") / F.col("_sd"), 2), least))
        .withColumn("spi3", clamp(
            (F.cbrt(F.col("p3") / F.col("_mu")) - 1 + 1 / F.col("_a9")) * F.sqrt("_a9"), -3.5, 3.5))
        .drop("_mu", "_sd", "_a9")
    )


def spi_flags(spi: DataFrame) -> DataFrame:
    return spi.withColumns({
        "wet": (F.col("spi3") >= C.SPI_WET).cast("int"), "dry": (F.col("spi3") <= C.SPI_DRY).cast("int")})
