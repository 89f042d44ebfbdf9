"""Time frames: dense spines, dekad bucketing, season-relative global dekads, run lengths."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.functions.dekads import DEKADS, date_to_dekad, dekad_start, fixed10_dekads

PX = ("px_id",)


def spread(rows: DataFrame, keys: Sequence[str] = PX, times: int = 1) -> DataFrame:
    """Rows dealt by key over ``spark.sql.shuffle.partitions`` tasks (``times`` as many where keys are few and long), a number that
    adaptive planning keeps: ahead of a step that makes many rows of each.  A small file is one task, and so would be all that it grows to."""
    return rows.repartition(times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each(rows: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Every row once for each number first..last (a fixed list).  A join to the list and not an explode, of which the planner takes
    the result to be as small as the rows before it: a later join would broadcast it, however long it is."""
    values = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))
    return rows.crossJoin(F.broadcast(values))


def day_spine(pixels: DataFrame, first: str, last: str, keys: Sequence[str] = PX) -> DataFrame:
    """One row per pixel and day."""
    days = (dt.date.fromisoformat(last) - dt.date.fromisoformat(first)).days
    return each(spread(pixels.select(*keys), keys), "_day", 0, days).select(
        *keys, F.date_add(F.lit(first).cast("date"), F.col("_day")).alias("d"))


def dekad_spine(pixels: DataFrame, years: Sequence[int], keys: Sequence[str] = PX) -> DataFrame:
    """One row per pixel, year and dekad."""
    return each(each(spread(pixels.select(*keys), keys), "year", min(years), max(years)), "dekad", 1, DEKADS)


def densify(rows: DataFrame, spine: DataFrame, on: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Give missing spine entries a row: NULL bands, or the fill value."""
    out = spine.join(rows, list(on), "left")
    return out.fillna(fill) if fill else out


def with_dekad(daily: DataFrame, date_col: str = "d", mode: str = "calendar") -> DataFrame:
    """Attach year and dekad.  ``fixed10`` uses [start, start + 10 d) windows, in which a day
    may belong to no dekad or to two; the windows are resolved per row, without a range join."""
    if mode == "calendar":
        return daily.withColumns({"year": F.year(date_col), "dekad": date_to_dekad(date_col)})
    return daily.withColumn("_w", F.explode(fixed10_dekads(date_col))).select(
        *daily.columns, F.col("_w.year").alias("year"), F.col("_w.dekad").alias("dekad")
    )


def dekadal(
    rows: DataFrame, aggs: Sequence[Column], date_col: str = "d",
    keys: Sequence[str] = PX, mode: str = "calendar",
) -> DataFrame:
    """Aggregate dated rows to (keys, year, dekad) in one shuffle with map-side combine."""
    return with_dekad(rows, date_col, mode).groupBy(*keys, "year", "dekad").agg(*aggs)


def season_frame(by_dekad: DataFrame, gd_lo: int, gd_hi: int, years: tuple[int, int] | None = None) -> DataFrame:
    """Re-key (year, dekad) rows by season year and global dekad, keeping gd_lo..gd_hi.

    A row serves its own year and, when the range passes 36, earlier season years too, so the
    only multiplication is the overlap the season really needs; the filter is applied per row
    before any shuffle.  ``years`` are the season years wanted: their calendar years reach the scan.
    """
    if years:
        by_dekad = by_dekad.filter(F.col("year").between(years[0], years[1] + max(0, (gd_hi - 1) // DEKADS)))
    reach = (gd_hi - 1) // DEKADS
    if reach <= 0:
        return by_dekad.filter(F.col("dekad").between(gd_lo, gd_hi)).withColumnRenamed("dekad", "gd")
    rest = [c for c in by_dekad.columns if c not in ("year", "dekad")]
    back = F.explode(F.sequence(F.lit(0), F.lit(reach)))
    return (
        by_dekad.withColumn("_back", back)
        .withColumns({"gd": F.col("dekad") + DEKADS * F.col("_back"), "year": F.col("year") - F.col("_back")})
        .filter(F.col("gd").between(gd_lo, gd_hi) & (F.col("year").between(*years) if years else F.lit(True)))
        .select("year", "gd", *rest)
    )


def own_year() -> Column:
    """Aggregate over a season's rows: some of them lie in the season's own calendar year.  A season
    that only the next year's rows suggest is not one."""
    return F.min("gd") <= DEKADS


def in_years(date_col: str, first: int, last: int) -> Column:
    """Date bounds of whole years, in a form that reaches the scan."""
    d = F.col(date_col)
    return (d >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (d < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))


def season_days(daily: DataFrame, first_gd: int, n_days: int) -> DataFrame:
    """Re-key daily rows by season year and day index 0..n_days-1 from the start of dekad first_gd.

    The candidate years follow from the window, and out-of-window days go before any shuffle.
    """
    back = (first_gd - 1) // DEKADS, (first_gd - 1 + n_days // 8) // DEKADS
    years = [F.year("d") - k for k in range(back[0], back[1] + 1)]
    return (
        daily.withColumn("year", F.explode(F.array(*years)) if len(years) > 1 else years[0])
        .withColumn("i", F.datediff("d", dekad_start("year", F.lit(first_gd))))
        .filter((F.col("i") >= 0) & (F.col("i") < n_days))
    )


def wide_aggs(index: str, lo: int, hi: int, **bands: str) -> list[Column]:
    """Aggregates that lay a short ordered series out as columns ``<band>_<k>``, k in lo..hi.

    They combine map-side to one row per key and need no sort; the look-ahead rules that follow
    are plain column expressions inside code generation.
    """
    return [
        F.max(F.when(F.col(index) == k, F.col(col))).alias(f"{name}_{k}")
        for name, col in bands.items() for k in range(lo, hi + 1)
    ]


def wide(rows: DataFrame, keys: Sequence[str], index: str, lo: int, hi: int, **bands: str) -> DataFrame:
    return rows.filter(F.col(index).between(lo, hi)).groupBy(*keys).agg(*wide_aggs(index, lo, hi, **bands))


def first_true(conds: dict[int, Column]) -> Column:
    """Smallest index whose condition holds, NULL if none."""
    picks = [F.when(c, F.lit(k)) for k, c in conds.items()]
    return picks[0] if len(picks) == 1 else F.least(*picks)


BITS = 63


def bit_set(index: Column, cond: Column) -> Column:
    """Aggregate: bitmap of the indexes (0..62) at which cond holds.  Merges map-side; an index that the
    bitmap cannot hold is an error, never a wrapped bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int"))
    bit = F.when(index.between(0, BITS - 1), bit).otherwise(F.raise_error(F.lit("index outside the bitmap")).cast("long"))
    return F.coalesce(F.bit_or(F.when(cond & index.isNotNull(), bit)), F.lit(0).cast("long"))


ABSENT = ("unknown", "dry")


def day_record(daily: DataFrame, absent: str, above: float = 0.0, keys: Sequence[str] = PX) -> DataFrame:
    """Rain per pixel and day; NULL where any reading of the day is masked.

    ``absent`` says what a day without a row is: in a full record it is ``unknown`` and every day is kept; a record of
    rainy days leaves out ``dry`` ones, so only days above ``above`` and masked ones are kept.  Sums combine map-side.
    """
    if absent not in ABSENT:
        raise ValueError(f"absent must be one of {ABSENT}")
    if absent == "dry":
        daily = daily.filter((F.col("rain_mm") > 0) | F.col("rain_mm").isNull())
    rows = daily.groupBy(*keys, "d").agg(F.when(F.count("rain_mm") == F.count(F.lit(1)), F.sum("rain_mm")).alias("rain_mm"))
    return rows.filter((F.col("rain_mm") > above) | F.col("rain_mm").isNull()) if absent == "dry" and above > 0 else rows


def known_days(index: Column, value: Column, days: Column, width: int, absent: str) -> Column:
    """Aggregate: how many of the days 0..``days``-1 are known, from rows with a day index below ``width``.

    Two bitmaps per 62 days, of days with a reading and of masked ones, merge map-side; several readings of a day
    set one bit.  Where absent days are dry, all days but the masked ones are known.
    """
    some, masked = F.lit(0), F.lit(0)
    for lo in range(0, width, 62):
        here = (index >= lo) & (index < lo + 62)
        gap = bit_set(index - lo, here & value.isNull())
        masked = masked + F.bit_count(gap)
        some = some + F.bit_count(bit_set(index - lo, here & value.isNotNull()).bitwiseAND(F.bitwise_not(gap)))
    return some if absent == "unknown" else days - masked


def longest_run(bits: Column, width: int, ring: bool = False) -> Column:
    """Longest run of set bits; on a ring the run may cross the end."""
    s = F.lpad(F.bin(bits), width, "0")
    s = F.concat(s, s) if ring else s
    run = F.array_max(F.transform(F.split(s, "0"), lambda r: F.length(r)))
    return F.least(run, F.lit(width)).cast("int")


def salted_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join many rows to a table of one row per key, where one key may hold a large part of the rows: they are
    dealt over ``salts`` sub-keys and the table is repeated for each."""
    if salts <= 1:
        return rows.join(table, list(on), how)
    copies = each(table, "_salt", 0, salts - 1)
    rest = [F.col(c) for c in rows.columns]
    mine = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    return mine.join(copies, [*on, "_salt"], how).drop("_salt")
