"""Dekad calendar: 36 ten-day periods a year (1-10, 11-20, 21-end of month).

A *global dekad* (gd) continues past 36 into the following year, so a season that
wraps the year end is an ordinary integer range.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from seasonlens.config import MONTHS
from seasonlens.functions.masks import as_col

DEKADS = 36


def date_to_dekad(d) -> Column:
    d = as_col(d)
    third = F.least(F.lit(3), F.floor((F.dayofmonth(d) - 1) / 10).cast("int") + 1)
    return ((F.month(d) - 1) * 3 + third).cast("int")


def dekad_start(year, dekad) -> Column:
    """First day of a dekad; dekads above 36 fall in the following years."""
    year, k = as_col(year), as_col(dekad) - 1
    within = F.pmod(k, F.lit(DEKADS))
    return F.make_date(
        (year + F.floor(k / DEKADS)).cast("int"),
        (F.floor(within / 3) + 1).cast("int"),
        (F.pmod(within, F.lit(3)) * 10 + 1).cast("int"),
    )


def dekad_days(year, dekad) -> Column:
    """Length of a dekad in days (8 to 11)."""
    return F.datediff(dekad_start(year, as_col(dekad) + 1), dekad_start(year, dekad))


def dekad_label(dekad) -> Column:
    """'9·Mar'; next-year dekads read '39·Jan+1y'.  Rounds half to even."""
    dk = F.bround(as_col(dekad)).cast("int")
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = (F.floor(F.pmod(dk - 1, F.lit(DEKADS)) / 3) + 1).cast("int")
    suffix = F.when(dk > DEKADS, F.lit("+1y")).otherwise(F.lit(""))
    return F.concat(dk.cast("string"), F.lit("·"), F.element_at(months, month), suffix)


def parse_dekad_token(token) -> Column:
    """'Mar-d3' -> 9."""
    token = as_col(token)
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.array_position(months, F.substring(token, 1, 3))
    third = F.regexp_extract(token, r"-d(\d)$", 1).try_cast("int")
    return F.when(month > 0, (month.cast("int") - 1) * 3 + third)


def parse_dekad_window(window) -> Column:
    """'Nov-d3-Jan-d2' -> struct(start, end); a wrapping end is lifted past 36."""
    window = as_col(window)
    start = parse_dekad_token(F.substring_index(window, "-", 2))
    end = parse_dekad_token(F.substring_index(window, "-", -2))
    return F.struct(
        start.alias("start"), F.when(end < start, end + DEKADS).otherwise(end).alias("end")
    )


def global_dekad(year, dekad, base_year) -> Column:
    return (as_col(dekad) + (as_col(year) - as_col(base_year)) * DEKADS).cast("int")


def greenup_to_dekad(greenup_days, year, fill: int = 32767) -> Column:
    """Days since 1970-01-01 of green-up -> dekad 1..36; the fill value is masked."""
    days = F.nullif(as_col(greenup_days), F.lit(fill))
    jan1 = F.datediff(F.make_date(as_col(year).cast("int"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))
    dk = F.ceil((days - jan1) / 10.139).cast("int")
    return F.when(dk.isNotNull(), F.least(F.greatest(dk, F.lit(1)), F.lit(DEKADS)))


def fixed10_dekads(d) -> Column:
    """Array of struct(year, dekad) whose fixed [start, start+10d) window holds day d.

    Day 31 is in none; 1 March (and 2 March of common years) is in two.
    """
    d = as_col(d)
    own = F.struct(F.year(d).alias("year"), date_to_dekad(d).alias("dekad"))
    before = F.date_sub(dekad_start(F.year(d), date_to_dekad(d)), 1)
    prev = F.struct(F.year(before).alias("year"), date_to_dekad(before).alias("dekad"))
    return F.filter(
        F.array(prev, own),
        lambda w: F.datediff(d, dekad_start(w["year"], w["dekad"])) < 10,
    )
