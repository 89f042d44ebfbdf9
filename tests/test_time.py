import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seasonlens.functions import dekads as D
from seasonlens.operators import frames as FR


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("day,dekad", [(1, 1), (10, 1), (11, 2), (20, 2), (21, 3), (28, 3), (29, 3), (30, 3), (31, 3)])
def test_day_to_dekad(spark, day, dekad):
    assert one(spark, D.date_to_dekad(F.lit(f"2023-01-{day:02d}").cast("date")))[0] == dekad


def test_start_and_length(spark):
    got = one(spark, D.dekad_start(F.lit(2023), F.lit(37)), D.dekad_days(F.lit(2023), F.lit(6)),
              D.dekad_days(F.lit(2024), F.lit(6)), D.dekad_days(F.lit(2023), F.lit(36)), D.dekad_start(F.lit(2023), F.lit(0)))
    assert tuple(got) == (dt.date(2024, 1, 1), 8, 9, 11, dt.date(2022, 12, 21))


def test_labels_round_half_even(spark):
    got = one(spark, *[D.dekad_label(F.lit(v)) for v in (9, 8.5, 9.5, 39)])
    assert tuple(got) == ("9·Mar", "8·Mar", "10·Apr", "39·Jan+1y")


def test_tokens_and_wrapping_window(spark):
    w = one(spark, D.parse_dekad_token(F.lit("Mar-d3")), D.parse_dekad_window(F.lit("Jul-d1-Aug-d3")),
            D.parse_dekad_window(F.lit("Nov-d3-Jan-d2")), D.parse_dekad_token(F.lit("Foo-d1")), D.parse_dekad_token(F.lit("Mar")))
    assert w[4] is None and w[0] == 9 and tuple(w[1]) == (19, 24) and tuple(w[2]) == (33, 38) and w[3] is None


def test_greenup(spark):
    jan1 = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    got = one(spark, *[D.greenup_to_dekad(F.lit(v), F.lit(2020)) for v in (jan1 + 100, jan1 - 5, jan1 + 900, 32767)])
    assert tuple(got) == (10, 1, 36, None)


def test_fixed_windows_skip_day_31_and_double_1_march(spark):
    days = ["2023-01-31", "2023-03-01", "2023-03-02", "2023-03-03", "2024-03-01", "2024-03-02"]
    df = spark.createDataFrame([(d,) for d in days], "s string").select(F.col("s").cast("date").alias("d"))
    got = {}
    for r in FR.with_dekad(df, mode="fixed10").collect():
        got.setdefault(str(r.d), []).append(r.dekad)
    assert got == {"2023-03-01": [6, 7], "2023-03-02": [6, 7], "2023-03-03": [7], "2024-03-01": [6, 7], "2024-03-02": [7]}


def test_season_frame_wraps(spark):
    df = spark.createDataFrame([(1, 2020, 36), (1, 2021, 1), (1, 2021, 20)], "px_id int, year int, dekad int")
    got = sorted((r.year, r.gd) for r in FR.season_frame(df, 28, 52).collect())
    assert got == [(2020, 36), (2020, 37)]


def longest(flags, ring=False):
    best = run = 0
    for f in (flags * 2 if ring else flags):
        run = run + 1 if f else 0
        best = max(best, run)
    return min(best, len(flags))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.booleans(), min_size=36, max_size=36))
def test_longest_run_matches_scan(spark, flags):
    bits = sum(1 << i for i, f in enumerate(flags) if f)
    a, b = one(spark, FR.longest_run(F.lit(bits).cast("long"), 36), FR.longest_run(F.lit(bits).cast("long"), 36, ring=True))
    assert (a, b) == (longest(flags), longest(flags, True))
