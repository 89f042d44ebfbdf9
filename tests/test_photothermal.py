import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from seasonlens.functions.climate import day_length, induction_rate
from seasonlens.operators.balance import PHASES, PhotoParams, photothermal_clock


def hours(lat, doy, elev=0.0):
    decl = 0.409 * math.sin(2 * math.pi / 365 * doy - 1.39)
    c = (math.sin(math.radians(elev)) - math.sin(math.radians(lat)) * math.sin(decl)) / (math.cos(math.radians(lat)) * math.cos(decl))
    return 24 / math.pi * math.acos(max(-1, min(1, c)))


def test_day_length(spark):
    df = spark.createDataFrame([(0.0, 80), (15.0, 172), (-15.0, 172), (80.0, 172), (80.0, 355), (None, 1)], "lat double, doy int")
    got = [r.h for r in df.select(day_length("lat", "doy").alias("h")).collect()]
    assert got[0] == pytest.approx(12) and got[1] == pytest.approx(hours(15, 172)) and got[1] + got[2] == pytest.approx(24)
    assert got[3] == 24 and got[4] == 0 and got[5] is None
    twilight = df.filter("lat = 15").select(day_length("lat", "doy", -6.0).alias("h")).first().h
    assert twilight == pytest.approx(hours(15, 172, -6.0)) and twilight > got[1] + 0.7


def test_response_is_hyperbolic_in_time(spark):
    df = spark.createDataFrame([(11.0,), (12.0,), (12.75,), (13.5,), (15.0,), (None,)], "h double")
    got = [r[0] for r in df.select(induction_rate("h", 12.0, 13.5)).collect()]
    assert got == [1, 1, 0.5, 0, 0, None]  # half way to the ceiling induction takes twice as long


def brute(rows, lat, year, sos, p):
    """rows: gd -> (tmax, tmin) or None."""
    j = i = t = 0.0
    marks = dict.fromkeys(PHASES)
    for gd in range(sos, 37):
        if rows.get(gd) is None:
            break
        hi, lo = rows[gd]
        left = max((min(hi, 30) + lo) / 2 - 9, 0) * 10
        doy = dt.date(year, (gd - 1) // 3 + 1, (gd - 1) % 3 * 10 + 1).timetuple().tm_yday + 5
        rate = max(0.0, min(1.0, (p.ceiling_h - hours(lat, doy)) / (p.ceiling_h - p.base_h)))
        use = min(left, max(p.juvenile - j, 0))
        j, left = j + left, left - use
        if i < p.induction and left:
            need = (p.induction - i) / rate if rate else math.inf
            i += left * rate
            left = max(left - need, 0.0)
        if i >= p.induction:
            t += left
        for n, done in zip(PHASES, (j >= p.juvenile, i >= p.induction, t >= p.flowering, t >= p.maturity)):
            if done and marks[n] is None:
                marks[n] = gd
    return marks


def test_clock_against_brute_force(spark):
    rng = random.Random(6)
    rows, seasons, want = [], [], {}
    p = PhotoParams()
    for px in range(60):
        lat, year, sos = rng.choice([-12.0, 2.0, 14.0, 17.0]), 1999 + px % 2, rng.randrange(1, 20)
        temps = {gd: (rng.uniform(22, 36), rng.uniform(10, 22)) for gd in range(1, 37)}
        if px % 3 == 0:
            temps[rng.randrange(1, 37)] = None  # masked or, below, absent
        for gd, v in temps.items():
            if v is None and px % 2:
                continue
            rows.append((px, year, gd, v and v[0], v and v[1], lat))
        seasons.append((px, year, sos))
        want[px] = brute(temps, lat, year, sos, p)
    t = spark.createDataFrame(rows, "px_id long, year int, dekad int, tmax_c double, tmin_c double, lat double")
    got = photothermal_clock(t, spark.createDataFrame(seasons, "px_id long, year int, sos int"), p).collect()
    assert {r.px_id: {n: r[f"{n}_dekad"] for n in PHASES} for r in got} == want
    assert any(w["maturity"] for w in want.values()) and any(w["juvenile"] and not w["initiation"] for w in want.values())


def test_long_days_delay_and_short_days_do_not(spark):
    rows = [(px, 2000, gd, 30.0, 20.0, lat) for px, lat in ((1, 2.0), (2, 16.0)) for gd in range(1, 37)]
    t = spark.createDataFrame(rows, "px_id long, year int, dekad int, tmax_c double, tmin_c double, lat double")
    sos = spark.createDataFrame([(1, 2000, 13), (2, 2000, 13)], "px_id long, year int, sos int")
    got = {r.px_id: r for r in photothermal_clock(t, sos).collect()}
    assert got[1].juvenile_dekad == got[2].juvenile_dekad and got[2].initiation_dekad > got[1].initiation_dekad
    none = photothermal_clock(t.filter("dekad <> 14"), sos).filter("maturity_dekad is not null or initiation_dekad is not null")
    assert none.count() == 0 and photothermal_clock(t.limit(0), sos).count() == 0
