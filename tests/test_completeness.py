"""Missing, masked and out-of-record values give NULL or no row, never a smaller total; plans read once and prune."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seasonlens.config import MAIZE, MAIZE_EARLY
from seasonlens.operators import balance as B, frames as FR, fusion as FU, observations as OB, onset as O, rainfall as RA, risk as R, rollup as U, spatial as SP
from seasonlens.plans import season as P

CL = "px_id int, year int, dekad int, p double, et0 double, tmax_c double"


def dekads(px, first, last, p=40.0, et0=30.0, t=36.0, skip=(), masked=()):
    return [(px, 2000 + (g - 1) // 36, (g - 1) % 36 + 1, None if g in masked else p, et0, None if g in masked else t) for g in range(first, last + 1) if g not in skip]


def test_a_missing_or_masked_dekad_masks_the_balance(spark):
    rows = dekads(1, 6, 28) + dekads(2, 6, 28, skip=(12, 13, 14)) + dekads(3, 6, 28, masked=(12,)) + dekads(4, 6, 20)
    cl = spark.createDataFrame(rows, CL)
    pl = spark.createDataFrame([(px, 2000, 8) for px in (1, 2, 3, 4)], "px_id int, year int, planting int")
    for got in (B.water_balance(cl, pl, MAIZE, 7, 15), B.staged_balance(spark.createDataFrame(rows + dekads(1, 29, 29), CL), pl, MAIZE, 7, 15).withColumnRenamed("wrsi_flo", "wrsi")):
        r = {x.px_id: (x.wrsi is not None, x.complete) for x in got.collect()}
        assert r == {1: (True, 1), 2: (False, 0), 3: (False, 0), 4: (False, 0)}


def test_a_wrapping_season_needs_the_next_year_and_there_are_no_ghost_years(spark):
    cl = spark.createDataFrame(dekads(1, 1, 36), CL)
    pl = spark.createDataFrame([(1, 2000, 30)], "px_id int, year int, planting int")
    assert B.water_balance(cl, pl, MAIZE_EARLY, 28, 34).first().wrsi is None
    zones = spark.createDataFrame([(1, "A")], "px_id int, county string")
    r = P.rain_led_product(cl, zones, P.SeasonParams(MAIZE_EARLY, 28, 34, 28, 32)).first()
    assert (r.n_seasons, r.n_onset, r.mean_wrsi) == (1, 1, None)
    two = spark.createDataFrame(dekads(1, 1, 72), CL)
    r = P.rain_led_product(two, zones, P.SeasonParams(MAIZE_EARLY, 28, 34, 28, 32, years=(2000, 2000))).first()
    assert r.n_seasons == 1 and r.mean_wrsi is not None
    assert {x.year for x in FR.season_frame(two, 28, 52, years=(2000, 2000)).select("year").collect()} == {2000}


def test_heat_and_clock_mask_from_the_first_gap(spark):
    cl = spark.createDataFrame(dekads(1, 7, 28) + dekads(2, 7, 28, masked=(16,)) + dekads(3, 7, 28, skip=(16,)), CL)
    pl = spark.createDataFrame([(px, 2000, 8) for px in (1, 2, 3)], "px_id int, year int, planting int")
    heat = {r.px_id: r.s_heat for r in R.heat_stress(cl, pl, MAIZE, 7, 15).collect()}
    assert heat == {1: pytest.approx(min(1, 3 * (MAIZE.flo_end - MAIZE.veg_end) * .06)), 2: None, 3: None}
    t = lambda px, skip=(), masked=(): [(px, 2000, g, None if g in masked else 29.0, 19.0) for g in range(1, 37) if g not in skip]
    temps = spark.createDataFrame(t(1) + t(2, masked=(12,)) + t(3, skip=(12,)), "px_id int, year int, dekad int, tmax_c double, tmin_c double")
    sos = spark.createDataFrame([(px, 2000, 5) for px in (1, 2, 3)], "px_id int, year int, sos int")
    mat = spark.createDataFrame([(px, 1500.0) for px in (1, 2, 3)], "px_id int, gdd_maturity double")
    got = {r.px_id: (r.peak_vegetative_dekad, r.flowering_dekad, r.maturity_dekad, r.gdd_total) for r in B.gdd_clock(temps, sos, mat).collect()}
    assert got == {1: (9, 10, 14, 150 * 32), 2: (9, 10, None, None), 3: (9, 10, None, None)}


def test_three_month_windows_lie_in_the_record(spark):
    rows = [(1, dt.date(y, m, 1), 10.0) for y in (2000, 2001) for m in range(1, 13)]
    daily = spark.createDataFrame(rows, "px_id int, d date, rain_mm double")
    assert [(r.year, r.p3) for r in RA.three_month_totals(daily, 1, absent="dry").collect()] == [(2001, 30.0)]
    spi = RA.spi3(RA.three_month_totals(daily, 5, absent="dry"), (2000, 2001)).collect()
    assert sorted(r.year for r in spi) == [2000, 2001] and all(r.p3 == 30.0 for r in spi)
    flags = RA.spi_flags(spark.createDataFrame([(1, 1.5), (2, -1.0), (3, 0.0), (4, None)], "px_id int, spi3 double")).collect()
    assert [(r.wet, r.dry) for r in flags] == [(1, 0), (0, 1), (0, 0), (None, None)]


def test_spi_against_the_formula(spark):
    tot = {2000: 100.0, 2001: 300.0, 2002: 200.0}
    rows = spark.createDataFrame([(1, y, v) for y, v in tot.items()], "px_id int, year int, p3 double")
    mu, sd = 200.0, (20000 / 3) ** .5
    a9 = 9 * (mu / sd) ** 2
    for r in RA.spi3(rows, (2000, 2002)).collect():
        assert r.spi3 == pytest.approx(((tot[r.year] / mu) ** (1 / 3) - 1 + 1 / a9) * a9 ** .5)


def test_peaks_of_seasons_outside_the_record_are_left_out(spark):
    rows = [(1, dt.date(y, m, 5), 10 * y + m) for y in (2000, 2001) for m in range(1, 13)]
    obs = spark.createDataFrame(rows, "px_id int, d date, raw int")
    assert [(r.year, r.peak) for r in R.seasonal_peak(obs, 33, 38, 1.0, years=(2000, 2000)).collect()] == [(2000, 20012.0)]
    peaks = spark.createDataFrame([(1, 2000, 10.0), (1, 2001, 20.0), (1, 2002, 0.0)], "px_id int, year int, peak double")
    vci = {r.year: r.s_veg for r in R.vci_stress(peaks, (2000, 2001)).collect()}
    assert vci == pytest.approx({2000: .4, 2001: 0, 2002: .4})
    z = {r.year: r.s_veg for r in R.zfpar_stress(peaks, (2000, 2001)).collect()}
    assert z == pytest.approx({2000: .2, 2001: 0, 2002: .4})


def test_long_records_and_late_dekads_do_not_wrap(spark):
    rows = [(1, dt.date(y, 1, d), 5.0) for y in range(1920, 2004) for d in (1, 2)]
    daily = spark.createDataFrame(rows, "px_id int, d date, rain_mm double")
    assert [(r.dekad, r.p) for r in RA.dekad_climatology(daily, (1920, 2003), absent="dry").collect()] == [(1, 10.0)]
    flag = lambda *gds: spark.createDataFrame([(1, 2000, g, 1) for g in gds], "px_id int, year int, gd int, dry int")
    for gds, want in (((1, 66), 0), ((3, 66), 0), ((62, 63), 1), ((61, 62), 1), ((66, 67), 1), ((5,), 0), ((123, 124), 1)):
        assert R.persistent_hazard(flag(*gds), "dry").first().persistent == want
    with pytest.raises(Exception, match="past the last"):
        R.persistent_hazard(flag(130), "dry").collect()
    with pytest.raises(ValueError):
        O.add_post_onset_rain(flag(1), daily, window_days=63)


def test_readings_of_one_day_count_together(spark):
    at = lambda *xs: spark.createDataFrame([(1, dt.date(2000, 3, 1) + dt.timedelta(i), v) for i, v in xs], "px_id int, d date, rain_mm double")
    pl = spark.createDataFrame([(1, 2000, 7)], "px_id int, year int, planting int")
    r = O.post_onset_rain(pl, at((0, 30.0), (8, .6), (8, .6))).first()
    assert (r.max_dry_days, r.onset_acc_mm) == (11, 30.0)
    hydro = spark.createDataFrame([(1, 250.0, 400.0, .5)], "px_id int, fc_mm double, sat_mm double, tau double")
    assert B.aeration_stress(pl, at((3, 90.0), (3, 90.0), (4, 90.0)), hydro, MAIZE, 7, 15).count() == 1
    assert B.heavy_rain_days(pl, at((2, 30.0), (2, 30.0), (5, 40.0)), MAIZE, 7, 15).first().heavy_rain_days == 1


def test_days_before_the_window_count_from_planting_on(spark):
    days = [(i, 80.0) for i in range(18)]
    daily = spark.createDataFrame([(1, dt.date(2000, 2, 11) + dt.timedelta(i), v) for i, v in days], "px_id int, d date, rain_mm double")
    pl = spark.createDataFrame([(1, 2000, 5)], "px_id int, year int, planting int")
    hydro = spark.createDataFrame([(1, 250.0, 400.0, .3)], "px_id int, fc_mm double, sat_mm double, tau double")
    assert B.heavy_rain_days(pl, daily, MAIZE, 7, 15).first().heavy_rain_days == 18
    assert B.heavy_rain_days(pl, daily, MAIZE, 7, 15, as_coded=True).first().heavy_rain_days == 0
    assert B.aeration_stress(pl, daily, hydro, MAIZE, 7, 15).first().waterlog_idx == 100.0
    assert B.aeration_stress(pl, daily, hydro, MAIZE, 7, 15, as_coded=True).first().waterlog_idx == 0.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_bounds_reach_the_scan_and_inputs_are_read_once(spark, tmp_path):
    path = str(tmp_path / "daily")
    spark.createDataFrame([(1, dt.date(2000, 1, 1), 1.0, 280.0)], "px_id int, d date, rain_mm double, tmean_k double").write.parquet(path)
    daily = spark.read.parquet(path)
    for df in (RA.dekad_climatology(daily, (1995, 2000)), O.temperature_normal(daily, (1995, 2000))):
        assert "GreaterThanOrEqual(d,1995-01-01)" in plan(df) and "LessThan(d,2001-01-01)" in plan(df)
    path = str(tmp_path / "px")
    spark.createDataFrame([(1, 5, 2, 1.0, 2.0, 3.0)], "px_id int, dekad int, n int, ndre1 double, fpar double, rvi double").write.parquet(path)
    px = spark.read.parquet(path)
    scans = lambda df: plan(df).count("FileScan")
    assert scans(U.national_row(px, px, ["ndre1", "fpar", "rvi"], {})) == 2  # the histogram and the bands
    assert scans(FU.calibrated_fill(px.withColumn("g", F.col("ndre1")))) == 1
    assert scans(U.class_shares(px, "dekad", "n")) == 1
    peaks = px.select("px_id", F.col("dekad").alias("year"), F.col("rvi").alias("peak"))
    assert scans(R.vci_stress(peaks, (2000, 2001))) == 1


def test_focal_work_follows_the_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 3, 5.0), (100_000, 90_000, 7.0), (100_002, 90_001, None)], "row int, col int, v double")
    assert SP.grid_skeleton(cells, 10).count() <= 3 * 3 * 100
    got = {(r.row, r.col): r.v_fm for r in SP.focal_mean(cells, ["v"], 3).collect()}
    assert got == {(0, 0): 3.0, (0, 3): 3.0, (100_000, 90_000): 7.0, (100_002, 90_001): 7.0}


def test_hot_keys_are_spread(spark):
    n = 6000
    rows = spark.range(n).selectExpr("id AS px_id", "IF(id % 2 = 0, 0, id) AS zone")
    attr = spark.range(n).selectExpr("id AS zone", "id % 7 AS code")
    got = SP.dissolve(rows, attr, "zone", "code")
    assert got.count() == n and got.filter("zone = 0 AND code = 0").count() == n // 2
    salts = rows.withColumn("s", F.pmod(F.xxhash64("px_id", "zone"), F.lit(16))).filter("zone = 0").groupBy("s").count()
    assert salts.count() == 16 and salts.agg(F.max("count")).first()[0] < n // 2 / 8
    z = OB.temporal_zscore(spark.createDataFrame([(1, 1.0), (1, 3.0)], "px_id int, v double"), "v")
    assert sorted(r.v_z for r in z.collect()) == [-1.0, 1.0]
    scene = OB.link_band(rows.withColumnRenamed("zone", "scene"), attr.limit(0).withColumnRenamed("zone", "scene"), ["scene"], ["code"])
    assert scene.count() == n and scene.filter("code IS NOT NULL").count() == 0


# ---- known days -------------------------------------------------------------------------------
def record(spark, first, values, px=1):
    day = dt.date.fromisoformat(first)
    return spark.createDataFrame([(px, day + dt.timedelta(i), v) for i, v in enumerate(values) if v != "absent"], "px_id int, d date, rain_mm double")


def test_a_window_with_unknown_days_has_no_three_month_total(spark):
    one_day_a_month = spark.createDataFrame([(1, dt.date(2000, m, 5), 1.0) for m in (3, 4, 5)], "px_id int, d date, rain_mm double")
    r = RA.three_month_totals(one_day_a_month, 5).first()
    assert r.p3 is None and r.coverage == pytest.approx(3 / 92)
    full = [0.5] * 92
    april = [None if 31 <= i < 61 else v for i, v in enumerate(full)]
    for values, want, share in ((full, 46.0, 1), (april, None, 62 / 92), (full[:91] + ["absent"], None, 91 / 92)):
        r = RA.three_month_totals(record(spark, "2000-03-01", values), 5).first()
        assert (r.p3, r.coverage) == (want, pytest.approx(share))
    masked = RA.three_month_totals(record(spark, "2000-03-01", april), 5, absent="dry").first()
    assert masked.p3 is None and masked.coverage == pytest.approx(62 / 92)
    twice = record(spark, "2000-03-01", full).unionByName(record(spark, "2000-03-09", [None]))
    assert RA.three_month_totals(twice, 5).first().p3 is None, "a day with a masked reading is unknown"
    winter = record(spark, "1999-11-01", [1.0] * 92)
    assert [(r.year, r.p3) for r in RA.three_month_totals(winter, 1).collect()] == [(2000, 92.0)]


def test_normals_take_complete_dekads_only(spark):
    daily = record(spark, "2000-01-01", [2.0] * 10).unionByName(record(spark, "2001-01-01", [2.0])).unionByName(record(spark, "2002-01-01", [2.0] * 9 + [None]))
    assert [(r.dekad, r.p) for r in RA.dekad_climatology(daily, (2000, 2002)).collect()] == [(1, 20.0)]
    got = {r.year: (r.p, r.coverage) for r in RA.yearly_dekads(daily, (2000, 2002)).collect()}
    assert got == {2000: (20.0, 1.0), 2001: (None, .1), 2002: (None, .9)}
    feb = record(spark, "2000-02-21", [1.0] * 9).unionByName(record(spark, "2001-02-21", [1.0] * 8))
    assert [r.p for r in RA.dekad_climatology(feb, (2000, 2001)).collect()] == [8.5]


def test_masked_days_are_neither_dry_nor_wet(spark):
    pl = spark.createDataFrame([(1, 2000, 7)], "px_id int, year int, planting int")
    def gate(values, **kw):
        r = O.gate_false_starts(pl, record(spark, "2000-03-01", values), **kw).first()
        return r.planting, r.false_start, r.max_dry_days, r.onset_acc_mm
    assert gate([10.0] * 5 + [None] * 8 + [10.0] * 7) == (7, None, None, 50.0), "eight masked days decide nothing"
    assert gate([10.0] * 5 + [None] * 7 + [10.0] * 8) == (7, 0, None, 50.0), "seven at most are dry"
    assert gate([10.0] * 5 + [0.0] * 8 + [None] + [10.0] * 6) == (None, 1, None, 50.0), "eight at least are dry"
    assert gate([10.0, None] + [10.0] * 18) == (7, 0, None, None), "the known trigger rain suffices"
    assert gate([1.0, None] + [1.0] * 18) == (7, None, None, None)
    assert gate([10.0] * 5 + ["absent"] * 8 + [10.0] * 7) == (None, 1, 8, 50.0), "a record of rainy days"
    assert gate([10.0] * 5 + ["absent"] * 8 + [10.0] * 7, absent="unknown") == (7, None, None, 50.0)
    assert gate([10.0] * 5 + [0.0] * 8 + [10.0] * 7, absent="unknown") == (None, 1, 8, 50.0)
    with pytest.raises(ValueError):
        gate([1.0], absent="wet")


def test_excess_of_unknown_days_is_null(spark):
    pl = spark.createDataFrame([(1, 2000, 7)], "px_id int, year int, planting int")
    hydro = spark.createDataFrame([(1, 250.0, 400.0, .5)], "px_id int, fc_mm double, sat_mm double, tau double")
    full = [80.0] * 18 + [0.0] * 110
    for at, absent, known in ((None, "dry", True), (None, "unknown", True), (40, "dry", False), (40, "unknown", False), (125, "dry", True), (125, "unknown", True)):
        daily = record(spark, "2000-03-01", [None if i == at else v for i, v in enumerate(full)])
        assert (B.heavy_rain_days(pl, daily, MAIZE, 7, 15, absent=absent).first().heavy_rain_days == 18) == known
        assert (B.aeration_stress(pl, daily, hydro, MAIZE, 7, 15, absent=absent).count() == 1) == known
    short = record(spark, "2000-03-01", full[:100])
    assert B.heavy_rain_days(pl, short, MAIZE, 7, 15, absent="unknown").first().heavy_rain_days is None
    assert B.aeration_stress(pl, short, hydro, MAIZE, 7, 15, absent="unknown").count() == 0


# ---- mergeable normals ------------------------------------------------------------------------
def test_merged_and_rolling_normals_equal_recomputed_ones(spark):
    rng = random.Random(4)
    rows = [(px, k, y, rng.uniform(0, 200)) for px in (1, 2, 3) for k in (1, 2) for y in range(1990, 2002) if not (px == 2 and y < 2001) and (px, y) != (3, 2001)]
    df = spark.createDataFrame(rows, "px_id int, dekad int, year int, p double")
    by = ["px_id", "dekad"]
    of = lambda lo, hi: RA.moments(df.filter(f"year BETWEEN {lo} AND {hi}"), "p", by)
    def same(a, b):
        a, b = ({(r.px_id, r.dekad): (r.n, r.mean, r.m2) for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    same(RA.merge_moments(of(1990, 2000), of(2001, 2001), by), of(1990, 2001))
    same(RA.remove_moments(of(1990, 2001), of(1990, 1990), by), of(1991, 2001))
    same(RA.remove_moments(of(1990, 2001), of(1990, 2000), by), of(2001, 2001))
    days = record(spark, "1998-01-01", [float(i % 7) for i in range(4 * 365 + 1)])
    stored = RA.moments(RA.yearly_dekads(days, (1998, 2000)), "p", by)
    same(RA.update_climatology(stored, days, 2001, drop=1998), RA.moments(RA.yearly_dekads(days, (1999, 2001)), "p", by))


def test_index_from_stored_moments_equals_the_recomputed_one(spark):
    rows = spark.createDataFrame([(px, y, 50.0 + 31 * px * y % 97) for px in (1, 2) for y in range(1995, 2002)], "px_id int, year int, p3 double")
    normals = RA.moments(rows.filter("year < 2001"), "p3", ["px_id"])
    a, b = ({(r.px_id, r.year): r.spi3 for r in x.collect()} for x in (RA.spi3(rows, (1995, 2000)), RA.spi3_from_moments(rows, normals)))
    assert a == pytest.approx(b)


def test_calendar_plan_gathers_masked_pixels_and_calendar_dekads_only(spark, tmp_path):
    from seasonlens.sources import calendars as CA
    path = str(tmp_path / "climate")
    spark.createDataFrame([(1, 2000, 1, 1.0, 2.0)], "px_id int, year int, dekad int, p double, et0 double").write.parquet(path)
    zones = spark.createDataFrame([(1, "Kenya")], "px_id int, country string")
    cal = spark.createDataFrame([("Kenya", "Maize", "Longrains", "High", "Apr-d1-May-d3", "Mar-d1-May-d3")],
                                "country string, crop string, season string, crop_viability string, indicative_planting_window string, sos_detection_window string")
    mask = spark.createDataFrame([(1, "maize", 100)], "px_id int, product string, classification int")
    got = P.calendar_products(spark.read.parquet(path), zones, cal, CA.crop_table(spark), mask)
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    gather = logical[logical.index("collect_"):]
    assert "LeftSemi" in gather[:gather.index("Relation")], "the pixels' semi-join stands under the gather"


def test_equal_calendar_rows_are_computed_once_and_counted(spark, monkeypatch):
    from seasonlens.plans import season as P
    from seasonlens.sources import calendars as CA
    climate = spark.createDataFrame([(px, 1999, k, 30.0, 40.0) for px in (1, 2) for k in range(1, 37)], "px_id long, year int, dekad int, p double, et0 double")
    zones = spark.createDataFrame([(1, "K"), (2, "K")], "px_id long, country string")
    row = ("K", "maize", "Long", "High", "Mar-d1-Apr-d3", "Mar-d1-May-d1")
    seen, add = [], P.B.add_water_balance
    monkeypatch.setattr(P.B, "add_water_balance", lambda rows, *a: seen.append(rows.count()) or add(rows, *a))
    run = lambda n: P.calendar_products(climate, zones, spark.createDataFrame([row] * n, CA.CALENDAR_SCHEMA), CA.crop_table(spark)).first().asDict()
    one, three = run(1), run(3)
    counts = ("n_seasons", "n_onset", "n_complete")
    assert [three[c] for c in counts] == [3 * one[c] for c in counts] and one["n_onset"] == 2
    assert {k: v for k, v in one.items() if k not in counts} == {k: v for k, v in three.items() if k not in counts}
    assert seen == [2, 2]
