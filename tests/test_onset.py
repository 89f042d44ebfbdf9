from pyspark.sql import functions as F

from seasonlens.operators import onset as O

P = "px_id int, year int, dekad int, p double, et0 double"


def rain(spark, by_px, et0=40.0):
    rows = [(px, 2000, 7 + i, v, et0) for px, vals in by_px.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, P)


def onset_of(spark, by_px, **kw):
    return {r.px_id: r.onset for r in O.rain_onset(rain(spark, by_px, kw.pop("et0", 40.0)), 7, 11, **kw).collect()}


def test_rule_edges(spark):
    got = onset_of(spark, {
        1: [25.0, 10.0, 10.0, 0.0, 0.0],      # exactly 25 and 20
        2: [25.0, 10.0, 9.9, 0.0, 0.0],       # 19.9 after
        3: [0.0, 0.0, 0.0, 30.0, 30.0],       # only in the last two dekads: no look-ahead
        4: [30.0, None, 30.0, 10.0, 10.0],    # NULL in the look-ahead masks the candidate
        5: [0.0, 30.0, 15.0, 15.0, 0.0],
    })
    assert got == {1: 7, 2: None, 3: None, 4: 9, 5: 8}


def test_pet_gate(spark):
    assert onset_of(spark, {1: [25.0, 10.0, 10.0, 0.0, 0.0]}, pet="et0", et0=50.0) == {1: 7}
    assert onset_of(spark, {1: [25.0, 10.0, 10.0, 0.0, 0.0]}, pet="et0", et0=51.0) == {1: None}


def g_rows(spark, by_px, lo=7):
    return spark.createDataFrame([(px, 2000, lo + i, v) for px, vals in by_px.items() for i, v in enumerate(vals)],
                                 "px_id int, year int, dekad int, g double")


def sos_of(spark, by_px, **kw):
    return {r.px_id: r.sos for r in O.detect_sos(g_rows(spark, by_px), 7, 11, **kw).collect()}


def test_sos_slope_modes(spark):
    series = {1: [0.2, 0.2, 0.2, 0.2, 0.2],   # flat: threshold met at once, never rising
              2: [0.9, 0.5, 0.1, 0.4, 0.8],   # falling past the threshold first
              3: [0.1, 0.1, 0.2, 0.5, 0.9]}
    assert sos_of(spark, series) == {1: None, 2: 10, 3: 10}
    assert sos_of(spark, series, as_coded=True) == {1: 7, 2: 7, 3: 10}


def test_sos_prior(spark):
    prior = spark.createDataFrame([(1, 9.0), (2, 13.0)], "px_id int, prior double")
    series = {1: [0.1, 0.4, 0.5, 0.6, 0.9], 2: [0.1, 0.4, 0.5, 0.6, 0.9], 3: [0.1, 0.4, 0.5, 0.6, 0.9]}
    # px 1: dekad 8 is within 2 of 9; px 2: only 11 is, but the last dekad cannot qualify; px 3: no prior
    assert sos_of(spark, series, prior=prior) == {1: 8, 2: None, 3: 8}


def daily(spark, px, start, vals):
    rows = [(px, i, float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "px_id int, i int, rain_mm double").select(
        "px_id", F.date_add(F.lit(start).cast("date"), F.col("i")).alias("d"), "rain_mm")


def planting(spark, *rows):
    return spark.createDataFrame(list(rows), "px_id int, year int, planting int")


def test_gate_dry_runs_and_wet_day_edge(spark):
    # dekad 8 of 2001 starts on 11 March
    seven = [10, 10] + [0] * 7 + [1.0] + [0] * 7 + [5] * 3
    eight = [10, 10] + [0] * 8 + [1.0] + [0] * 6 + [5] * 3
    d = daily(spark, 1, "2001-03-11", seven).union(daily(spark, 2, "2001-03-11", eight))
    pl = planting(spark, (1, 2001, 8), (2, 2001, 8), (3, 2001, 8), (4, 2001, None))
    got = {r.px_id: (r.max_dry_days, r.onset_acc_mm) for r in O.post_onset_rain(pl, d).collect()}
    assert got == {1: (7, 20.0), 2: (8, 20.0), 3: (20, 0.0)}  # no record at all is all dry
    kept = {r.px_id: (r.planting, r.false_start) for r in O.gate_false_starts(pl, d).collect()}
    assert kept == {1: (8, 0), 2: (None, 1), 3: (None, 1), 4: (None, None)}


def test_gate_index_mode_loses_days_before_the_scan(spark):
    d = daily(spark, 1, "2001-03-01", [10] * 40)
    pl = planting(spark, (1, 2001, 6))            # one dekad before the scan starts at dekad 7
    real = O.post_onset_rain(pl, daily(spark, 1, "2001-02-21", [10] * 40)).first()
    coded = O.post_onset_rain(pl, d, scan=(7, 17), as_coded=True).first()
    assert (real.max_dry_days, real.onset_acc_mm) == (0, 50.0)
    assert (coded.max_dry_days, coded.onset_acc_mm) == (0, 0.0)  # the trigger window precedes the scan


def test_gate_across_the_year_end(spark):
    d = daily(spark, 1, "2001-12-21", [10] * 30)
    got = O.post_onset_rain(planting(spark, (1, 2001, 36), (1, 2002, 0)), d).orderBy("year").collect()
    assert [(r.max_dry_days, r.onset_acc_mm) for r in got] == [(0, 50.0), (0, 50.0)]


def test_prior_modes(spark):
    r = spark.createDataFrame([(1, 9.0), (2, 9.0)], "px_id int, onset_ltn double")
    p = spark.createDataFrame([(1, 11.0), (3, 11.0)], "px_id int, pheno_ltn double")
    lead = {x.px_id: x.prior for x in O.season_prior(r, p).collect()}
    pheno = {x.px_id: x.prior for x in O.season_prior(r, p, "phenology_led").collect()}
    assert lead == {1: 10.0, 2: 9.0, 3: None} and pheno == {1: 11.0, 2: 9.0, 3: 11.0}


def test_growing_period_crosses_the_year_end(spark):
    rows = [(1, k, 60.0 if k >= 34 or k <= 4 else 5.0, 50.0) for k in range(1, 37)] + [(2, k, 60.0, 50.0) for k in range(1, 37)]
    got = {r.px_id: r.lgp for r in O.growing_period(spark.createDataFrame(rows, "px_id int, dekad int, p double, et0 double")).collect()}
    assert got == {1: 7, 2: 36}


def test_last_viable_planting(spark):
    rows = [(1, k, 60.0 if k in (28, 36, 2) else 1.0, 50.0) for k in range(1, 37)] + [(2, 30, 1.0, 50.0)]
    got = {r.px_id: r.lvpd for r in O.last_viable_planting(spark.createDataFrame(rows, "px_id int, dekad int, p double, et0 double")).collect()}
    assert got == {1: 38 - 6, 2: None}
