import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seasonlens.config import EXCESS_WEIGHT, MAIZE, MAIZE_EARLY, SoilConfig
from seasonlens.functions import climate as CM, masks as M
from seasonlens.operators import balance as B, risk as R, soil as SO


def kc(dsp, p):
    if dsp < 0 or dsp >= p.lgp:
        return 0.0
    if dsp < p.l_ini:
        return p.kc_ini
    if dsp < p.veg_end:
        return p.kc_ini + (dsp - p.l_ini) / p.l_dev * (p.kc_mid - p.kc_ini)
    if dsp < p.flo_end:
        return p.kc_mid
    return p.kc_mid + (dsp - p.flo_end) / p.l_late * (p.kc_end - p.kc_mid)


def test_kc_breakpoints(spark):
    dsps = [-1, 0, 3, 5, 7, 10, 11, 12]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dsps], "dsp int").select(CM.crop_coefficient("dsp", MAIZE)).collect()]
    assert got == pytest.approx([kc(d, MAIZE) for d in dsps])


def test_mask_survives_min_and_max(spark):
    r = spark.range(1).select(M.nmin(F.lit(None).cast("double"), F.lit(3.0)), M.nmax(F.lit(1.0), F.lit(3.0)), M.clamp(F.lit(9.0), 0, 1)).first()
    assert tuple(r) == (None, 3.0, 1.0)


def climate(spark, seasons, first=6):
    """seasons: {px: [(p, et0), ...]} from gd ``first`` of 2000, running into 2001."""
    rows = []
    for px, vals in seasons.items():
        for i, (p, e) in enumerate(vals):
            gd = first + i
            rows.append((px, 2000 + (gd - 1) // 36, (gd - 1) % 36 + 1, p, e))
    return spark.createDataFrame(rows, "px_id int, year int, dekad int, p double, et0 double")


def plant(spark, rows):
    return spark.createDataFrame([(px, 2000, k) for px, k in rows.items()], "px_id int, year int, planting int")


def model(vals, first, planting, p, whc, ss, se, staged=False):
    """Plain loop over the same formulas."""
    sw = aet_sum = wr_sum = 0.0
    out = {f"{k}_{s}": 0.0 for k in ("wrsi", "wsi", "aet", "wr") for s in ("veg", "flo", "grf")}
    bounds = {"veg": (0, p.veg_end), "flo": (p.veg_end, p.flo_end), "grf": (p.flo_end, p.lgp)}
    for gd in range(max(1, ss - 1), se + p.lgp + (3 if staged else 2)):
        rain, et0 = vals[gd - first]
        dsp = gd - planting
        wr = kc(dsp, p) * et0
        aet = min(sw + rain, wr)
        sw = max(min(sw + rain - aet, whc), 0.0)
        aet_sum, wr_sum = aet_sum + aet, wr_sum + wr
        for s, (lo, hi) in bounds.items():
            if dsp == hi:
                out[f"wrsi_{s}"] = aet_sum / max(wr_sum, 1e-6) * 100
            if lo <= dsp < hi:
                out[f"wsi_{s}"] = max(out[f"wsi_{s}"], min(max(1 - aet / max(wr, 1e-6), 0), 1) * 100)
                out[f"aet_{s}"] += aet
                out[f"wr_{s}"] += wr
    return out | {"wrsi": aet_sum / max(wr_sum, 1e-6) * 100, "sw": sw, "deficit": wr_sum - aet_sum}


def test_balance_against_a_loop(spark):
    rng = random.Random(4)
    # window 28..34: the cycle crosses the year end
    vals = {px: [(rng.choice([0.0, 5.0, 30.0, 80.0]), rng.uniform(30, 60)) for _ in range(30)] for px in range(12)}
    plants = {px: 28 + px % 7 for px in vals}
    cl = climate(spark, vals, 27)
    got = {r.px_id: r for r in B.water_balance(cl, plant(spark, plants), MAIZE_EARLY, 28, 34).collect()}
    st = {r.px_id: r for r in B.staged_balance(cl, plant(spark, plants), MAIZE_EARLY, 28, 34).collect()}
    for px, v in vals.items():
        want = model(v, 27, plants[px], MAIZE_EARLY, 100.0, 28, 34)
        assert got[px].wrsi == pytest.approx(want["wrsi"]) and got[px].sw_end_mm == pytest.approx(want["sw"])
        assert got[px].deficit_mm == pytest.approx(want["deficit"]) and 0 <= got[px].wrsi <= 100
        want = model(v, 27, plants[px], MAIZE_EARLY, 100.0, 28, 34, staged=True)
        for c in B.STAGED:
            assert st[px][c] == pytest.approx(want[c]), c


def test_sanity_cases(spark):
    n = 30
    vals = {1: [(0.0, 50.0)] * n, 2: [(200.0, 50.0)] * n, 3: [(200.0, 50.0)] * 10 + [(0.0, 50.0)] * 4 + [(200.0, 50.0)] * 16,
            4: [(200.0, 50.0)] * 9 + [(None, 50.0)] + [(200.0, 50.0)] * 20}
    w = {r.px_id: r.wrsi for r in B.water_balance(climate(spark, vals), plant(spark, {k: 8 for k in vals}), MAIZE, 7, 15).collect()}
    assert w[1] == 0 and w[2] == pytest.approx(100) and 0 < w[3] < 100 and w[4] is None
    s = {r.px_id: r for r in B.staged_balance(climate(spark, vals), plant(spark, {k: 8 for k in vals}), MAIZE, 7, 15).collect()}
    assert s[4].wrsi_grf is None and s[4].wsi_veg is None and s[2].wsi_flo == pytest.approx(0)


def test_unplanted_and_unknown_capacity_stay_masked(spark):
    cl = climate(spark, {1: [(200.0, 50.0)] * 30, 2: [(200.0, 50.0)] * 30})
    whc = spark.createDataFrame([(1, 80.0)], "px_id int, whc_mm double")
    w = {r.px_id: r.wrsi for r in B.water_balance(cl, plant(spark, {1: 8, 2: 8}), MAIZE, 7, 15, whc).collect()}
    assert w[1] == pytest.approx(100) and w[2] is None
    rows = B.with_capacity(B.season_series(cl, 6, 28).withColumn("planting", F.lit(None).cast("int")), None)
    assert B.add_water_balance(rows, MAIZE, (6, 28)).first().wrsi is None


def test_stage_without_demand_saturates(spark):
    one = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 10.0, 10.0)], "aet_veg double, wr_veg double, aet_flo double, wr_flo double, aet_grf double, wr_grf double")
    r = one.select(R.stage_deficit("veg"), R.water_stress()).first()
    assert r[0] == 1.0 and r[1] == pytest.approx(0.4)


def aeration_model(rain, onset, fc, sat, tau, p, ss, n, coded):
    thr = fc + (sat - fc) * 0.5
    w, run, peak = fc * 0.8, 0.0, 0.0
    for i in range(n):
        dsp = i - (onset - ss) * 10
        w = min(max(w + rain.get(i, 0.0) - 4.0, 0.0), sat)
        w = fc + max(w - fc, 0) * (1 - tau) if coded else w - max(w - fc, 0) * tau
        aer = min(max((w - thr) / max(sat - thr, 1e-3), 0), 1)
        d = dsp / 10
        wt = EXCESS_WEIGHT["veg"] if d < p.veg_end else EXCESS_WEIGHT["flo"] if d < p.flo_end else EXCESS_WEIGHT["grf"]
        run = (run + aer * wt) if (w > thr and 0 <= dsp < p.lgp * 10) else 0.0
        peak = max(peak, run)
    return min(max(peak / 4, 0), 1) * 100


@pytest.mark.parametrize("coded", [False, True])
def test_aeration_against_a_loop(spark, coded):
    rng = random.Random(7)
    ss, se = 30, 34                               # days run past the year end
    n = (se - ss + MAIZE.lgp) * 10 + 15
    series = {px: {i: float(rng.choice([30, 60, 90])) for i in range(n) if rng.random() < 0.25} for px in range(8)}
    rows = [(px, i, v) for px, s in series.items() for i, v in s.items()]
    daily = spark.createDataFrame(rows, "px_id int, i int, rain_mm double").select(
        "px_id", F.date_add(F.lit("2000-10-21").cast("date"), F.col("i")).alias("d"), "rain_mm")
    hydro = spark.createDataFrame([(px, 250.0, 400.0, 0.1 + 0.1 * px) for px in series], "px_id int, fc_mm double, sat_mm double, tau double")
    pl = plant(spark, {px: ss + px % 5 for px in series})
    got = {r.px_id: r.waterlog_idx for r in B.aeration_stress(pl, daily, hydro, MAIZE, ss, se, as_coded=coded).collect()}
    first = dt.date(2000, 10, 21)
    starts = {30: first, 31: dt.date(2000, 11, 1), 32: dt.date(2000, 11, 11), 33: dt.date(2000, 11, 21), 34: dt.date(2000, 12, 1)}
    for px, s in series.items():
        k, days = ss + px % 5, (se - ss + MAIZE.lgp) * 10 + 2
        if not coded:                             # the series as seen from the planting dekad's first day
            shift = (starts[k] - first).days
            s, k, days = {i - shift: v for i, v in s.items() if i >= shift}, ss, MAIZE.lgp * 10
        assert got[px] == pytest.approx(aeration_model(s, k, 250.0, 400.0, 0.1 + 0.1 * px, MAIZE, ss, days, coded))


def test_clock_wraps_and_stops(spark):
    temps = spark.createDataFrame([(1, 2000 + (gd - 1) // 36, (gd - 1) % 36 + 1, 29.0, 19.0) for gd in range(28, 53)],
                                  "px_id int, year int, dekad int, tmax_c double, tmin_c double")
    mat = spark.createDataFrame([(1, 1500.0)], "px_id int, gdd_maturity double")
    sos = spark.createDataFrame([(1, 2000, 30), (1, 2001, None)], "px_id int, year int, sos int")
    r = B.gdd_clock(temps, sos, mat, 28, 52).collect()
    # 150 degree-days a dekad: thresholds 675, 825, 975, 1500
    assert len(r) == 1 and (r[0].peak_vegetative_dekad, r[0].flowering_dekad, r[0].grain_filling_dekad, r[0].maturity_dekad) == (34, 35, 36, 39)
    assert r[0].gdd_total == 150 * 23


def test_capacity_orders_soils(spark):
    mk = lambda px, clay, sand: [(px, t, b, clay, sand, 100.0) for t, b in ((0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200))]
    layers = spark.createDataFrame(mk(1, 60.0, 900.0) + mk(2, 450.0, 200.0), "px_id int, top_cm int, bot_cm int, clay_gkg double, sand_gkg double, soc_dgkg double")
    w = {r.px_id: r.whc_mm for r in SO.texture_whc(layers).collect()}
    assert 25 <= w[1] < w[2]
    h = {r.px_id: r for r in SO.hydraulics(layers).collect()}
    assert h[1].tau > h[2].tau and all(r.sat_mm >= r.fc_mm + 10 for r in h.values())
    stored = SO.water_capacity(layers, None, SoilConfig(), stored=spark.createDataFrame([(1, 5.0)], "px_id int, whc_mm double"))
    assert stored.first().whc_mm == 5.0


def test_radiation_near_the_pole_is_finite(spark):
    r = spark.range(1).select(CM.extraterrestrial_radiation(F.lit(89.0), F.lit(355)), CM.extraterrestrial_radiation(F.lit(0.0), F.lit(80))).first()
    assert r[0] == pytest.approx(0, abs=1e-6) and 14 < r[1] < 16
