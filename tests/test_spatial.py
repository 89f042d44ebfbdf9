import random

import pytest
from pyspark.sql import functions as F

from seasonlens.operators import fusion as FU, spatial as SP


def grid(spark, fn, n=5, m=5, holes=()):
    return spark.createDataFrame([(r, c, None if (r, c) in holes else float(fn(r, c))) for r in range(n) for c in range(m)], "row int, col int, v double")


def test_square_mean_ramp(spark):
    got = {(r.row, r.col): r.v_fm for r in SP.focal_mean(grid(spark, lambda r, c: r * 5 + c), ["v"], 1, dense=True).collect()}
    assert got[(2, 2)] == 12 and got[(0, 0)] == 3


def brute(cells, r):
    out = {}
    for (y, x) in cells:
        near = [v for (b, a), v in cells.items() if abs(b - y) <= r and abs(a - x) <= r and v is not None]
        out[(y, x)] = sum(near) / len(near) if near else None
    return out


def test_square_mean_with_masked_and_absent_cells(spark):
    rng = random.Random(1)
    cells = {(r, c): (None if rng.random() < 0.2 else float(rng.randint(0, 9))) for r in range(9) for c in range(11) if rng.random() < 0.6}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, v double")
    got = {(r.row, r.col): r.v_fm for r in SP.focal_mean(df, ["v"], 2).collect()}
    want = brute(cells, 2)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_keys_do_not_mix(spark):
    a = grid(spark, lambda r, c: 1).withColumn("k", F.lit(1)).union(grid(spark, lambda r, c: 5).withColumn("k", F.lit(2)))
    got = {(r.k, r.v_fm) for r in SP.focal_mean(a, ["v"], 1, ("k",)).collect()}
    assert got == {(1, 1.0), (2, 5.0)}


def test_tiles_hold_all_that_two_windows_reach(spark):
    """Slope (reach 3), then residual (reach 2) inside small tiles: the same as on the whole grid, each place once."""
    rng = random.Random(2)
    value = lambda: None if rng.random() < 0.3 else rng.random()
    rows = spark.createDataFrame([(r, c, value(), value(), rng.random()) for r in range(-9, 25) for c in range(-3, 19)],
                                 "row int, col int, f double, c double, ct double")

    def predict(rows, keys):
        base = FU.local_slope(rows, 3, keys, dense=True).withColumnsRenamed({"f": "f0", "c": "c0"})
        return FU.predict_unbiased(base, 2, keys, dense=True)

    whole = {(r.row, r.col): r.pred for r in predict(rows, ()).collect()}
    own = predict(SP.in_tiles(rows, reach=5, size=8), SP.TILE).filter("_own").collect()
    got = {(r.row, r.col): r.pred for r in own}
    assert len(own) == len(got) == len(whole) == 34 * 22 and len({(r._tr, r._tc) for r in own}) > 9
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in whole.items())


def test_readings_dealt_to_tiles_give_the_same_cells(spark):
    from crosscheck import inputs as I
    sf = "/root/testdata/sf0.001"
    fc = I.fine_coarse(spark, sf)
    want = fc.join(fc.select("px_id", (F.col("dekad") - 1).alias("dekad"), F.col("c").alias("ct")), ["px_id", "dekad"])
    got = I.fine_coarse_tiles(spark, sf, 8, 8, size=16).filter(F.col("_own") & F.col("px_id").isNotNull())
    cols = ["px_id", "row", "col", "dekad", "f", "c", "ct"]
    assert got.select(SP.TILE[0], SP.TILE[1]).distinct().count() > 3
    assert sorted(map(tuple, got.select(cols).collect()), key=lambda r: (r[0], r[3])) == sorted(map(tuple, want.select(cols).collect()), key=lambda r: (r[0], r[3]))


def edges(spark, rings):
    rows = []
    for seq, pts in rings:
        rows += [(seq, *map(float, (*pts[i], *pts[(i + 1) % len(pts)]))) for i in range(len(pts))]
    return spark.createDataFrame(rows, "seq int, x1 double, y1 double, x2 double, y2 double")


SPEC = SP.GridSpec(0.0, 6.0, 1.0)


def cells6(spark):
    return spark.createDataFrame([(r, c) for r in range(6) for c in range(6)], "row int, col int")


def test_square_covers_sixteen_centres(spark):
    e = edges(spark, [(1, [(1, 1), (5, 1), (5, 5), (1, 5)])])
    assert SP.rasterize(e, SPEC).count() == 16


def test_later_polygon_overrides_and_hole(spark):
    e = edges(spark, [(1, [(0, 0), (6, 0), (6, 6), (0, 6)]), (1, [(2, 2), (4, 2), (4, 4), (2, 4)]), (2, [(0, 0), (2, 0), (2, 6), (0, 6)])])
    z = {(r.row, r.col): r.seq for r in SP.zone_of_pixels(cells6(spark), e, SPEC).collect()}
    assert z[(2, 2)] is None and z[(0, 0)] == 2 and z[(0, 5)] == 1 and sum(v == 1 for v in z.values()) == 20


def test_rasterize_matches_crossing_parity(spark):
    rng = random.Random(3)
    rings = [(s, [(rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(7)]) for s in range(4)]
    got = {(r.seq, r.row, r.col) for r in SP.rasterize(edges(spark, rings), SPEC).collect()}
    got = {g for g in got if 0 <= g[1] < 6 and 0 <= g[2] < 6}
    want = set()
    for s, pts in rings:
        for r in range(6):
            for c in range(6):
                x, y, n = c + 0.5, 6 - (r + 0.5), 0
                for i in range(len(pts)):
                    (x1, y1), (x2, y2) = pts[i], pts[(i + 1) % len(pts)]
                    if (y1 <= y < y2) or (y2 <= y < y1):
                        n += x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
                if n % 2:
                    want.add((s, r, c))
    assert got == want


def test_mosaic_later_valid_tile_wins(spark):
    t = spark.createDataFrame([(1, 0, 0, 5, -2), (2, 0, 0, 0, 3), (1, 0, 1, 0, 0), (2, 0, 1, 0, -7)], "tile_seq int, row int, col int, a int, b int")
    pos = {(r.row, r.col): (r.a, r.b) for r in SP.mosaic(t, ["a", "b"]).collect()}
    nz = {(r.row, r.col): (r.a, r.b) for r in SP.mosaic(t, ["a", "b"], rule="nonzero").collect()}
    assert pos == {(0, 0): (5, 3), (0, 1): (0, 0)} and nz == {(0, 0): (5, 3), (0, 1): (0, -7)}


def test_circle_offsets():
    assert len(SP.circle_offsets(30, 10)) == 29 and len(SP.circle_offsets(10, 10)) == 5


def test_base_pairs_cover_the_last_dekad():
    p = FU.base_pairs(9, 12)
    assert p[0] == (8, 8, 8) and p[1] == (9, 8, 10) and p[-1] == (13, 13, 13) and (11, 10, 12) in p


def test_bilinear_rescales_masked_corners(spark):
    coarse = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, None), (1, 1, 40.0)], "row int, col int, v double")
    pts = spark.createDataFrame([(1, 1.0, 5.0), (2, 0.5, 5.5)], "px_id int, lon double, lat double")
    got = {r.px_id: r.o for r in SP.bilinear(pts, coarse, SPEC, "v", "o").collect()}
    assert got[1] == pytest.approx(70 / 3) and got[2] == 10.0


def test_blend_masks_with_either_member(spark):
    rows = [(1, 0.4, 0.5, 0.4), (1, 0.6, 0.5, 0.5), (2, 0.4, 0.5, 0.4), (2, None, 0.5, 0.5)]
    d = spark.createDataFrame(rows, "px_id int, pred double, ct double, c0 double")
    got = {r.px_id: r.g for r in FU.blend_pairs(d, ("px_id",)).collect()}
    w0, w1 = 1 / 0.101, 1 / 0.001
    assert got[1] == pytest.approx((0.4 * w0 + 0.6 * w1) / (w0 + w1)) and got[2] is None
