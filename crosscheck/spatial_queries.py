"""Neighbourhoods, regridding, overlay, two-date fusion."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.util import rounded
from crosscheck.views import unit
from seasonlens.functions.climate import lapse_correct
from seasonlens.operators import fusion as FU, spatial as SP

FM = lambda r: f"""
    SELECT t.px_id, t.row, t.col, avg(n.elev_m) AS m FROM v_cells t JOIN v_cells n
      ON n.row BETWEEN t.row - {r} AND t.row + {r} AND n.col BETWEEN t.col - {r} AND t.col + {r} GROUP BY ALL"""


@query("focal1_square_mean", f"SELECT px_id, row, col, round(m, 6) AS elev_m_fm FROM ({FM(3)})")
def _(spark, sf):
    return rounded(SP.focal_mean(I.cells(spark, sf).select("px_id", "row", "col", "elev_m"), ["elev_m"], 3), "elev_m_fm").drop("elev_m")


@query("focal2_circle_mean", """
    SELECT t.px_id, round(avg(n.elev_m), 6) AS elev_m_fm FROM v_cells t JOIN v_cells n
      ON (n.row-t.row)*(n.row-t.row) + (n.col-t.col)*(n.col-t.col) <= 4 GROUP BY ALL""")
def _(spark, sf):
    m = SP.focal_mean_circle(I.cells(spark, sf).select("px_id", "row", "col", "elev_m"), ["elev_m"], 20.0, 10.0)
    return rounded(m.select("px_id", "elev_m_fm"), "elev_m_fm")


@query("grid1_nearest", "SELECT px_id, dekad, round(c, 10) AS c FROM v_fc")
def _(spark, sf):
    return rounded(I.fine_coarse(spark, sf).select("px_id", "dekad", "c"), "c", n=10)


@query("grid2_bilinear", """
    SELECT px_id, round(sum(w * v) / sum(w), 9) AS v FROM (
      SELECT p.px_id, c.v, (1 - abs(p.y - c.row)) * (1 - abs(p.x - c.col)) AS w
      FROM (SELECT px_id, (55e-1 - lat) / 5e-1 - 5e-1 AS y, (lon - 33e0) / 5e-1 - 5e-1 AS x FROM v_cells) p
      JOIN (SELECT row // 4 AS row, col // 4 AS col, avg(elev_m) AS v FROM v_cells GROUP BY ALL) c
        ON c.row IN (floor(p.y), floor(p.y) + 1) AND c.col IN (floor(p.x), floor(p.x) + 1)) WHERE v IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    cells = I.cells(spark, sf)
    coarse = cells.groupBy(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 4).cast("int").alias("col")).agg(F.avg("elev_m").alias("v0"))
    return rounded(SP.bilinear(cells, coarse, SP.GridSpec(33.0, 5.5, 0.5), "v0", "v"), "v", n=9)


@query("grid3_canvas", """
    WITH h AS (SELECT max(row) + 1 AS h, greatest((max(row) + 1) * 5 // 12, 1) AS m FROM v_cells), i AS (SELECT unnest(range(0, m)) AS i, h, m FROM h)
    SELECT px_id, i AS out_row, j AS out_col FROM v_cells JOIN i ON row = floor((i + 5e-1) * h / m)
    JOIN (SELECT unnest(range(0, 24)) AS j) ON col = floor((j + 5e-1) * 64 / 24)""")
def _(spark, sf):
    cells = I.cells(spark, sf)
    h = cells.withColumn("_h", cells.agg(F.max("row") + 1).scalar())
    m = F.greatest(F.floor(F.col("_h") * 5 / 12), F.lit(1))
    return SP.canvas_pixels(h, F.col("_h"), 64, m, 24).select("px_id", "out_row", "out_col")


# brute force: every cell against every edge
ZONE_SQL = """
    SELECT px_id, max(seq) AS seq FROM (
      SELECT c.px_id, e.seq FROM v_cells c JOIN v_edges e
        ON ((e.y1 <= c.lat AND c.lat < e.y2) OR (e.y2 <= c.lat AND c.lat < e.y1))
       AND c.lon < e.x1 + (c.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
      GROUP BY c.px_id, e.seq HAVING count(*) % 2 = 1) GROUP BY px_id"""


@query("zone1_rasterize", f"SELECT px_id, seq FROM v_cells LEFT JOIN ({ZONE_SQL}) USING (px_id)")
def _(spark, sf):
    return SP.zone_of_pixels(I.cells(spark, sf), I.edges(spark, sf), I.SPEC).select("px_id", "seq")


@query("zone2_dissolve", f"""
    SELECT n_name AS code, count(*) AS n, round(avg(elev_m), 6) AS elev_m FROM v_cells JOIN ({ZONE_SQL}) USING (px_id)
    JOIN supplier ON s_suppkey = seq JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def _(spark, sf):
    z = SP.zone_of_pixels(I.cells(spark, sf), I.edges(spark, sf), I.SPEC)
    attr = I.table(spark, sf, "supplier").join(I.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seq"), F.col("n_name").alias("code"))
    return SP.dissolve(z, attr, "seq", "code").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("elev_m"), 6).alias("elev_m"))


@query("zone3_clip", f"""
    SELECT px_id FROM v_cells WHERE lon BETWEEN 34 AND 38 AND lat BETWEEN 3 AND 5 AND px_id IN (SELECT px_id FROM ({ZONE_SQL}))""")
def _(spark, sf):
    box = SP.clip_box(I.cells(spark, sf), (34, 38), (3, 5))
    inside = SP.zone_of_pixels(I.cells(spark, sf), I.edges(spark, sf), I.SPEC).filter(F.col("seq").isNotNull())
    return SP.clip_zone(box, inside).select("px_id")


@query("caf1_crop_area_fraction", """
    SELECT county, constituency, name, round_even(count(CASE WHEN planting BETWEEN 1 AND 36 THEN 1 END) / count(*), 4) AS crop_area_frac
    FROM v_pixels GROUP BY ALL""")
def _(spark, sf):
    return SP.crop_area_fraction(I.pixels(spark, sf), ["county", "constituency", "name"])


@query("lapse1_temperature", f"""
    SELECT px_id, round(25e0 - 65e-4 * (elev_m - m), 6) AS t_c FROM v_cells JOIN (SELECT px_id, m FROM ({FM(25)})) USING (px_id)""")
def _(spark, sf):
    m = SP.focal_mean(I.cells(spark, sf).select("px_id", "row", "col", "elev_m"), ["elev_m"], 25)
    return m.select("px_id", F.round(lapse_correct(F.lit(25.0), "elev_m", "elev_m_fm"), 6).alias("t_c"))


# ---- two-date fusion, window dekads 9..13 -> targets 8..14 -------------------------------------
PAIRS = ", ".join(f"({d}, {b0}, {b1})" for d, b0, b1 in FU.base_pairs(9, 13))
FUSE_SQL = f"""
    pairs AS (SELECT * FROM (VALUES {PAIRS}) t(dekad, b0, b1)),
    targets AS (SELECT dekad, b0 AS base FROM pairs UNION SELECT dekad, b1 FROM pairs),
    b AS (SELECT px_id, row, col, dekad AS base, coalesce(f, c) AS f0, c AS c0 FROM v_fc WHERE dekad IN (SELECT base FROM targets)),
    mom AS (SELECT t.px_id, t.base, avg(n.f0) AS mf, avg(n.c0) AS mc, avg(n.f0*n.c0) AS mfc, avg(n.c0*n.c0) AS mcc
            FROM b t JOIN b n ON n.base = t.base AND n.row BETWEEN t.row-10 AND t.row+10 AND n.col BETWEEN t.col-10 AND t.col+10 GROUP BY ALL),
    sl AS (SELECT px_id, base, least(greatest((mfc - mf*mc) / greatest(mcc - mc*mc, 1e-6), 1e-1), 5e0) AS v FROM mom),
    raw AS (SELECT b.px_id, b.row, b.col, t.dekad, b.base, b.c0, x.c AS ct, b.f0 + s.v * (x.c - b.c0) AS r
            FROM b JOIN sl s USING (px_id, base) JOIN targets t USING (base) JOIN v_fc x ON x.px_id = b.px_id AND x.dekad = t.dekad),
    fm AS (SELECT t.px_id, t.dekad, t.base, avg(n.r) AS m FROM raw t JOIN raw n ON n.dekad = t.dekad AND n.base = t.base
           AND n.row BETWEEN t.row-2 AND t.row+2 AND n.col BETWEEN t.col-2 AND t.col+2 GROUP BY ALL),
    pred AS (SELECT raw.*, r + (ct - m) AS pred FROM raw JOIN fm USING (px_id, dekad, base)),
    fused AS (SELECT px_id, dekad, CASE WHEN count(pred) = count(*) THEN least(greatest(sum(pred / (abs(ct - c0) + 1e-3)) / sum(1 / (abs(ct - c0) + 1e-3)), -2e-1), 1e0) END AS g
              FROM pred GROUP BY ALL)"""


def _bases(spark, sf):
    return I.fine_coarse(spark, sf).select("px_id", "row", "col", "dekad", F.coalesce("f", "c").alias("f"), "c")


SLOPE_SQL = """
    b AS (SELECT px_id, row, col, dekad, coalesce(f, c) AS f, c FROM v_fc),
    sl AS (SELECT t.px_id, t.dekad, least(greatest((avg(n.f*n.c) - avg(n.f)*avg(n.c)) / greatest(avg(n.c*n.c) - avg(n.c)*avg(n.c), 1e-6), 1e-1), 5e0) AS v
           FROM b t JOIN b n ON n.dekad = t.dekad AND n.row BETWEEN t.row-10 AND t.row+10 AND n.col BETWEEN t.col-10 AND t.col+10 GROUP BY ALL)"""


@query("fuse4_local_slope", f"WITH {SLOPE_SQL} SELECT px_id, dekad, round(v, 6) AS v FROM sl")
def _(spark, sf):
    return rounded(FU.local_slope(_bases(spark, sf), 10, ("dekad",)).select("px_id", "dekad", "v"), "v")


@query("fuse5_unbiased_prediction", f"""
    WITH {SLOPE_SQL},
    r AS (SELECT b.px_id, b.row, b.col, b.dekad, b.f + sl.v * (y.c - b.c) AS r, y.c AS ct FROM b JOIN sl USING (px_id, dekad) JOIN v_fc y ON y.px_id = b.px_id AND y.dekad = b.dekad + 1)
    SELECT t.px_id, t.dekad, round(any_value(t.r + t.ct) - avg(n.r), 6) AS pred FROM r t JOIN r n ON n.dekad = t.dekad AND n.row BETWEEN t.row-2 AND t.row+2 AND n.col BETWEEN t.col-2 AND t.col+2 GROUP BY ALL""")
def _(spark, sf):
    """Every dekad predicts the next one with its own local slope.  Slope (10 cells) and residual (2) reach 12 in all: one shuffle."""
    rows = I.fine_coarse_tiles(spark, sf, 10, 12).withColumn("f", F.coalesce("f", "c"))
    keys = (*SP.TILE, "dekad")
    base = FU.local_slope(rows, 10, keys, dense=True).withColumnsRenamed({"f": "f0", "c": "c0"})
    preds = FU.predict_unbiased(base, 2, keys, dense=True).filter(F.col("_own") & F.col("px_id").isNotNull())
    return rounded(preds.select("px_id", "dekad", "pred"), "pred")


@query("fuse6_pair_blend", """
    WITH fc AS MATERIALIZED (SELECT px_id, dekad, f, c FROM v_fc)
    SELECT px_id, dekad, round((f0 / (abs(ct-c0)+1e-3) + f1 / (abs(ct-c1)+1e-3)) / (1/(abs(ct-c0)+1e-3) + 1/(abs(ct-c1)+1e-3)), 10) AS g
    FROM (SELECT px_id, dekad + 1 AS dekad, coalesce(f, c) AS f0, c AS c0 FROM fc) JOIN (SELECT px_id, dekad - 1 AS dekad, coalesce(f, c) AS f1, c AS c1 FROM fc) USING (px_id, dekad)
    JOIN (SELECT px_id, dekad, c AS ct FROM fc) USING (px_id, dekad)""")
def _(spark, sf):
    """Every dekad that has one on both sides, blended from its two neighbours."""
    ct = I.fine_coarse(spark, sf).filter(F.col("dekad").between(2, 35)).select("px_id", "dekad", F.col("c").alias("ct"))
    near = _bases(spark, sf).select("px_id", F.explode(F.array(F.col("dekad") - 1, F.col("dekad") + 1)).alias("dekad"), F.col("f").alias("pred"), F.col("c").alias("c0"))
    return rounded(FU.blend_pairs(near.join(ct, ["px_id", "dekad"]), ("px_id", "dekad")), "g", n=10)


def _fused(spark, sf):
    fc = I.fine_coarse(spark, sf)
    return FU.fused_series(spark, fc, fc.select("px_id", "dekad", "c"), 9, 13)


@query("fuse7_gap_free_series", f"WITH {FUSE_SQL} SELECT px_id, dekad, round(g, 10) AS g FROM fused")
def _(spark, sf):
    return rounded(_fused(spark, sf).select("px_id", "dekad", "g"), "g", n=10)


@query("fuse8_calibrated_fill", f"""
    WITH {FUSE_SQL},
    s AS (SELECT u.px_id, u.dekad, x.f AS ndre1, CASE WHEN x.c > 4e-1 THEN x.c END AS fpar, x.c AS rvi, u.g FROM fused u JOIN v_fc x USING (px_id, dekad) WHERE u.dekad BETWEEN 9 AND 14),
    m AS (SELECT px_id, avg(ndre1) AS mn, stddev_pop(ndre1) AS sn, avg(g) AS me, greatest(stddev_pop(g), 1e-3) AS se FROM s GROUP BY ALL)
    SELECT px_id, dekad, round(coalesce(({unit('ndre1', '0e0', '7e-1')} + {unit('fpar', '0e0', '9e-1')}) / 2,
           {unit('mn + (g - me) * (sn / se)', '0e0', '7e-1')}, {unit('rvi', '1e-1', '8e-1')}), 6) AS g FROM s JOIN m USING (px_id)""")
def _(spark, sf):
    fc = I.fine_coarse(spark, sf).select(
        "px_id", "dekad", F.col("f").alias("ndre1"), F.when(F.col("c") > 0.4, F.col("c")).alias("fpar"), F.col("c").alias("rvi"))
    s = _fused(spark, sf).filter(F.col("dekad").between(9, 14)).select("px_id", "dekad", "g").join(fc, ["px_id", "dekad"])
    return rounded(FU.calibrated_fill(s), "g")
