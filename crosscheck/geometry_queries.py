"""Storage along a space-filling curve, zone boundaries as data."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from seasonlens.operators import geometry as GE
from seasonlens.sources import layout as LA
from seasonlens.sources.tables import new_path

Z_SQL = "list_sum(list_transform(range(0, 31), lambda i: ((row::BIGINT >> i) & 1) * (2::BIGINT << (2 * i)::INTEGER) + ((col::BIGINT >> i) & 1) * (1::BIGINT << (2 * i)::INTEGER)))"


@query("snk1_curve_key", f"SELECT px_id, CAST({Z_SQL} AS BIGINT) AS z FROM v_cells")
def _(spark, sf):
    return I.cells(spark, sf).select("px_id", LA.morton("row", "col").alias("z"))


@query("zone3_curve_box", "SELECT px_id, elev_m FROM v_cells WHERE lon BETWEEN 34 AND 38 AND lat BETWEEN 3 AND 5")
def _(spark, sf):
    """Cells stored along the curve; a box read as key ranges, then cut by degrees."""
    path = new_path(spark, "curve")
    LA.write_curve(I.cells(spark, sf), path, tile_bits=4)
    box = LA.read_box(spark, path, *LA.box_cells(I.SPEC, (34, 38), (3, 5)), tile_bits=4)
    return box.filter(F.col("lon").between(34, 38) & F.col("lat").between(3, 5)).select("px_id", "elev_m")


def _zones(spark, sf):
    """Zones of four by three cells of like parts; parts of some sizes stay single cells inside them."""
    part = I.table(spark, sf, "part").select(F.col("p_partkey").alias("px_id"), (F.col("p_size") % 7).alias("m"))
    z = I.cells(spark, sf).select("px_id", "row", "col").join(part, "px_id")
    block = F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 3)
    return z.select("row", "col", F.when(F.col("m") == 0, -1).otherwise(block % 7).cast("int").alias("code"))


SIDES = """
    z AS (SELECT row, col, CAST(CASE WHEN p_size % 7 = 0 THEN -1 ELSE (row // 4 * 100 + col // 3) % 7 END AS INTEGER) AS code
          FROM v_cells JOIN part ON p_partkey = px_id),
    s AS (SELECT a.code, b.code AS other FROM (SELECT *, unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc FROM z) a
          LEFT JOIN z b ON b.row = a.row + a.dr AND b.col = a.col + a.dc WHERE a.code IS DISTINCT FROM b.code)"""


@query("zone2_shared_borders", f"WITH {SIDES} SELECT code, coalesce(other, -9) AS other, count(*) AS length FROM s GROUP BY ALL")
def _(spark, sf):
    """Length of the border of every zone with every other one and with the outside (-9), from dissolved edges."""
    b = GE.dissolve_edges(GE.cell_edges(_zones(spark, sf), "code"))
    both = b.select(F.explode(F.array(F.struct(F.col("left").alias("code"), F.col("right").alias("other")),
                                      F.struct(F.col("right").alias("code"), F.col("left").alias("other")))).alias("e")).select("e.*")
    return both.filter(F.col("code").isNotNull()).groupBy("code", F.coalesce("other", F.lit(-9)).alias("other")).agg(F.count(F.lit(1)).alias("length"))


@query("zone2_dissolved_rings", f"""
    WITH {SIDES} SELECT code, area, length FROM (SELECT code, CAST(count(*) AS DOUBLE) AS area FROM z GROUP BY code)
    JOIN (SELECT code, count(*) AS length FROM s GROUP BY code) USING (code)""")
def _(spark, sf):
    """Area and outline of dissolved zones, from their rings."""
    r = GE.rings(GE.arcs(GE.dissolve_edges(GE.cell_edges(_zones(spark, sf), "code"))))
    return r.groupBy("code").agg(F.sum("area").alias("area"), F.sum(F.size("points") - 1).cast("long").alias("length"))


@query("zone2_simplified_area", f"WITH {SIDES} SELECT count(*) AS cells, CAST(count(*) AS DOUBLE) AS area FROM z")
def _(spark, sf):
    """Borders simplified; the outline is kept, so that what a zone loses its neighbours gain and the sum stays."""
    cells = _zones(spark, sf)
    lines = GE.arcs(GE.dissolve_edges(GE.cell_edges(cells, "code")))
    thin = GE.simplify_arcs(lines.filter(F.col("right").isNotNull()), 1.0).unionByName(lines.filter(F.col("right").isNull()))
    e = GE.arc_edges(thin)
    area = e.agg(F.round(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2, 6).alias("area"))
    return area.select(cells.agg(F.count(F.lit(1)).alias("n")).scalar().alias("cells"), "area")
