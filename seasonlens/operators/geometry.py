"""Zone boundaries as data: dissolve by attribute, arcs between junctions, simplification that keeps neighbours closed, rings.

Zones are a planar mesh of directed edges (x1, y1, x2, y2) with the zone on the left (outer rings counter-clockwise, holes
clockwise; see ``directed``).  Neighbours share their edges end to end: an edge that meets another zone's vertex in
its middle does not cancel.  Two zones on one side of an edge (overlaps, repeated polygons) raise an error.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.sources.tables import new_path


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def directed(edges: DataFrame, ring: Sequence[str], hole: str = "hole") -> DataFrame:
    """Turn rings whose direction is unknown so that the zone lies on the left: the sign of a ring's area, against
    its ``hole`` flag, says whether to swap the ends of its edges."""
    area = edges.groupBy(*ring).agg(
        F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_a"), F.max(hole).alias("_h"))
    swap = (F.col("_a") < 0) != F.col("_h").cast("boolean")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return edges.join(area, list(ring)).withColumns(
        {"x1": pick("x1", "x2"), "y1": pick("y1", "y2"), "x2": pick("x2", "x1"), "y2": pick("y2", "y1")}).drop("_a", "_h")


def cell_edges(cells: DataFrame, code: str) -> DataFrame:
    """The four sides of every grid cell with a code, in units of cells, y upwards: raster zones as a mesh."""
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    side = lambda *v: F.struct(*[(e + 0.0).alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), v)])
    sides = F.array(side(c, -r - 1, c + 1, -r - 1), side(c + 1, -r - 1, c + 1, -r), side(c + 1, -r, c, -r), side(c, -r, c, -r - 1))
    return cells.filter(F.col(code).isNotNull()).select(F.col(code).alias("code"), F.explode(sides).alias("e")).select("code", "e.*")


def dissolve_edges(edges: DataFrame, code: str = "code") -> DataFrame:
    """Borders between zones of different code: start a, end b, ``left`` code and ``right`` code (NULL: outside).

    Edges of one code that run against each other cancel.  One aggregate by edge, whatever the size of a zone; an edge
    has two rows, so no key is hot.  A border runs with the smaller code on its left.
    """
    p, q = _point("x1", "y1"), _point("x2", "y2")
    on = lambda forward: F.when(F.col("_f") == forward, F.col(code))
    one = lambda forward: F.when(
        F.count(on(forward)) > 1, F.raise_error(F.lit("two zones on one side of an edge"))).otherwise(F.min(on(forward)))
    both = edges.filter((p != q) & F.col(code).isNotNull()).select(
        F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), (p < q).alias("_f"), code,
    ).groupBy("a", "b").agg(one(True).alias("left"), one(False).alias("right")).filter(~F.col("left").eqNullSafe(F.col("right")))
    turn = F.col("left").isNull() | (F.col("right") < F.col("left"))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return both.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("left", "right").alias("left"), pick("right", "left").alias("right"))


def _stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "chain")
    df.write.parquet(path)
    return spark.read.parquet(path)


def chain(links: DataFrame) -> DataFrame:
    """Place of every element of linked lists: id, prev (NULL at a head) -> id, head, pos, closed.

    Pointer doubling: after k rounds an element knows the one 2^k before it, so the rounds are the logarithm of the longest
    list.  Circles never reach a head: they are cut before their smallest id and doubled again.  An element is the
    target of one pointer at most, so no key is hot.
    """
    out = _double(links.select("id", "prev"))
    circles = out.filter(~F.col("done"))
    done = out.filter("done").select("id", F.col("far").alias("head"), F.col("hops").alias("pos"), F.lit(False).alias("closed"))
    if circles.isEmpty():
        return done
    cut = _double(circles.select("id", F.when(F.col("low") != F.col("id"), F.col("prev")).alias("prev")))
    return done.unionByName(cut.select("id", F.col("far").alias("head"), F.col("hops").alias("pos"), F.lit(True).alias("closed")))


def _double(links: DataFrame) -> DataFrame:
    head = F.col("prev").isNull()
    t = _stored(links.select("id", "prev", F.coalesce("prev", "id").alias("far"), F.when(head, 0).otherwise(1).cast("long").alias("hops"),
                             head.alias("done"), F.col("id").alias("low")))
    span, before = 1, None
    while True:
        left = t.filter(~F.col("done")).count()
        # a round without a new head leaves circles only; their smallest id is known once the span covers them
        if left == 0 or (left == before and span >= left):
            return t
        to = t.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("hops").alias("_hops"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        step = t.filter(~F.col("done")).join(to, "far").select(
            "id", "prev", F.col("_far").alias("far"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"),
            F.least("low", "_low").alias("low"))
        t, span, before = _stored(t.filter("done").unionByName(step)), span * 2, left


def arcs(borders: DataFrame) -> DataFrame:
    """Borders joined into arcs between junctions: arc, left, right, closed, points (in order, both ends included).

    A junction is a point where other than two borders meet.  Borders are those of ``dissolve_edges``; ``arc`` is the first
    border (its ends).  A row holds one arc: its size is the number of vertices between two junctions.
    """
    borders = _stored(borders.withColumn("id", F.struct("a", "b")))
    ends = borders.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(True).alias("out"), F.col("id")),
        F.struct(F.col("b").alias("node"), F.lit(False).alias("out"), F.col("id")))).alias("e")).select("e.*")
    through = ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("out"), F.col("id"))).alias("id"), F.max(F.when(~F.col("out"), F.col("id"))).alias("prev"),
    ).filter((F.col("n") == 2) & F.col("id").isNotNull() & F.col("prev").isNotNull())
    place = chain(borders.select("id").join(through.select("id", "prev"), "id", "left"))
    steps = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    return borders.join(place, "id").groupBy(F.col("head").alias("arc")).agg(
        F.first("left").alias("left"), F.first("right").alias("right"), F.first("closed").alias("closed"), steps.alias("s"),
    ).select("arc", "left", "right", "closed", F.concat(
        F.array(F.col("s")[0]["a"]), F.transform("s", lambda v: v["b"])).alias("points"))


def _keep(x: np.ndarray, y: np.ndarray, tol: float, least: int) -> np.ndarray:
    """Indices kept of one arc: between two kept points the farthest one is kept while it is over the tolerance, and
    ``least`` inner points are kept at any distance."""
    n = len(x)
    kept, inner = {0, n - 1}, 0
    todo = [_farthest(x, y, 0, n - 1)] if n > 2 else []
    while todo:  # a heap: the farthest point first
        far, at, i, j = heapq.heappop(todo)
        if -far <= tol and inner >= least:
            break
        kept.add(at)
        inner += 1
        for a, b in ((i, at), (at, j)):
            if b - a > 1:
                heapq.heappush(todo, _farthest(x, y, a, b))
    return np.array(sorted(kept), dtype="int32")


def _farthest(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[float, int, int, int]:
    """Distance (negated) and index of the point farthest from the line between two others."""
    px, py = x[i + 1:j] - x[i], y[i + 1:j] - y[i]
    dx, dy = x[j] - x[i], y[j] - y[i]
    length = dx * dx + dy * dy
    share = np.clip((px * dx + py * dy) / length, 0.0, 1.0) if length else 0.0
    d = np.hypot(px - share * dx, py - share * dy)
    k = int(np.argmax(d))
    return -float(d[k]), i + 1 + k, i, j


def simplify_arcs(lines: DataFrame, tolerance: float) -> DataFrame:
    """Arcs with fewer points, none of the dropped ones farther than the tolerance from the line that replaces it.

    An arc is simplified once and read by the zones of both its sides, so neighbours stay closed and
    junctions stay where they are.  A closed arc keeps two inner points and an arc that shares both ends with another one keeps one,
    so no zone collapses to a line.  Arcs that pass closer than the tolerance may come to cross.
    """
    tip = lambda k: F.element_at("points", k)
    lo, hi = F.least(tip(1), tip(-1)), F.greatest(tip(1), tip(-1))
    lines = _stored(lines.withColumns({"_lo": lo, "_hi": hi}))
    twins = lines.groupBy("_lo", "_hi").agg((F.count(F.lit(1)) > 1).alias("_twin"))

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([_keep(np.asarray(x), np.asarray(y), tolerance, n) for x, y, n in zip(xs, ys, least)])

    least = F.when(F.col("closed") | (F.col("_lo") == F.col("_hi")), 2).when(F.col("_twin"), 1).otherwise(0)
    return lines.join(twins, ["_lo", "_hi"]).withColumn("_k", kept(F.col("points.x"), F.col("points.y"), least)).withColumn(
        "points", F.transform("_k", lambda i: F.get("points", i))).drop("_k", "_lo", "_hi", "_twin")


def arc_edges(lines: DataFrame, code: str = "code") -> DataFrame:
    """Directed edges of arcs, one set for each side: code, x1, y1, x2, y2 (what ``spatial.rasterize`` reads)."""
    seg = lines.select("left", "right", "points", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("i")).select(
        "left", "right", F.col("points")[F.col("i")].alias("p"), F.col("points")[F.col("i") + 1].alias("q"))
    side = lambda c, p, q: F.struct(F.col(c).alias(code), F.col(f"{p}.x").alias("x1"), F.col(f"{p}.y").alias("y1"), F.col(f"{q}.x").alias("x2"), F.col(f"{q}.y").alias("y2"))
    return seg.select(F.explode(F.array(side("left", "p", "q"), side("right", "q", "p"))).alias("e")).select("e.*").filter(F.col(code).isNotNull())


def rings(lines: DataFrame) -> DataFrame:
    """Closed rings of every zone: code, points (first = last), area (negative for a hole).

    Where a zone touches itself in a point, a ring goes on along the next border of the same corner of the zone: pieces that
    touch in a point are rings of their own, no ring crosses itself or another, and holes that touch in a point may
    share a ring that passes the point twice.  A row holds one ring.
    """
    sides = F.array(
        F.struct(F.col("left").alias("code"), F.lit(False).alias("back"), F.col("points")),
        F.struct(F.col("right").alias("code"), F.lit(True).alias("back"), F.reverse("points").alias("points")))
    walk = _stored(lines.select("arc", F.explode(sides).alias("s")).filter(F.col("s.code").isNotNull()).select(
        F.struct("s.code", "arc", "s.back").alias("id"), "s.code", "s.points"))
    at = lambda k: F.element_at("points", k)
    angle = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    outs = walk.select("code", at(1).alias("node"), F.col("id"), angle(at(1), at(2)).alias("go"))
    ins = walk.select("code", at(-1).alias("node"), F.col("id").alias("prev"), angle(at(-1), at(-2)).alias("come"))
    # clockwise from the border that arrives, over the zone's corner, to the first border that leaves
    turn = F.pmod(F.col("come") - F.col("go"), F.lit(2 * np.pi))
    turn = F.when(turn <= 1e-12, F.lit(2 * np.pi)).otherwise(turn)
    link = ins.join(outs, ["code", "node"]).groupBy("prev").agg(F.min_by("id", turn).alias("id"))
    place = chain(walk.select("id").join(link, "id", "left"))
    ordered = walk.join(place, "id").groupBy("code", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("s"))
    tail = F.flatten(F.transform("s", lambda v: F.slice(v["points"], 2, F.size(v["points"]))))
    path = ordered.select("code", F.concat(F.array(F.col("s")[0]["points"][0]), tail).alias("points"))
    return path.withColumn("area", _area("points"))


def _area(points: str) -> Column:
    cross = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: (
        F.element_at(points, i)["x"] * F.element_at(points, i + 1)["y"] - F.element_at(points, i + 1)["x"] * F.element_at(points, i)["y"]))
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def ring_wkt(points: str = "points") -> Column:
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))), F.lit("))"))
