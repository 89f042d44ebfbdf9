"""Grid neighbourhoods, regridding, mosaics and polygon overlay on a regular grid."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seasonlens.functions.masks import as_col
from seasonlens.operators.frames import PX, salted_join, spread

TILE = ("_tr", "_tc")


@dataclass(frozen=True)
class GridSpec:
    """Upper-left corner and pixel size; row grows southwards, pixel centres at +0.5."""

    lon0: float
    lat0: float
    res: float

    def lon(self, col) -> Column:
        return self.lon0 + (as_col(col) + 0.5) * self.res

    def lat(self, row) -> Column:
        return self.lat0 - (as_col(row) + 0.5) * self.res


# ---- neighbourhoods ---------------------------------------------------------------------------
def grid_skeleton(cells: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """The (row, col) places at which a window of ``radius`` can meet a cell: the blocks that hold cells, and
    the blocks above and below them.

    A block is one row until it expands, and blocks without cells in reach do not exist, so the work
    follows the cells and not their bounding box.
    """
    b = max(radius, 8)
    at = lambda c: F.floor(F.col(c) / b).cast("int")
    held = cells.select(*keys, at("row").alias("_r"), at("col").alias("_c")).distinct()
    near = held.select(*keys, F.explode(F.sequence(F.col("_r") - 1, F.col("_r") + 1)).alias("_r"), "_c").distinct()
    lines = near.select(*keys, F.explode(F.sequence(F.col("_r") * b, F.col("_r") * b + b - 1)).alias("row"), "_c")
    return lines.select(*keys, "row", F.explode(F.sequence(F.col("_c") * b, F.col("_c") * b + b - 1)).alias("col"))


def focal_mean(
    cells: DataFrame, bands: Sequence[str], radius: int, keys: Sequence[str] = (), dense: bool = False,
    suffix: str = "_fm",
) -> DataFrame:
    """Masked square-window mean of several bands, as two range-window passes (rows, then columns).

    A window partition is one grid line of one key, so it is bounded by the canvas size.  Where
    cells may be absent, an empty skeleton around them is unioned in (no join): line sums are taken on
    the skeleton and results read at the cells.  Set ``dense`` when the bounding box is full.
    """
    if dense:
        rows, frame = cells, F.lit(True)
    else:
        blank = grid_skeleton(cells, radius, keys).withColumn("_blank", F.lit(True))
        rows = cells.withColumn("_blank", F.lit(False)).unionByName(blank, allowMissingColumns=True)
        frame = F.col("_blank")
    along = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    h = rows.withColumns(
        {f"_s_{b}": F.sum(b).over(along) for b in bands} | {f"_n_{b}": F.count(b).over(along) for b in bands})
    line = lambda c: F.sum(F.when(frame, F.col(c))).over(down)
    v = h.withColumns({f"_S_{b}": line(f"_s_{b}") for b in bands} | {f"_N_{b}": line(f"_n_{b}") for b in bands})
    out = v if dense else v.filter(~F.col("_blank"))
    return out.select(*cells.columns, *[F.try_divide(F.col(f"_S_{b}"), F.col(f"_N_{b}")).alias(f"{b}{suffix}") for b in bands])


def in_tiles(rows: DataFrame, reach: int, size: int = 128) -> DataFrame:
    """Rows with a place (row, col), each in its own square tile and copied to the tiles that come within ``reach`` of it, one task a
    tile: windows by ``TILE`` that reach no further in all find every cell there and need no other shuffle.

    Adds ``TILE`` and ``_own``, true in the tile that a place belongs to.  Tiles begin ``reach`` before 0, so that a grid from 0 on has
    no copies outside its first line and column of tiles.  Rows without a place are dropped.
    """
    at = lambda c, off: F.floor((F.col(c) + off) / size).cast("int")
    near = lambda c: F.explode(F.sequence(at(c, 0), at(c, 2 * reach)))
    copies = spread(rows.withColumn("_tr", near("row")).withColumn("_tc", near("col")), TILE, times=4)
    return copies.withColumn("_own", (F.col("_tr") == at("row", reach)) & (F.col("_tc") == at("col", reach)))


def circle_offsets(radius_m: float, pixel_m: float) -> list[tuple[int, int]]:
    k = math.floor(radius_m / pixel_m)
    return [(dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1)
            if math.hypot(dy, dx) * pixel_m <= radius_m]


def focal_mean_circle(
    cells: DataFrame, bands: Sequence[str], radius_m: float, pixel_m: float, keys: Sequence[str] = (),
    suffix: str = "_fm",
) -> DataFrame:
    """Masked mean over a disc: each cell is spread to its neighbours' keys, averaged there, and
    joined back to the cells that exist.  For small discs (speckle filtering)."""
    off = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in circle_offsets(radius_m, pixel_m)])
    spread = cells.select(*keys, "row", "col", *bands, F.explode(off).alias("o")).select(
        *keys, (F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"), *bands)
    means = spread.groupBy(*keys, "row", "col").agg(*[F.avg(b).alias(f"{b}{suffix}") for b in bands])
    return cells.join(means, [*keys, "row", "col"])


# ---- regridding -------------------------------------------------------------------------------
def nearest_coarse(fine: DataFrame, coarse: DataFrame, factor: int, bands: Sequence[str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Give fine cells the value of the coarse cell they lie in (integer cell arithmetic)."""
    at = fine.withColumns({
        "_r": F.floor(F.col("row") / factor).cast("int"), "_c": F.floor(F.col("col") / factor).cast("int")})
    src = coarse.select(*keys, F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"), *bands)
    return at.join(src, [*keys, "_r", "_c"], "left").drop("_r", "_c")


def bilinear(points: DataFrame, coarse: DataFrame, spec: GridSpec, band: str, out: str,
             key: Sequence[str] = PX) -> DataFrame:
    """Bilinear value of a coarse grid at points (lon, lat); masked neighbours drop out and the
    remaining weights are rescaled."""
    y = (spec.lat0 - F.col("lat")) / spec.res - 0.5
    x = (F.col("lon") - spec.lon0) / spec.res - 0.5
    p = points.select(*key, y.alias("_y"), x.alias("_x")).withColumns(
        {"_r": F.floor("_y").cast("int"), "_c": F.floor("_x").cast("int")}
    ).withColumns({"_fy": F.col("_y") - F.col("_r"), "_fx": F.col("_x") - F.col("_c")})
    corners = F.array(*[
        F.struct((F.col("_r") + dy).alias("row"), (F.col("_c") + dx).alias("col"),
                 ((F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))).alias("w"))
        for dy in (0, 1) for dx in (0, 1)])
    near = p.select(*key, F.explode(corners).alias("k")).select(*key, "k.row", "k.col", "k.w")
    v = near.join(coarse.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), band), ["row", "col"], "left")
    ok = F.col(band).isNotNull()
    return v.groupBy(*key).agg(F.try_divide(
        F.sum(F.when(ok, F.col("w") * F.col(band))), F.sum(F.when(ok, F.col("w")))).alias(out))


def canvas_pixels(cells: DataFrame, height, width, out_height, out_width) -> DataFrame:
    """Nearest down-sampling: keep the source cell under each canvas cell's centre (sizes are
    numbers or columns; the canvas is no larger than the source).

    Whether a source line is sampled, and by which canvas line, follows from its index alone, so
    this is a filter and needs no join.
    """
    def sampled(src: str, n, m) -> Column:
        i = F.ceil(F.col(src) * m / n - 0.5)
        return F.when((i >= 0) & (i < m) & (F.floor((i + 0.5) * n / m) == F.col(src)), i.cast("int"))

    return cells.withColumns({
        "out_row": sampled("row", height, out_height), "out_col": sampled("col", width, out_width),
    }).filter(F.col("out_row").isNotNull() & F.col("out_col").isNotNull())


# ---- mosaics ----------------------------------------------------------------------------------
def mosaic(tiles: DataFrame, bands: Sequence[str], rule: str = "positive", order: str = "tile_seq",
           keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Overlay tiles in name order, band by band; a later valid value wins.

    Valid means > 0 (``positive``) or != 0 (``nonzero``).  ``max_by`` combines map-side, so a
    heavily overlapped cell is never gathered.
    """
    def valid(b: str) -> Column:
        return F.col(b) > 0 if rule == "positive" else F.col(b) != 0

    return tiles.groupBy(*keys).agg(*[
        F.coalesce(F.max_by(F.when(valid(b), F.col(b)), F.when(valid(b), F.col(order))), F.lit(0)).alias(b)
        for b in bands])


# ---- polygons ---------------------------------------------------------------------------------
def rasterize(edges: DataFrame, spec: GridSpec) -> DataFrame:
    """Scan-convert polygons: (seq, row, col) for every grid cell whose centre lies inside.

    edges: seq, x1, y1, x2, y2 (all rings of a polygon; even-odd rule, so holes work).  Each edge
    lists the grid lines it crosses; sorted crossings of a line pair up into column intervals.  The
    work is the edge crossings plus the covered cells - no polygon-to-pixel comparison is made.
    """
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    # centre of line r is lat0 - (r + .5) res; an edge owns low <= centre < top
    r_first = F.floor((spec.lat0 - top) / spec.res - 0.5).cast("int") + 1
    r_last = F.floor((spec.lat0 - low) / spec.res - 0.5).cast("int")
    lines = edges.filter(F.col("y1") != F.col("y2")).select(
        "seq", "x1", "y1", "x2", "y2", r_first.alias("_r0"), r_last.alias("_r1")
    ).filter(F.col("_r0") <= F.col("_r1")).select(
        "*", F.explode(F.sequence("_r0", "_r1")).alias("row"))
    y = spec.lat("row")
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    xs = lines.select("seq", "row", x.alias("x")).groupBy("seq", "row").agg(
        F.array_sort(F.collect_list("x")).alias("xs"))
    pair = F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).alias("k")
    col_of = lambda v: F.ceil((v - spec.lon0) / spec.res - 0.5).cast("int")
    spans = xs.filter(F.size("xs") >= 2).select("seq", "row", "xs", pair).select(
        "seq", "row", col_of(F.col("xs")[F.col("k") * 2]).alias("c0"),
        (col_of(F.col("xs")[F.col("k") * 2 + 1]) - 1).alias("c1"))
    return spans.filter(F.col("c0") <= F.col("c1")).select(
        "seq", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def zone_of_pixels(pixels: DataFrame, edges: DataFrame, spec: GridSpec) -> DataFrame:
    """Zone per pixel, the later polygon overriding; pixels outside all zones get NULL.

    Static: compute once and store (see ``sources.tables.materialize``).
    """
    owner = rasterize(edges, spec).groupBy("row", "col").agg(F.max("seq").alias("seq"))
    return pixels.join(owner, ["row", "col"], "left")


def dissolve(pixel_zone: DataFrame, zone_attr: DataFrame, on: str, attr: str, salts: int = 16) -> DataFrame:
    """Merge zones that share an attribute: replace the zone id by the attribute value.  A zone's pixels
    are spread over ``salts`` tasks, and its one row goes to each."""
    return salted_join(pixel_zone, zone_attr.select(on, attr), [on], salts=salts)


def clip_box(rows: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    return rows.filter(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def clip_zone(pixels: DataFrame, zone_pixels: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    return pixels.join(zone_pixels.select(*keys), list(keys), "left_semi")


def crop_area_fraction(pixels: DataFrame, keys: Sequence[str], band: str = "planting",
                       lo: int = 1, hi: int = 36) -> DataFrame:
    """Valid crop pixels over all pixels of a zone."""
    n = F.count(F.when(F.col(band).between(lo, hi), 1))
    return pixels.groupBy(*keys).agg(F.bround(n / F.count(F.lit(1)), 4).alias("crop_area_frac"))
