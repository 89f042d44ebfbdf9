"""Grid tables stored along a space-filling curve, and box reads that open a small part of them.

Cells get a Morton key (the bits of row and column interleaved), so cells near each other on the ground lie near each
other in the files.  A box is a few key ranges: they reach the scan as folder predicates (``tile``, the leading
bits) and as row-group predicates (``z``).
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seasonlens.functions.masks import as_col
from seasonlens.operators.spatial import GridSpec

KEY_BITS = 31  # a grid line index is below 2^31, a key below 2^62


def morton(row, col) -> Column:
    """Key of a cell: column bits at the even places, row bits at the odd ones.  NULL for a NULL index, an error for
    one outside 0 .. 2^31 - 1."""
    def spread(v) -> Column:
        v = as_col(v).cast("long")
        # binary digits read as digits to base 4 stand two places apart
        wide = F.conv(F.bin(v), 4, 10).cast("long")
        return F.when(v.isNull(), F.lit(None)).when(v.between(0, 2**KEY_BITS - 1), wide).otherwise(
            F.raise_error(F.lit("grid index outside 0 .. 2^31 - 1")).cast("long"))

    return spread(col) + spread(row) * 2


def box_ranges(rows: tuple[int, int], cols: tuple[int, int], limit: int = 16) -> list[tuple[int, int]]:
    """At most ``limit`` key ranges (both ends included) that cover the cells of a box, ends included.

    Quadrants that stick out of the box are split, the largest first, while the ranges stay within the limit; what
    still sticks out is read too and dropped by the exact predicate.
    """
    (r0, r1), (c0, c1) = ((max(a, 0), min(b, 2**KEY_BITS - 1)) for a, b in (rows, cols))
    if r0 > r1 or c0 > c1:
        return []
    # the smallest quadrant that holds the box
    bits = max((r0 ^ r1).bit_length(), (c0 ^ c1).bit_length())
    whole, ragged = [], []

    def add(r: int, c: int, b: int) -> None:
        side = 1 << b
        if r > r1 or c > c1 or r + side <= r0 or c + side <= c0:
            return
        lo = _key(r, c)
        inside = r0 <= r and r + side - 1 <= r1 and c0 <= c and c + side - 1 <= c1
        if inside:
            whole.append((lo, lo + (1 << 2 * b) - 1))
        else:
            heapq.heappush(ragged, (-b, lo, r, c))

    def merged() -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(whole + [(lo, lo + (1 << -2 * b) - 1) for b, lo, _, _ in ragged]):
            if out and lo == out[-1][1] + 1:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    add(r0 >> bits << bits, c0 >> bits << bits, bits)
    best = merged()
    while ragged:
        b, _, r, c = heapq.heappop(ragged)
        half = 1 << (-b - 1)
        for dr in (0, half):
            for dc in (0, half):
                add(r + dr, c + dc, -b - 1)
        now = merged()
        if len(now) <= limit:
            best = now
        elif len(whole) + len(ragged) > 4 * limit:
            break
    return best


def _key(row: int, col: int) -> int:
    return int(f"{col:b}", 4) + 2 * int(f"{row:b}", 4)


def in_ranges(key: str, ranges: Sequence[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | F.col(key).between(lo, hi)
    return cond


def write_curve(rows: DataFrame, path: str, tile_bits: int = 12, partition_by: Sequence[str] = (), then: Sequence[str] = (),
                row_group_bytes: int = 32 << 20) -> None:
    """Store rows with ``row`` and ``col`` in the order of their keys, with the columns ``z`` and ``tile`` added.

    A folder holds one tile of 2^tile_bits x 2^tile_bits cells (within ``partition_by``).  Files are key ranges of
    about equal row counts: they follow the data, up to ``spark.sql.shuffle.partitions`` of them.  ``then`` continues the
    order inside a cell, so that a cell with very many rows (its dekads) can be split over several files.
    """
    z = morton("row", "col")
    keyed = rows.withColumns({"z": z, "tile": F.shiftright(z, 2 * tile_bits)})
    order = [*partition_by, "tile", "z", *then]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "parquet.block.size", row_group_bytes).partitionBy(*partition_by, "tile").parquet(path)


def box_cells(spec: GridSpec, lon: tuple[float, float], lat: tuple[float, float]) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last row and column whose cell centres can lie in the box."""
    r = (math.floor((spec.lat0 - lat[1]) / spec.res - 0.5), math.ceil((spec.lat0 - lat[0]) / spec.res - 0.5))
    c = (math.floor((lon[0] - spec.lon0) / spec.res - 0.5), math.ceil((lon[1] - spec.lon0) / spec.res - 0.5))
    return r, c


def read_box(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], tile_bits: int = 12,
             limit: int = 16) -> DataFrame:
    """The rows of a table of ``write_curve`` (same ``tile_bits``) whose cell lies in the box, ends included."""
    ranges = box_ranges(rows, cols, limit)
    tiles = [(lo >> 2 * tile_bits, hi >> 2 * tile_bits) for lo, hi in ranges]
    return spark.read.parquet(path).filter(
        in_ranges("tile", tiles) & in_ranges("z", ranges) & F.col("row").between(*rows) & F.col("col").between(*cols)
    ).drop("z", "tile")
