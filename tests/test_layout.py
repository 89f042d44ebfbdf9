import random

import pytest
from pyspark.sql import functions as F

from seasonlens.operators import spatial as SP
from seasonlens.sources import layout as LA
from seasonlens.sources.tables import new_path


def key(row, col):
    return sum((row >> i & 1) << 2 * i + 1 | (col >> i & 1) << 2 * i for i in range(31))


def test_key_interleaves_bits(spark):
    rng = random.Random(3)
    cells = [(0, 0), (2**31 - 1, 2**31 - 1), (None, 4), *[(rng.randrange(2**31), rng.randrange(2**31)) for _ in range(50)]]
    got = spark.createDataFrame(cells, "row long, col long").select("row", "col", LA.morton("row", "col").alias("z")).collect()
    assert all(r.z == (None if r.row is None else key(r.row, r.col)) for r in got)


def test_negative_index_is_an_error(spark):
    with pytest.raises(Exception, match="grid index"):
        spark.createDataFrame([(-1, 0)], "row int, col int").select(LA.morton("row", "col")).collect()


def test_ranges_cover_the_box_within_the_limit():
    rng = random.Random(4)
    for _ in range(200):
        r0, c0 = rng.randrange(60), rng.randrange(60)
        r1, c1 = r0 + rng.randrange(20), c0 + rng.randrange(20)
        ranges = LA.box_ranges((r0, r1), (c0, c1), 8)
        assert len(ranges) <= 8 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(any(lo <= key(r, c) <= hi for lo, hi in ranges) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1))
        held = {k for lo, hi in ranges for k in range(lo, hi + 1)}
        every = LA.box_ranges((r0, r1), (c0, c1), 10**6)
        exact = {k for lo, hi in every for k in range(lo, hi + 1)}
        assert exact == {key(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} and exact <= held
    assert LA.box_ranges((5, 4), (0, 9)) == [] and LA.box_ranges((-9, -1), (0, 9)) == []


def scanned(df):
    """Rows and files that the scan of a plan has given out."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.executeCollect()
    leaf = plan.collectLeaves().head()
    metric = lambda name: leaf.metrics().apply(name).value()
    return len(rows), metric("numOutputRows"), metric("numFiles")


def test_a_box_reads_few_files_and_rows(spark):
    n = 256
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.rand(1).alias("v"))
    path = new_path(spark, "curve")
    LA.write_curve(grid, path, tile_bits=6)
    box = LA.read_box(spark, path, (70, 75), (130, 140), tile_bits=6)
    got, rows, files = scanned(box)
    whole = len(spark.read.parquet(path).inputFiles())
    assert got == 6 * 11 and files <= whole / 8 and rows <= n * n / 8
    assert {(r.row, r.col) for r in box.collect()} == {(r, c) for r in range(70, 76) for c in range(130, 141)}


def test_a_crowded_cell_is_split(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 64).cast("int").alias("row"), F.lit(9).alias("col"), "id")
    path = new_path(spark, "curve")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        LA.write_curve(rows, path, tile_bits=12, then=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 4 and max(r["count"] for r in per_file) < 1500
    assert LA.read_box(spark, path, (7, 7), (9, 9)).count() == rows.filter("row = 7").count()


def test_degrees_become_cells():
    spec = SP.GridSpec(33.0, 5.5, 0.125)
    r, c = LA.box_cells(spec, (34, 38), (3, 5))
    for i in range(64):
        if 34 <= spec.lon0 + (i + 0.5) * spec.res <= 38:
            assert c[0] <= i <= c[1]
        if 3 <= spec.lat0 - (i + 0.5) * spec.res <= 5:
            assert r[0] <= i <= r[1]
