"""Steps that make many rows of few: how the planner sees them, and over how many tasks they run."""
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from seasonlens.operators import frames as FR

SF = "/root/testdata/sf0.001"


@contextmanager
def static_plan(spark, threshold: int):
    """Plans as they are made from estimates alone, with this broadcast threshold."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(threshold))
    try:
        yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_salted_copies_are_not_taken_for_one_small_table(spark):
    rows = spark.range(20_000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("x"))
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    with static_plan(spark, 100_000) as plan:  # the table is below it, its 16 copies are not
        assert "BroadcastHashJoin" in plan(rows.join(table, ["k"], "left"))
        assert "BroadcastHashJoin" not in plan(FR.salted_join(rows, table, ["k"], "left"))
        out = FR.salted_join(rows, table, ["k"], "left")
        assert out.columns == ["k", "x", "v"] and out.count() == 20_000 and out.filter("v = 2 * k").count() == 20_000


@pytest.mark.parametrize("query", ["fuse5_unbiased_prediction", "fuse8_calibrated_fill"])
def test_cells_by_dekad_are_not_broadcast(spark, query):
    from crosscheck import load
    with static_plan(spark, 30_000) as plan:
        joins = [l for l in plan(load()[0][query](spark, SF)).splitlines() if "BroadcastHashJoin" in l and "px_id" in l and "Inner" in l]
    assert not joins


def test_slope_and_residual_of_a_tile_need_one_shuffle(spark):
    """Cells by dekad, about 36 rows a cell, are made behind the last exchange and not shuffled once for each pass and join."""
    from crosscheck import load
    with static_plan(spark, 30_000) as plan:
        lines = plan(load()[0]["fuse5_unbiased_prediction"](spark, SF)).splitlines()
    dealt = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
    assert "REPARTITION_BY_NUM" in lines[dealt[0]] and len(dealt) == 3  # the others are of the skeleton's blocks
    for step in ("Window", "HashAggregate(keys=[_tr", "Generate explode"):
        assert any(step in l for l in lines[:dealt[0]])
    assert not any("Window" in l for l in lines[dealt[0]:])


SPINES = ["clim1_regional_means", "cpi1_water_stress", "wb3_staged_balance", "et2_reference_et", "gdd2_photothermal_clock", "aez1_growing_period",
          "aez2_maturity_class", "gdd1_dekad_degree_days", "gdd3_maturity_target", "plan_rain_led_county", "wb2_wrsi_classes", "rain5_climatology",
          "asap4_hazard_products", "wb3_staged_short_rains", "rain1_dekad_sum", "rain3_replaced_dekad", "stat6_temporal_zscore", "time7_global_dekad"]


@pytest.mark.parametrize("query", SPINES)
def test_every_spine_of_a_query_grows_from_dealt_rows(spark, query):
    """No join to a fixed list of numbers stands on a file's rows as they are read."""
    from crosscheck import load
    with static_plan(spark, 30_000) as plan:
        lines = plan(load()[0][query](spark, SF)).splitlines()
    below = [next(l for l in lines[i + 1:] if "Project" not in l and "Filter" not in l)
             for i, line in enumerate(lines) if "BroadcastNestedLoopJoin BuildRight, Cross" in line]
    assert any("REPARTITION_BY_NUM" in l for l in below)
    assert not [l for l in below if "Scan" in l or "ColumnarToRow" in l]


def test_spines_leave_the_task_of_their_file(spark):
    px = spark.range(500).coalesce(1).select(F.col("id").alias("px_id"))
    for spine, n in ((FR.day_spine(px, "1995-01-30", "1995-03-02"), 32), (FR.dekad_spine(px, range(1995, 1997)), 72)):
        assert spine.count() == 500 * n and spine.distinct().count() == 500 * n
        assert spine.select(F.spark_partition_id().alias("t")).distinct().count() > 1
    days = FR.day_spine(px, "1995-01-30", "1995-03-02").agg(F.min("d"), F.max("d")).first()
    assert [str(d) for d in days] == ["1995-01-30", "1995-03-02"]
