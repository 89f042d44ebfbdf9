"""Connected components of a link table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seasonlens.llm.store import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): every linked node other than the roots, with the smallest node it reaches.

    Each step joins the links with one minimum per node and is written to the shared folder, which cuts the
    lineage; a node with very many links is one row on one side of that join.
    """
    e = stored(_ordered(links), "links")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(_ordered(small), "links")


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
