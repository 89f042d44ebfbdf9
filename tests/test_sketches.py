import pytest
from pyspark.sql import functions as F

from seasonlens.operators import rollup as RO

RANKS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def ranks(values, got):
    """Share of values below, and at or below, what a sketch gives for a rank."""
    n = len(values)
    return sum(v < got for v in values) / n, sum(v <= got for v in values) / n


@pytest.fixture(scope="module")
def pixels(spark):
    # one zone holds two thirds of the pixels; values with ties, masks and NaN
    i = F.col("id")
    v = F.when(i % 50 == 0, F.lit(None)).when(i % 51 == 0, F.lit(float("nan"))).otherwise(F.floor(F.exp(F.randn(4)) * 50) / 4)
    return spark.range(60000).select(
        F.when(i % 3 > 0, "a").otherwise(F.concat(F.lit("z"), (i % 7).cast("string"))).alias("ward"), (i % 2).alias("county"), v.alias("v")).cache()


def test_rank_error_of_zones_and_of_merged_levels(spark, pixels):
    fine = RO.value_sketch(pixels, ["county", "ward"], "v")
    whole = RO.merge_sketches(fine, ["county"])
    data = [(r.county, r.ward, r.v) for r in pixels.filter("v is not null and not isnan(v)").collect()]
    for df, pick in ((fine, lambda r: [v for c, w, v in data if (c, w) == (r.county, r.ward)]), (whole, lambda r: [v for c, _, v in data if c == r.county])):
        for r in RO.sketch_quantiles(df, RANKS).collect():
            values = pick(r)
            assert r.n == len(values)
            for name, q in RANKS.items():
                lo, hi = ranks(values, r[name])
                assert lo - 0.01 <= q <= hi + 0.01


def test_small_zones_are_exact_and_sketches_stay_small(spark, pixels):
    few = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", 7.0), ("c", None)], "ward string, v double")
    got = {r.ward: r for r in RO.sketch_quantiles(RO.value_sketch(few, ["ward"], "v"), {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {"a", "b"} and (got["a"].lo, got["a"].mid, got["a"].hi) == (0, 50, 100) and got["b"].mid == 7
    size = RO.value_sketch(pixels, ["ward"], "v").agg(F.max(F.length("sketch"))).first()[0]
    assert size < 16_000
    assert RO.merge_sketches(RO.value_sketch(few.limit(0), ["ward"], "v"), ["ward"]).count() == 0
