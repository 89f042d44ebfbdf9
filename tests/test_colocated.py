import uuid

import pytest
from pyspark.sql import functions as F

from seasonlens.config import MAIZE
from seasonlens.operators import balance as B, onset as O
from seasonlens.sources.tables import new_path, store_bucketed


@pytest.fixture(scope="module")
def stored(spark):
    i = F.col("id")
    climate = spark.range(40 * 2 * 36).select(
        (i % 40).alias("px_id"), (1999 + F.floor(i / 40) % 2).cast("int").alias("year"), (1 + F.floor(i / 80)).cast("int").alias("dekad"),
        ((i * 37) % 60).cast("double").alias("p"), (20 + i % 30).cast("double").alias("et0"))
    whc = spark.range(40).select(F.col("id").alias("px_id"), (60 + F.col("id") % 50).cast("double").alias("whc_mm"))
    names = [f"t_{uuid.uuid4().hex[:8]}" for _ in range(2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else a small table hides the exchange it needs
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    yield (climate, whc), [store_bucketed(d, n, new_path(spark, n), 4, order=o) for d, n, o in zip((climate, whc), names, (["year", "dekad"], []))]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def season_balance(climate, whc):
    onset = O.rain_onset(climate, 7, 15, "et0")
    return B.water_balance(climate, onset.withColumn("planting", F.col("onset")), MAIZE, 7, 15, whc=whc)


def test_onset_and_balance_need_no_exchange(stored):
    plain, kept = stored
    onset = lambda c: O.rain_onset(c, 7, 15, "et0")
    assert exchanges(onset(kept[0])) == 0 < exchanges(onset(plain[0]))
    assert exchanges(season_balance(*kept)) == 0 < exchanges(season_balance(*plain))


def test_results_are_the_same(stored):
    plain, kept = stored
    rows = [sorted(map(repr, season_balance(*t).collect())) for t in (plain, kept)]
    assert rows[0] == rows[1] and len(rows[0]) > 0
