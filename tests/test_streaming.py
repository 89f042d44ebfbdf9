import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from seasonlens.config import MAIZE
from seasonlens.operators import balance as B
from seasonlens.streaming import monitor as M, running as R

OBS = "px_id long, ts timestamp, rain_mm double"


def put(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(day, hour=6):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_replace_forecast(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    fc = spark.createDataFrame([(1, dt.date(2024, 1, d), 1.0) for d in range(1, 11)], "px_id long, d date, rain_mm double")
    schema = spark.createDataFrame([], OBS).schema

    def run():
        R.start_daily_sink(R.daily_totals(R.file_stream(spark, src, schema)), out, ck).awaitTermination()
        return R.running_dekads(R.latest_daily(spark, out), fc).first()

    put(spark, src, [(1, at(1), 10.0), (1, at(2), 5.0)], OBS, 0)
    a = run()
    assert (a.obs_mm, a.obs_days, a.fc_mm, a.p, a.closed) == (15.0, 2, 8.0, 23.0, 0)
    put(spark, src, [(1, at(2, 9), 2.5), (1, at(4), 7.0)], OBS, 1)       # a late row of day 2, and day 4
    b = run()
    assert (b.obs_mm, b.obs_days, b.p) == (24.5, 3, 31.5)
    put(spark, src, [(1, at(d), 1.0) for d in (3, 5, 6, 7, 8, 9, 10)], OBS, 2)
    c = run()
    assert (c.obs_mm, c.obs_days, c.fc_mm, c.closed) == (31.5, 10, 0.0, 1)


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = spark.createDataFrame([], OBS).schema
    run = lambda: R.start_daily_sink(R.daily_totals(R.file_stream(spark, src, schema)), out, ck).awaitTermination()
    put(spark, src, [(1, at(1), 10.0), (1, at(20), 1.0)], OBS, 0)
    run()
    put(spark, src, [(1, at(20, 8), 1.0), (1, at(1, 9), 99.0)], OBS, 1)
    run()
    got = {str(r.d): r.rain_mm for r in R.latest_daily(spark, out).collect()}
    assert got == {"2024-01-01": 10.0, "2024-01-20": 2.0}


DEK = "px_id long, year int, gd int, p double, et0 double, planting int"


def test_monitor_over_batches_equals_batch(spark, tmp_path):
    rows = [(px, 2000, gd, float((gd * (px + 3)) % 7 * 8), 45.0, 8 + px) for px in range(3) for gd in range(6, 29)]
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = spark.createDataFrame([], DEK).schema

    def run():
        s = R.file_stream(spark, src, schema)
        q = M.monitor(s, MAIZE, (6, 28)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()

    for lo, hi in ((6, 12), (13, 20), (21, 28)):
        put(spark, src, [r for r in rows if lo <= r[2] <= hi] + [(0, 2000, 9, 50.0, 45.0, 8)] * (lo == 21), DEK, lo)
        run()                                                            # the repeated dekad 9 is too late
    assert spark.read.parquet(out).filter("late = 1").count() == 1
    res = spark.read.parquet(out)
    final = {r.px_id: r.w for r in res.filter("late = 0").groupBy("px_id").agg(F.max_by("wrsi", "gd").alias("w")).collect()}
    df = spark.createDataFrame(rows, DEK)
    cl = df.select("px_id", "year", F.col("gd").alias("dekad"), "p", "et0")
    batch = B.water_balance(cl, df.select("px_id", "year", "planting").distinct(), MAIZE, 7, 15)
    assert final == pytest.approx({r.px_id: r.wrsi for r in batch.collect()})
    flips = res.filter("late = 0").orderBy("px_id", "gd").collect()
    assert all((r.alert == 1) == (r.wrsi_class != r.previous_class) for r in flips)


def test_monitor_masks_after_a_gap_takes_soils_and_forgets_seasons(spark, tmp_path):
    soils = {0: 60.0, 1: 140.0, 2: 100.0}
    rows = [(px, 2000, gd, float((gd * (px + 3)) % 7 * 8), 45.0, 8, soils[px]) for px in soils for gd in range(6, 29)
            if not (px == 2 and gd == 15)]
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = spark.createDataFrame([], DEK + ", whc_mm double").schema

    def run(part, n):
        put(spark, src, part, DEK + ", whc_mm double", n)
        q = M.monitor(R.file_stream(spark, src, schema), MAIZE, (6, 28)).writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert run([r for r in rows if r[2] <= 20], 0) == 3
    assert run([r for r in rows if r[2] > 20], 1) == 0                   # all seasons have ended
    res = spark.read.parquet(out)
    last = {r.px_id: r.w for r in res.groupBy("px_id").agg(F.max_by("wrsi", "gd").alias("w")).collect()}
    df = spark.createDataFrame(rows, DEK + ", whc_mm double")
    whc = spark.createDataFrame(list(soils.items()), "px_id long, whc_mm double")
    batch = {r.px_id: r.wrsi for r in B.water_balance(df.select("px_id", "year", F.col("gd").alias("dekad"), "p", "et0"),
                                                      df.select("px_id", "year", "planting").distinct(), MAIZE, 7, 15, whc).collect()}
    assert last[0] == pytest.approx(batch[0]) and last[1] == pytest.approx(batch[1]) and last[0] != last[1]
    assert batch[2] is None and res.filter("px_id = 2 AND gd >= 16 AND wrsi IS NOT NULL").count() == 0
    assert [r.gd for r in res.filter("gap = 1").collect()] == [16]


def test_dekads_in_any_order_equal_the_ordered_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(px, 2000, gd, float((gd * (px + 3)) % 7 * 8), 45.0, 8 + px) for px in range(4) for gd in range(6, 29) if (px, gd) != (3, 20)]
    wrong = [(px, 2000, 12, 99.0, 45.0, 8 + px) for px in (0, 2)]          # corrected by a later batch
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = spark.createDataFrame([], DEK).schema

    def run():
        q = M.monitor_any_order(R.file_stream(spark, src, schema), MAIZE, (6, 28), "400 days").writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    early = [r for r in rows if r[0] in (0, 2) and r[2] < 15]
    mixed = rng.sample([r for r in rows if r not in early], len(rows) - len(early))
    put(spark, src, [r for r in early if r[2] != 12] + wrong + mixed[:20], DEK, 0)
    run()
    put(spark, src, mixed[20:40], DEK, 1)
    run()
    put(spark, src, mixed[40:] + [r for r in early if r[2] == 12], DEK, 2)
    assert run() > 0
    got = M.newest(spark.read.parquet(out))
    final = {r.px_id: (r.gd, r.wrsi) for r in got.groupBy("px_id").agg(F.max("gd").alias("gd"), F.max_by("wrsi", "gd").alias("wrsi")).collect()}
    df = spark.createDataFrame(rows, DEK)
    batch = {r.px_id: r.wrsi for r in B.water_balance(df.select("px_id", "year", F.col("gd").alias("dekad"), "p", "et0"),
                                                      df.select("px_id", "year", "planting").distinct(), MAIZE, 7, 15).collect()}
    assert {k: v for k, v in final.items() if k < 3} == {k: (28, pytest.approx(batch[k])) for k in range(3)} and batch[3] is None
    assert final[3][0] == 19 and max(r.version for r in got.collect()) > 1
    put(spark, src, [(9, 2003, 6, 1.0, 45.0, 8)], DEK, 3)                  # the watermark passes the season's end
    run()
    put(spark, src, [(9, 2003, 7, 1.0, 45.0, 8)], DEK, 4)
    assert run() == 2, "only the new season's dekads are held"
    ended = M.newest(spark.read.parquet(out)).filter("px_id = 3 AND gd > 19").orderBy("gd").collect()
    assert [(r.gd, r.wrsi, r.gap) for r in ended] == [(g, None, int(g == 21)) for g in range(21, 29)]


def test_the_state_of_many_pixels_is_a_row_per_block_and_dekad(spark, tmp_path):
    pixels = [*range(-3, 0), *range(40), 10_000_000_000]                    # three blocks of ids
    rows = [(px, 2000, gd, None if px == 7 and gd == 12 else float((gd * (px + 5)) % 7 * 8), 45.0, 8) for px in pixels for gd in range(6, 17)]
    src, out = (str(tmp_path / n) for n in ("src", "out"))
    schema = spark.createDataFrame([], DEK).schema

    def run(make, src, out):
        q = make(R.file_stream(spark, src, schema)).writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", out + "-ck").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    replay = lambda s: M.monitor_any_order(s, MAIZE, (6, 28), "400 days")
    late = [r for r in rows if r[2] == 9 and r[0] % 3 == 0]
    put(spark, src, [r for r in rows if r not in late][::-1] + [(5, 2000, 16, 77.0, 45.0, 8), rows[3 * 11 + 5 * 11 + 10]], DEK, 0)
    assert run(replay, src, out) == 3 * 11                                   # a row for each dekad of 44 pixels would be 484
    put(spark, src, late, DEK, 1)
    assert run(replay, src, out) == 3 * 11
    put(spark, src + "-all", rows, DEK, 0)
    run(lambda s: M.monitor(s, MAIZE, (6, 28)), src + "-all", out + "-all")
    cols = ("px_id", "year", "gd", "sw", "wrsi", "wrsi_class", "previous_class")
    read = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert read(M.newest(spark.read.parquet(out))) == read(spark.read.parquet(out + "-all"))


def test_compaction_keeps_one_version_at_every_point(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = spark.createDataFrame([], OBS).schema

    def run(rows, n):
        put(spark, src, rows, OBS, n)
        R.start_daily_sink(R.daily_totals(R.file_stream(spark, src, schema)), out, ck).awaitTermination()

    seen = lambda **kw: sorted((r.px_id, r.d.day, r.rain_mm) for r in R.latest_daily(spark, out, **kw).collect())
    files = lambda top: len([f for f in pathlib.Path(top).rglob("*.parquet")])
    for n in range(4):
        run([(px, at(d), 1.0) for px in (1, 2) for d in range(1, 12)], n)
    want = [(px, d, 4.0) for px in (1, 2) for d in range(1, 12)]
    assert seen() == want and files(f"{out}/year=2024/dekad=1") >= 4
    R.compact_dekad(spark, out, 2024, 1)
    R.compact_dekad(spark, out, 2024, 1)
    assert seen() == want and files(f"{out}-closed") == 1
    assert R.drop_compacted(spark, out, 2024, 1) >= 4
    assert seen() == want and not files(f"{out}/year=2024/dekad=1") and seen(dekads=((2024, 2), (2024, 2))) == want[10:11] + want[21:]
    run([(1, at(3, 9), 2.0)], 4)                                          # a late row after it
    assert (1, 3, 6.0) in seen() and len(seen()) == len(want)
    assert R.drop_compacted(spark, out, 2024, 1) == 0, "a newer batch stays"
    R.compact_dekad(spark, out, 2024, 1)
    assert R.drop_compacted(spark, out, 2024, 1) == 2 and (1, 3, 6.0) in seen() and files(f"{out}-closed") == 1
