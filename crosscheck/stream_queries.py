"""Streaming jobs run to completion over the supplied tables, compared with batch SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.balance_sql import stepwise_sql
from crosscheck.registry import query
from crosscheck.util import rounded
from crosscheck.views import dk
from seasonlens.config import MAIZE
from seasonlens.operators.frames import season_frame
from seasonlens.sources.tables import new_path
from seasonlens.streaming import monitor as M, running as R


@query("str1_running_dekad_stream", f"""
    SELECT px_id, year, dekad, round(obs_mm, 6) AS obs_mm, obs_days, round(fc_mm, 6) AS fc_mm, round(obs_mm + fc_mm, 6) AS p, CASE WHEN obs_days = CASE WHEN dekad % 3 = 0 THEN 11 ELSE 10 END THEN 1 ELSE 0 END AS closed FROM (
      SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, coalesce(sum(o), 0) AS obs_mm, count(o) AS obs_days, coalesce(sum(CASE WHEN o IS NULL THEN f END), 0) AS fc_mm FROM (
        SELECT coalesce(a.px_id, b.px_id) AS px_id, coalesce(a.d, b.d) AS d, o, f
        FROM (SELECT user_id AS px_id, CAST(ts AS DATE) AS d, sum(value) AS o FROM events GROUP BY ALL) a
        FULL JOIN (SELECT u.px_id, CAST(g.d AS DATE) AS d, ((u.px_id*3 + day(g.d)) % 7) * 5e-1 AS f FROM (SELECT DISTINCT user_id AS px_id FROM events) u,
                   (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d) g) b ON a.px_id = b.px_id AND a.d = b.d) GROUP BY ALL)""")
def _(spark, sf):
    ev = I.table(spark, sf, "events")
    obs = R.file_stream(spark, sf, ev.schema, glob="events.parquet").select(F.col("user_id").alias("px_id"), "ts", F.col("value").alias("rain_mm"))
    out = new_path(spark, "daily")
    R.start_daily_sink(R.daily_totals(obs.withColumn("ts", F.col("ts").cast("timestamp"))), out, new_path(spark, "ckpt")).awaitTermination()
    fc = ev.select(F.col("user_id").alias("px_id")).distinct().select(
        "px_id", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("d")).withColumn(
        "rain_mm", (F.col("px_id") * 3 + F.dayofmonth("d")) % 7 * 0.5)
    return rounded(R.running_dekads(R.latest_daily(spark, out), fc), "obs_mm", "fc_mm", "p")


SEASONS = "SELECT px_id, year, onset AS planting FROM v_onset"
_CLS = lambda w: f"CASE WHEN {w} < 50 THEN 1 WHEN {w} < 60 THEN 2 WHEN {w} < 80 THEN 3 WHEN {w} < 95 THEN 4 ELSE 5 END"


@query("str2_season_monitor_stream", f"""
    WITH RECURSIVE {stepwise_sql(SEASONS, MAIZE, 7, 15, 1)}
    SELECT px_id, year, gd, round(sw, 6) AS sw, round(wrsi, 6) AS wrsi, cls AS wrsi_class, prev AS previous_class, CASE WHEN cls <> prev THEN 1 ELSE 0 END AS alert, 0 AS late, 0 AS gap FROM (
      SELECT *, coalesce(lag(cls) OVER (PARTITION BY px_id, year ORDER BY gd), 0) AS prev FROM (
        SELECT *, {_CLS('wrsi')} AS cls FROM (
          SELECT px_id, year, gd, sw, sum(aet) OVER w / greatest(sum(wr) OVER w, 1e-6) * 100 AS wrsi, sum(wr) OVER w AS cum
          FROM run WINDOW w AS (PARTITION BY px_id, year ORDER BY gd)) WHERE cum > 0))""")
def _(spark, sf):
    src, out = _season_rows(spark, sf), new_path(spark, "alerts")
    _run(spark, lambda: M.monitor(R.file_stream(spark, src, spark.read.parquet(src).schema), MAIZE, (6, 28)), out)
    return rounded(spark.read.parquet(out), "sw", "wrsi")


def _season_rows(spark, sf, files: str | None = None) -> str:
    cl = I.climate(spark, sf)
    pl = I.planting(spark, sf, cl).filter(F.col("planting").isNotNull()).select("px_id", "year", "planting")
    rows = season_frame(cl.select("px_id", "year", "dekad", "p", "et0"), 6, 28).join(pl, ["px_id", "year"])
    src = new_path(spark, "season")
    (rows.repartition(4, F.xxhash64(files)) if files else rows).write.parquet(src)
    return src


def _run(spark, stream, out: str) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, M.ROCKSDB)
    try:
        q = (stream().writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", new_path(spark, "ckpt")).option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


@query("str2_dekads_in_any_order", f"""
    WITH RECURSIVE {stepwise_sql(SEASONS, MAIZE, 7, 15, 1)}
    SELECT px_id, year, gd, round(sw, 6) AS sw, round(wrsi, 6) AS wrsi, cls AS wrsi_class, coalesce(lag(cls) OVER (PARTITION BY px_id, year ORDER BY gd), 0) AS previous_class FROM (
      SELECT *, {_CLS('wrsi')} AS cls FROM (
        SELECT px_id, year, gd, sw, sum(aet) OVER w / greatest(sum(wr) OVER w, 1e-6) * 100 AS wrsi, sum(wr) OVER w AS cum
        FROM run WINDOW w AS (PARTITION BY px_id, year ORDER BY gd)) WHERE cum > 0)""")
def _(spark, sf):
    """A season's dekads are dealt over four files by a hash of the dekad, one file a batch: they arrive in no order."""
    src, out = _season_rows(spark, sf, "gd"), new_path(spark, "alerts")
    _run(spark, lambda: M.monitor_any_order(R.file_stream(spark, src, spark.read.parquet(src).schema, per_batch=1), MAIZE, (6, 28), "3000 days"), out)
    return rounded(M.newest(spark.read.parquet(out)).select("px_id", "year", "gd", "sw", "wrsi", "wrsi_class", "previous_class"), "sw", "wrsi")
