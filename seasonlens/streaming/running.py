"""Running-dekad rainfall as a stream: late observations replace forecast days."""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonlens.functions.dekads import date_to_dekad, dekad_days
from seasonlens.sources.tables import is_complete


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_batch).parquet(path)
    )


def daily_totals(obs: DataFrame, watermark: str = "10 days") -> DataFrame:
    """Rain per pixel and day from timestamped observations.  State is one number per pixel-day
    and is dropped once the watermark has passed the day; rows later than that are dropped too
    (``late_rows`` counts them)."""
    return (
        obs.withWatermark("ts", watermark)
        .groupBy("px_id", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("rain_mm").alias("rain_mm"))
        .select("px_id", F.to_date("w.start").alias("d"), "rain_mm")
    )


def start_daily_sink(daily: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write every micro-batch's updated totals to its own folder ``year=Y/dekad=K/batch=N``.

    Overwriting a batch's folders makes a replay harmless, so a restart after a lost executor or
    driver neither drops nor doubles a total; the dekad folders let readers open what they need.
    """
    def save(batch: DataFrame, n: int) -> None:
        placed = batch.withColumns({"year": F.year("d"), "dekad": date_to_dekad("d"), "batch": F.lit(n)})
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "dekad", "batch").parquet(path)

    w = daily.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(availableNow=True) if available_now else w).start()


def late_rows(query) -> int:
    """Rows that a stream has dropped behind its watermark, by its progress reports so far.  The batch over the
    stored rows would count them: stream and batch agree for rows that are no later than the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def _closed_path(path: str) -> str:
    return f"{path.rstrip('/')}-closed"


def _of_dekads(rows: DataFrame, dekads) -> DataFrame:
    if not dekads:
        return rows
    at = F.col("year") * 36 + F.col("dekad")
    (y0, k0), (y1, k1) = dekads
    return rows.filter(F.col("year").between(y0, y1) & at.between(y0 * 36 + k0, y1 * 36 + k1))


def _folders(spark: SparkSession, pattern: str) -> dict[int, str]:
    """number -> path of the folders ``.../name=<number>`` that match a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()
    return {int(f.getPath().getName().split("=")[1]): f.getPath().toString() for f in found}


def _totals(spark: SparkSession, path: str, dekads) -> DataFrame | None:
    """px_id, d, rain_mm, batch, year, dekad of all batch folders and compacted sets; None where there are none."""
    parts = []
    for top, name in ((path.rstrip("/"), "batch"), (_closed_path(path), "set")):
        if _folders(spark, f"{top}/year=*/dekad=*/{name}=*"):
            rows = _of_dekads(spark.read.option("basePath", top).parquet(top), dekads)
            parts.append(rows.select("px_id", "d", "rain_mm", F.col("batch").cast("long").alias("batch"), "year", "dekad"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def latest_daily(spark: SparkSession, path: str, dekads: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Newest total per pixel-day over the batches written so far and the compacted sets.  ``dekads``: first and last
    (year, dekad) wanted, such as the open ones; other folders are not read."""
    rows = _totals(spark, path, dekads)
    if rows is None:
        return spark.createDataFrame([], "px_id long, d date, rain_mm double")
    return rows.groupBy("px_id", "d").agg(F.max_by("rain_mm", "batch").alias("rain_mm"))


def compact_dekad(spark: SparkSession, path: str, year: int, dekad: int, rows_per_file: int = 4_000_000) -> None:
    """Store a closed dekad's newest totals as one set of files, clustered by pixel, whose number follows its size.

    A set lies in a folder of its own, named by its newest batch, and each total keeps its batch number.  Readers take the
    newest per pixel and day over all folders, so they see the same totals before, while and after this runs; a second run
    changes nothing, what a lost run has left is written over, and a replayed batch or one with late rows counts as it
    should.  Folders that the set replaces stay until ``drop_compacted``.
    """
    rows = _totals(spark, path, ((year, dekad), (year, dekad)))
    last = rows.agg(F.max("batch")).first()[0] if rows is not None else None
    target = f"{_closed_path(path)}/year={year}/dekad={dekad}/set={last}"
    if last is None or is_complete(spark, target):
        return
    rows = rows.groupBy("px_id", "d").agg(F.max_by("rain_mm", "batch").alias("rain_mm"), F.max("batch").alias("batch"))
    files = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(files, "px_id").sortWithinPartitions("px_id", "d").write.mode("overwrite").parquet(target)


def drop_compacted(spark: SparkSession, path: str, year: int, dekad: int) -> int:
    """Delete the folders of a dekad (batches and older sets) whose totals its newest committed set holds, and say how
    many; to be called when no reader that opened them is left.  A newer batch stays."""
    sets = {n: f for n, f in _folders(spark, f"{_closed_path(path)}/year={year}/dekad={dekad}/set=*").items() if is_complete(spark, f)}
    if not sets:
        return 0
    newest = max(sets)
    old = [f for n, f in _folders(spark, f"{path.rstrip('/')}/year={year}/dekad={dekad}/batch=*").items() if n <= newest]
    old += [f for n, f in sets.items() if n < newest]
    for f in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)


def running_dekads(daily: DataFrame, forecast: DataFrame) -> DataFrame:
    """Dekad totals in which each day is observed if it has arrived, else forecast.

    daily and forecast: px_id, d, rain_mm (one row per pixel-day).
    """
    both = daily.select("px_id", "d", F.col("rain_mm").alias("o")).join(
        forecast.select("px_id", "d", F.col("rain_mm").alias("f")), ["px_id", "d"], "full")
    return both.groupBy("px_id", F.year("d").alias("year"), date_to_dekad("d").alias("dekad")).agg(
        F.coalesce(F.sum("o"), F.lit(0.0)).alias("obs_mm"), F.count("o").alias("obs_days"),
        F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("f"))), F.lit(0.0)).alias("fc_mm"),
    ).withColumns({
        "p": F.col("obs_mm") + F.col("fc_mm"),
        "closed": (F.col("obs_days") == dekad_days("year", "dekad")).cast("int"),
    })
