"""Table scans, static materialisation and the shared work folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets one temporary folder; a cluster, whose machines do not
    share one, is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scan(spark: SparkSession, path: str, years: Sequence[int] | None = None,
         columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; a ``year`` partition column prunes folders."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    return df.select(*columns) if columns else df


def is_complete(spark: SparkSession, path: str) -> bool:
    """A table whose writer has committed: Spark marks it with ``_SUCCESS`` as the last step."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                partition_by: Sequence[str] = ()) -> DataFrame:
    """Read a static table if its writer has committed it, else build and store it.

    What a lost writer has left is written over.
    """
    if not is_complete(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def store_bucketed(rows: DataFrame, name: str, path: str, buckets: int, by: Sequence[str] = ("px_id",), order: Sequence[str] = ()) -> DataFrame:
    """Store rows as a catalogue table bucketed by pixel, files under ``path``; read it as ``spark.table(name)``.

    Tables with the same ``buckets`` are co-located: season gathers, balances and joins by pixel over them need no
    exchange (joins by pixel and year where the session sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false).  Choose ``buckets`` so that one bucket fits a task (a bucket is one file and is read whole by one
    task); a pixel's rows are bounded by the calendar, so no bucket is hot.
    """
    rows.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(name)
    return rows.sparkSession.table(name)


def select_zones(zones: DataFrame, names: Sequence[str], level: int) -> DataFrame:
    return zones.filter((F.col("level") == level) & F.col("country").isin(list(names)))


# Configuration country name -> boundary-table country name, where they differ.
BOUNDARY_NAME = {"Tanzania": "United Republic of Tanzania", "South_Sudan": "South Sudan"}


def boundary_name(country: str) -> str:
    return BOUNDARY_NAME.get(country, country)
