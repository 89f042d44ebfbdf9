"""Product file names: grouping of tiles, label parsing, newest duplicate."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seasonlens.functions.masks import as_col


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File name and modification time below a folder (contents are not read)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("modificationTime").alias("mtime"))
    )


def base_name(file) -> Column:
    """Name without the extension and a duplicate's ' (N)'."""
    return F.regexp_replace(as_col(file), r"( \(\d+\))?\.tif$", "")


def newest_version(files: DataFrame) -> DataFrame:
    """Latest of 'base.tif', 'base (1).tif', ...; ties go to the greatest name."""
    return files.groupBy(base_name("file").alias("base")).agg(
        F.max(F.struct("mtime", "file")).alias("_m")).select("base", F.col("_m.file").alias("file"), F.col("_m.mtime").alias("mtime"))


def product_of_tile(file) -> Column:
    """Product name: the tile suffix '-row-col' and the extension removed."""
    return F.regexp_replace(as_col(file), r"(-\d+-\d+)?\.tif$", "")


def group_tiles(files: DataFrame) -> DataFrame:
    return files.groupBy(product_of_tile("file").alias("product")).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.min("file").alias("first_tile"), F.max("file").alias("last_tile"))


# Fixed value: file-name pattern of a statistics product.
STATS_NAME = r"planting_([A-Za-z]+)_([a-z]+)_([A-Za-z]+)_(\d{4})_stats"


def product_label(files: DataFrame) -> DataFrame:
    """Country, crop, season, year and display label; a foreign name labels itself."""
    part = lambda i: F.nullif(F.regexp_extract("file", STATS_NAME, i), F.lit(""))
    label = F.concat(F.initcap(part(2)), F.lit(" · "), part(3), F.lit(" · "), part(4))
    return files.withColumns({
        "country": part(1), "crop": part(2), "season": F.coalesce(part(3), F.lit("?")),
        "year": part(4).cast("int"), "label": F.coalesce(label, F.col("file"))})
