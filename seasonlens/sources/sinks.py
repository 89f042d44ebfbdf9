"""Output shapes: integer rasters, WKT tables, nested documents, band renaming."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.functions.dekads import dekad_label
from seasonlens.functions.masks import as_col

# Stored band order of the multi-band products.
CPI_STACK = ("wrsi_veg", "wrsi_flo", "wrsi_grf", "wsi_veg", "wsi_flo", "wsi_grf",
             "cpi", "yield_tha_x100", "s_water", "s_heat", "s_veg")
EXCESS_STACK = ("false_start", "waterlog_idx", "spi3_wet", "onset_acc_mm")


def to_int16(x, scale: float = 1.0) -> Column:
    """Truncate to the int16 storage type after scaling; out-of-range values saturate."""
    v = as_col(x) * scale if scale != 1.0 else as_col(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-32768)), F.lit(32767)).cast("int")).cast("smallint")


def cpi_stack(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eleven-band int16 stack; yield and stress fractions are stored x100."""
    scale = {"yield_tha_x100": ("yield_tha", 100.0), "s_water": ("s_water", 100.0),
             "s_heat": ("s_heat", 100.0), "s_veg": ("s_veg", 100.0)}
    return pixels.select(*keys, *[to_int16(*scale.get(b, (b, 1.0))).alias(b) for b in CPI_STACK])


def write_raster(rows: DataFrame, path: str, partition_by: Sequence[str] = ("product", "year"), files: int | None = None,
                 spread: str = "px_id") -> None:
    """Pixel rows by product and year.  Rows are rebalanced by folder: the writers of a folder follow its size (small folders
    share a task, a large one is split into files of ``spark.sql.adaptive.advisoryPartitionSizeInBytes``).  With ``files`` a
    folder is gathered into that many pixel groups instead, and holds at most so many files."""
    if files is None:
        rows.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return
    group = F.pmod(F.xxhash64(spread), F.lit(files))
    rows.repartition(*partition_by, group).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def _num(x: Column) -> Column:
    return x.cast("string")


def pixel_wkt(cells: DataFrame, bands: Sequence[str], kind: str = "planting", geometry: str = "polygon",
              res: float = 0.25) -> DataFrame:
    """Valid pixels as WKT points or cell squares; lon/lat to 6 and values to 3 decimals."""
    b0 = F.col(bands[0])
    ok = b0.between(1, 36) if kind == "planting" else (b0 > 0) & (b0 <= 100)
    out = cells.filter(ok).withColumns({"lon": F.bround("lon", 6), "lat": F.bround("lat", 6)})
    if geometry == "point":
        wkt = F.concat(F.lit("POINT ("), _num(F.col("lon")), F.lit(" "), _num(F.col("lat")), F.lit(")"))
    else:
        x0, x1 = (_num(F.bround(F.col("lon") + s * res / 2, 6)) for s in (-1, 1))
        y0, y1 = (_num(F.bround(F.col("lat") + s * res / 2, 6)) for s in (-1, 1))
        at = lambda x, y: F.concat(x, F.lit(" "), y)
        ring = F.concat_ws(", ", at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))
        wkt = F.concat(F.lit("POLYGON (("), ring, F.lit("))"))
    label = [dekad_label(bands[0]).alias("dekad_label")] if kind == "planting" else []
    return out.select("lon", "lat", *[F.bround(F.col(b).cast("double"), 3).alias(b) for b in bands],
                      *label, wkt.alias("geometry_wkt"))


LEVEL_KEYS = {1: ("name",), 2: ("county", "name"), 3: ("county", "constituency", "name")}


def attach_geometry(rows: DataFrame, zones: DataFrame, level: int) -> DataFrame:
    keys = LEVEL_KEYS[level]
    return rows.join(zones.filter(F.col("level") == level).select(*keys, F.col("wkt").alias("geometry_wkt")), list(keys))


def _json_number(x: Column) -> Column:
    """A number as JSON text to three decimals, without an exponent at any size (text of a double has one from 1e7 on); NULL and NaN are null."""
    v = F.round(F.nanvl(x.cast("double"), F.lit(None).cast("double")), 3)
    plain = F.regexp_replace(v.try_cast("decimal(38,3)").cast("string"), r"(\.\d+?)0+$", "$1")
    finite = F.abs(v) < F.lit(float("inf"))
    return F.coalesce(F.when(finite, F.coalesce(plain, v.cast("string"))), F.when(~finite, F.concat(F.lit('"'), v.cast("string"), F.lit('"'))), F.lit("null"))


def product_documents(rows: DataFrame, attrs: dict[str, str]) -> DataFrame:
    """One JSON line per product and level: {"id", "level", "units": [{n, p, c, a: {...}}]}.

    ``attrs`` maps column -> short key.  NaN becomes null and numbers keep three decimals.  A level
    has as many units as the admin table has rows, which is bounded by geography, not by pixels.
    """
    keep = {"ignoreNullFields": "false"}
    named = F.struct(F.col("name").alias("n"), F.coalesce("county", F.lit("")).alias("p"),
                     F.when(F.col("level") == 3, F.coalesce("constituency", F.lit(""))).otherwise("").alias("c"))
    inner = F.concat_ws(",", *[F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), _json_number(F.col(c))) for c, k in attrs.items()])
    opened = lambda s: F.regexp_replace(F.to_json(s, keep), r"\}$", "")  # to be continued
    unit = F.struct(named.alias("u"), F.concat(opened(named), F.lit(',"a":{'), inner, F.lit("}}")).alias("t"))
    units = F.transform(F.array_sort(F.collect_list(unit), lambda x, y: _by_name(x["u"], y["u"])), lambda u: u["t"])
    doc = F.concat(opened(F.struct("product", "level")), F.lit(',"units":['), F.concat_ws(",", units), F.lit("]}"))
    return rows.groupBy("product", "level").agg(doc.alias("doc"))


def _by_name(x: Column, y: Column) -> Column:
    kx, ky = (F.concat_ws("|", u["p"], u["c"], u["n"]) for u in (x, y))
    return F.when(kx < ky, -1).when(kx > ky, 1).otherwise(0)


def ward_documents(rows: DataFrame) -> DataFrame:
    """Nested county -> ward JSON, one line per county."""
    r = rows.filter(F.col("obs").isNotNull() & F.col("est").isNotNull())
    ward = F.struct(F.initcap("ward").alias("k"), F.struct(
        F.col("obs").cast("int").alias("obs"), F.col("est").cast("int").alias("est"),
        (F.col("est") - F.col("obs")).cast("int").alias("err"),
        F.coalesce(F.col("farmers"), F.lit(0)).cast("int").alias("farmers"),
        F.coalesce(F.col("n_px"), F.lit(0)).cast("int").alias("n_px")).alias("v"))
    return r.groupBy(F.initcap("county").alias("county")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(ward)))).alias("doc"))


def rename_bands(rows: DataFrame, keys: Sequence[str], names: Sequence[str], primary: str) -> DataFrame:
    """Impose band names by position and mask every band where the primary one is not positive."""
    named = rows.toDF(*keys, *names)
    return named.select(*keys, *[F.when(F.col(primary) > 0, F.col(b)).alias(b) for b in names])
