"""Season calendar and crop parameter tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonlens.config import CROPS, CropParams
from seasonlens.functions.dekads import parse_dekad_window

CALENDAR_SCHEMA = (
    "country string, crop string, season string, crop_viability string, "
    "indicative_planting_window string, sos_detection_window string"
)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CALENDAR_SCHEMA)


def viable_products(calendar: DataFrame, country: str | None = None, crop: str | None = None,
                    season: str | None = None) -> DataFrame:
    out = calendar.filter(F.col("crop_viability").isin("High", "Medium"))
    if country:
        out = out.filter(F.col("country") == country)
    if crop:
        out = out.filter(F.lower("crop") == crop.lower())
    if season:
        out = out.filter(F.col("season") == season)
    return out


def with_windows(calendar: DataFrame) -> DataFrame:
    """Parse both windows to dekads (a wrapping end runs past 36)."""
    return calendar.withColumns({
        "_s": parse_dekad_window("sos_detection_window"), "_p": parse_dekad_window("indicative_planting_window"),
    }).withColumns({
        "sos_start": F.col("_s.start"), "sos_end": F.col("_s.end"),
        "win_start": F.col("_p.start"), "win_end": F.col("_p.end"),
    }).drop("_s", "_p")


CROP_SCHEMA = ("crop string, lgp int, l_ini int, l_dev int, l_mid int, l_late int, kc_ini double, "
               "kc_mid double, kc_end double, root_depth_m double")


def crop_table(spark: SparkSession, crops: Sequence[CropParams] = tuple(CROPS.values())) -> DataFrame:
    return spark.createDataFrame(
        [(c.crop, c.lgp, c.l_ini, c.l_dev, c.l_mid, c.l_late, c.kc_ini, c.kc_mid, c.kc_end, c.root_depth_m)
         for c in crops], CROP_SCHEMA)


def crop_columns() -> CropParams:
    """The parameters of each row's own crop, for rows joined with ``crop_table``."""
    return CropParams("row", *[F.col(c.split()[0]) for c in CROP_SCHEMA.split(", ")[1:]])


def with_variety(base: DataFrame, override: DataFrame, on: Sequence[str] = ("crop",)) -> DataFrame:
    """Variety rows: the override's value where it has one, else the crop's."""
    rest = [c for c in base.columns if c not in on]
    o = override.select(*on, *[F.col(c).alias(f"_o_{c}") for c in override.columns if c not in on])
    return base.join(o, list(on), "left").select(
        *on, *[(F.coalesce(F.col(f"_o_{c}"), F.col(c)) if f"_o_{c}" in o.columns else F.col(c)).alias(c) for c in rest])
