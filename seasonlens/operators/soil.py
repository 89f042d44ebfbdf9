"""Root-zone water capacity and hydraulics from layered soil tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seasonlens.config import SOIL, SoilConfig
from seasonlens.functions import soils as S
from seasonlens.functions.masks import clamp, floor_at
from seasonlens.operators.frames import PX


def with_texture(layers: DataFrame, root_depth_cm: float = 100.0) -> DataFrame:
    """Per-layer wilting point, field capacity, saturation, Ksat and thickness in the root zone."""
    sand, clay = F.col("sand_gkg") / 1000.0, F.col("clay_gkg") / 1000.0
    om = S.organic_matter_pct("soc_dgkg")
    return (
        layers.filter(F.col("top_cm") < root_depth_cm)
        .withColumns({"fc": S.field_capacity(sand, clay, om), "wp": S.wilting_point(sand, clay, om),
                      "th_mm": S.layer_mm("top_cm", "bot_cm", root_depth_cm)})
        .withColumn("sat_raw", S.saturation_raw(sand, clay, om, "fc"))
        .withColumns({"sat": clamp("sat_raw", 0.30, 0.75), "ksat": S.ksat_mm_hr("sat_raw", "fc", "wp")})
    )


def texture_whc(layers: DataFrame, root_depth_cm: float = 100.0, min_mm: float = SOIL.min_whc_mm,
                keys: Sequence[str] = PX) -> DataFrame:
    """Plant-available water over the root zone."""
    mm = floor_at(F.col("fc") - F.col("wp"), 0.0) * F.col("th_mm")
    return with_texture(layers, root_depth_cm).groupBy(*keys).agg(floor_at(F.sum(mm), min_mm).alias("whc_mm"))


def hydraulics(layers: DataFrame, root_depth_cm: float = 100.0, keys: Sequence[str] = PX) -> DataFrame:
    """Field capacity and saturation in mm, drainage fraction of the tightest layer."""
    return with_texture(layers, root_depth_cm).groupBy(*keys).agg(
        F.sum(F.col("fc") * F.col("th_mm")).alias("fc_mm"),
        F.sum(F.col("sat") * F.col("th_mm")).alias("_sat"),
        F.min("ksat").alias("_k"),
    ).select(*keys, "fc_mm", S.saturation_floor("_sat", "fc_mm").alias("sat_mm"),
             S.drainage_tau(F.col("_k") * 24.0).alias("tau"))


def node_whc(nodes: DataFrame, root_depth_cm: float = 100.0, wp_frac: float = SOIL.wp_over_fc,
             own_wp: bool = False, min_mm: float = SOIL.min_whc_mm, keys: Sequence[str] = PX) -> DataFrame:
    """Capacity by trapezoids between depth nodes, the last one cut at the root depth."""
    fc = F.col("fc_vol_pct") * 0.01
    wp = F.col("wp_vol_pct") * 0.01 if own_wp else fc * wp_frac
    w = Window.partitionBy(*keys).orderBy("depth_cm")
    seg = nodes.withColumn("awc", floor_at(fc - wp, 0.0)).select(
        *keys, F.col("depth_cm").alias("top"), F.lead("depth_cm").over(w).alias("bot"),
        F.col("awc").alias("a0"), F.lead("awc").over(w).alias("a1"),
    ).filter(F.col("bot").isNotNull() & (F.col("top") < root_depth_cm))
    cut = F.least(F.col("bot").cast("double"), F.lit(float(root_depth_cm)))
    a_cut = F.col("a0") + (F.col("a1") - F.col("a0")) * ((cut - F.col("top")) / (F.col("bot") - F.col("top")))
    return seg.groupBy(*keys).agg(
        floor_at(F.sum((F.col("a0") + a_cut) * 0.5 * ((cut - F.col("top")) * 10.0)), min_mm).alias("whc_mm"))


def water_capacity(layers: DataFrame | None, nodes: DataFrame | None, cfg: SoilConfig = SOIL,
                   stored: DataFrame | None = None, root_depth_cm: float = 100.0) -> DataFrame:
    """A materialised table wins over the configured builder."""
    if stored is not None:
        return stored
    if cfg.source == "texture":
        return texture_whc(layers, root_depth_cm, cfg.min_whc_mm)
    return node_whc(nodes, root_depth_cm, cfg.wp_over_fc, min_mm=cfg.min_whc_mm)
