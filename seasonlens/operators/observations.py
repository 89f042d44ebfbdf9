"""Optical, radar and canopy observations: scene features, dekad composites, fused greenness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.functions.masks import clamp, keep_if, norm_diff, ratio, unit_scale, unmask
from seasonlens.operators.frames import dekadal, PX, salted_join

OPTICAL_BANDS = ("b3", "b4", "b5", "b6", "b7", "b8", "b8a", "b11", "b12")
INDICES = ("ndvi", "evi2", "ndre1", "ndre2", "rendvi", "cire")


def cloud_mask(obs: DataFrame, threshold: float = 0.60, bands: Sequence[str] = OPTICAL_BANDS) -> DataFrame:
    """Reflectance 0..1 where the clear-sky score reaches the threshold, else NULL."""
    clear = F.col("cs_cdf") >= threshold
    return obs.withColumns({b: keep_if(F.col(b) / 10000.0, clear) for b in bands if b in obs.columns})


def clear_scenes(obs: DataFrame, threshold: float = 0.60, bands: Sequence[str] = OPTICAL_BANDS) -> DataFrame:
    """``cloud_mask`` for compositing: cloudy observations are filtered out (a filter that reaches
    the scan) instead of carried as NULLs."""
    return obs.filter(F.col("cs_cdf") >= threshold).withColumns(
        {b: F.col(b) / 10000.0 for b in bands if b in obs.columns})


def optical_indices(obs: DataFrame) -> DataFrame:
    n, r = F.col("b8"), F.col("b4")
    return obs.withColumns({
        "ndvi": norm_diff("b8", "b4"),
        "evi2": ratio(2.5 * (n - r), n + 2.4 * r + 1),
        "ndre1": norm_diff("b6", "b5"),
        "ndre2": norm_diff("b7", "b5"),
        "rendvi": norm_diff("b8a", "b5"),
        "cire": ratio("b7", "b5") - 1,
    })


def median_composite(
    obs: DataFrame, bands: Sequence[str] = INDICES, date_col: str = "d", keys: Sequence[str] = PX,
    mode: str = "calendar",
) -> DataFrame:
    """Dekad median of each band over its valid observations (feed it ``clear_scenes``; dekads
    without any return as gaps of the spine).

    ``percentile`` buffers value counts and merges map-side, so copies of a value cost one entry
    and a pixel with very many scenes is combined before the shuffle.
    """
    aggs = [F.percentile(F.col(b), F.lit(0.5)).alias(b) for b in bands]
    return dekadal(obs, aggs, date_col, keys, mode)


def scenes_in_year(obs: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    """[1 January, 5 January of the next year): the last dekad may need the spill-over days."""
    return obs.filter((F.col(ts) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
                      & (F.col(ts) < F.make_date(F.lit(year + 1), F.lit(1), F.lit(5))))


def radar_scenes(
    obs: DataFrame, orbit: str = "DESCENDING", mode: str = "IW", need: Sequence[str] = ("VV", "VH")
) -> DataFrame:
    """Scene filter on mode, orbit and the list of polarisations."""
    out = obs.filter((F.col("instrument_mode") == mode) & (F.col("orbit") == orbit))
    for p in need:
        out = out.filter(F.array_contains("polarisations", p))
    return out


def link_band(obs: DataFrame, aux: DataFrame, on: Sequence[str], bands: Sequence[str], salts: int = 16) -> DataFrame:
    """Attach auxiliary bands (e.g. a clear-sky score) by scene key; unmatched scenes get NULL.

    A scene holds many pixels: they are spread over ``salts`` tasks.  Where the band is per pixel, put
    the pixel into ``on`` and set ``salts=1``, for the keys are then even.
    """
    return salted_join(obs, aux.select(*on, *bands), on, "left", salts)


def to_linear(db) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def to_db(linear) -> Column:
    return F.log10(F.when(linear > 0, linear)) * 10.0


def radar_features(obs: DataFrame, linear: bool = False) -> DataFrame:
    """vv, vh (linear), cross ratio, radar vegetation index and the dB bands."""
    out = obs if linear else obs.withColumns(
        {"vv": to_linear(F.col("vv_db")), "vh": to_linear(F.col("vh_db"))})
    vv, vh = F.col("vv"), F.col("vh")
    return out.withColumns({
        "vh_vv": ratio(vh, vv), "rvi": ratio(4 * vh, vv + vh), "vv_db": to_db(vv), "vh_db": to_db(vh)})


def mean_composite(
    obs: DataFrame, bands: Sequence[str], date_col: str = "d", keys: Sequence[str] = PX,
    scale: float = 1.0, mode: str = "calendar",
) -> DataFrame:
    aggs = [(F.avg(b) * scale if scale != 1.0 else F.avg(b)).alias(b) for b in bands]
    return dekadal(obs, aggs, date_col, keys, mode)


def coarse_ndvi(obs: DataFrame) -> DataFrame:
    n, r = F.col("nir"), F.col("red")
    return obs.withColumn("c", (n - r) / F.greatest(n + r, F.lit(1e-6)))


def optical_greenness() -> Column:
    """Mean of scaled red-edge index and canopy cue; both must be present."""
    return (unit_scale("ndre1", 0.0, 0.7) + unit_scale("fpar", 0.0, 0.9)) / 2


def radar_greenness() -> Column:
    return unit_scale("rvi", 0.1, 0.8)


def fused_greenness(
    optical: DataFrame, radar: DataFrame, canopy: DataFrame, keys: Sequence[str] = (*PX, "year", "dekad")
) -> DataFrame:
    """G per pixel and dekad: optical cue, radar where it is missing.  ``radar`` is the dense side.

    All three inputs come out of a group-by on the same keys, so the joins add no exchange.
    """
    return (
        radar.select(*keys, "rvi")
        .join(optical.select(*keys, "ndre1"), list(keys), "left")
        .join(canopy.select(*keys, "fpar"), list(keys), "left")
        .select(*keys, unmask(optical_greenness(), radar_greenness()).alias("g"))
    )


def canopy_condition(
    g: DataFrame, sos_start: int, sos_end: int, lgp: int = 12, keys: Sequence[str] = (*PX, "year")
) -> DataFrame:
    """FCCI: 100 x peak greenness between season start and the end of the cycle (same year)."""
    hi = min(sos_end + lgp, 36)
    return (
        g.filter(F.col("dekad").between(sos_start, hi)).groupBy(*keys)
        .agg(clamp(F.max("g") * 100, 0.0, 100.0).alias("fcci"))
    )


def temporal_zscore(
    rows: DataFrame, band: str, keys: Sequence[str] = PX, sd_floor: float = 1e-4, salts: int = 4
) -> DataFrame:
    """Per-pixel z-score over time.  Moments are a map-side-combined aggregate joined back on salted
    keys, so a pixel with very many observations is never gathered in one task."""
    m = rows.groupBy(*keys).agg(F.avg(band).alias("_m"), F.stddev_pop(band).alias("_s"))
    return salted_join(rows, m, keys, salts=salts).withColumn(
        f"{band}_z", (F.col(band) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(sd_floor))
    ).drop("_m", "_s")


def crop_pixels(mask: DataFrame, crop: str, override: DataFrame | None = None) -> DataFrame:
    """Pixels of the crop: an override table if given, else the crop's own product, else any
    temporary crop."""
    if override is not None:
        return override.select("px_id").distinct()
    product = "maize" if crop == "maize" else "temporarycrops"
    return mask.filter((F.col("product") == product) & (F.col("classification") == 100)).select("px_id")


def masked_to(rows: DataFrame, crop: DataFrame, keys: Sequence[str] = PX) -> DataFrame:
    """Keep crop pixels only, ahead of everything that does not need neighbours."""
    return rows.join(crop, list(keys), "left_semi")
