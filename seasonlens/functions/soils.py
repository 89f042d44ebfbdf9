"""Saxton-Rawls (2006) pedotransfer equations as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from seasonlens.functions.masks import as_col, clamp, floor_at, nmax


def organic_matter_pct(soc_dgkg) -> Column:
    return as_col(soc_dgkg) / 100.0 * 1.724


def _texture_terms(sand, clay, om, k) -> Column:
    """Linear + pairwise form shared by the three regressions; k are its seven coefficients."""
    return (
        k[0] * sand + k[1] * clay + k[2] * om
        + k[3] * sand * om + k[4] * clay * om + k[5] * sand * clay + k[6]
    )


# Regression coefficients (sand, clay, om, sand*om, clay*om, sand*clay, intercept).
_WP = (-0.024, 0.487, 0.006, 0.005, -0.013, 0.068, 0.031)
_FC = (-0.251, 0.195, 0.011, 0.006, -0.027, 0.452, 0.299)
_S33 = (0.278, 0.034, 0.022, -0.018, -0.027, -0.584, 0.078)


def wilting_point(sand, clay, om) -> Column:
    t = _texture_terms(as_col(sand), as_col(clay), as_col(om), _WP)
    return t + (0.14 * t - 0.02)


def field_capacity(sand, clay, om) -> Column:
    t = _texture_terms(as_col(sand), as_col(clay), as_col(om), _FC)
    return t + (1.283 * t * t - 0.374 * t - 0.015)


def saturation_raw(sand, clay, om, fc) -> Column:
    t = _texture_terms(as_col(sand), as_col(clay), as_col(om), _S33)
    return as_col(fc) + (t + (0.636 * t - 0.107)) - 0.097 * as_col(sand) + 0.043


def saturation(sand, clay, om, fc) -> Column:
    return clamp(saturation_raw(sand, clay, om, fc), 0.30, 0.75)


def ksat_mm_hr(sat_raw, fc, wp) -> Column:
    """Saturated conductivity, from unclamped saturation."""
    fc, wp = as_col(fc), as_col(wp)
    lam = floor_at(F.ln(fc) - F.ln(wp), 1e-4) / (math.log(1500.0) - math.log(33.0))
    return floor_at(1930.0 * F.pow(floor_at(as_col(sat_raw) - fc, 1e-4), 3 - lam), 1e-3)


def drainage_tau(ksat_mm_day) -> Column:
    """Daily drainage fraction."""
    return clamp(0.0866 * F.pow(as_col(ksat_mm_day), F.lit(0.35)), 0.0, 1.0)


def layer_mm(top_cm, bot_cm, root_depth_cm: float) -> Column:
    """Thickness of a layer inside the root zone, in mm (0 below it)."""
    return floor_at(F.least(as_col(bot_cm), F.lit(root_depth_cm)) - as_col(top_cm), 0.0) * 10.0


def saturation_floor(sat_mm, fc_mm) -> Column:
    return nmax(sat_mm, as_col(fc_mm) + 10)
