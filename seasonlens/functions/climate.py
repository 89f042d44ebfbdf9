"""Radiation, reference evapotranspiration, crop coefficient, thermal time (column expressions)."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from seasonlens import config as C
from seasonlens.config import CropParams
from seasonlens.functions.dekads import dekad_days, dekad_start
from seasonlens.functions.masks import as_col, cap_at, clamp, floor_at

SOLAR_MJ_M2_MIN = 0.0820  # fixed value
KELVIN = 273.15


def extraterrestrial_radiation(lat_deg, doy) -> Column:
    """Ra in mm/day (FAO-56).  The sunset-angle cosine is clamped for polar latitudes."""
    lat = F.radians(as_col(lat_deg))
    b = as_col(doy) * (2 * math.pi / 365.0)
    dr = 1 + 0.033 * F.cos(b)
    decl = 0.409 * F.sin(b - 1.39)
    ws = F.acos(clamp(-F.tan(lat) * F.tan(decl), -1.0, 1.0))
    mj = (24 * 60 / math.pi) * SOLAR_MJ_M2_MIN * dr * (
        ws * F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.sin(ws)
    )
    return mj * 0.408


def day_length(lat_deg, doy, elevation_deg: float = 0.0) -> Column:
    """Hours with the sun above an elevation (0: sunrise to sunset; -6: with civil twilight), kept to 0..24 near the poles."""
    lat, decl = F.radians(as_col(lat_deg)), 0.409 * F.sin(as_col(doy) * (2 * math.pi / 365.0) - 1.39)
    cos_ws = (math.sin(math.radians(elevation_deg)) - F.sin(lat) * F.sin(decl)) / floor_at(F.cos(lat) * F.cos(decl), 1e-9)
    return F.acos(clamp(cos_ws, -1.0, 1.0)) * (24 / math.pi)


def induction_rate(hours, base: float, ceiling: float) -> Column:
    """Short-day response, 1 up to the base day length and 0 from the ceiling on: the time to induction is hyperbolic
    in the day length between them, and endless at the ceiling."""
    return clamp((ceiling - as_col(hours)) / (ceiling - base), 0.0, 1.0)


def hargreaves_et0(lat_deg, tmax_c, tmin_c, year, dekad) -> Column:
    """ET0 over a dekad in mm, from dekad-mean temperatures; Ra at day 5 of the dekad."""
    tmax, tmin = as_col(tmax_c), as_col(tmin_c)
    ra = extraterrestrial_radiation(lat_deg, F.dayofyear(dekad_start(year, dekad)) + 5)
    daily = 0.0023 * ra * ((tmax + tmin) / 2 + 17.8) * F.sqrt(floor_at(tmax - tmin, 0.0))
    return daily * dekad_days(year, dekad)


def crop_coefficient(dsp, p: CropParams) -> Column:
    """Kc from dekads since planting: flat, ramp, flat, ramp; 0 outside the cycle.  The parameters may be
    columns (see ``sources.calendars.crop_columns``)."""
    dsp = as_col(dsp)
    ramp = lambda n: F.greatest(n, F.lit(1e-6)) if isinstance(n, Column) else max(n, 1e-6)
    d1, d2, d3 = p.l_ini, p.veg_end, p.flo_end
    return (
        F.when((dsp < 0) | (dsp >= p.lgp), F.lit(0.0))
        .when(dsp < d1, F.lit(p.kc_ini))
        .when(dsp < d2, p.kc_ini + (dsp - d1) / ramp(p.l_dev) * (p.kc_mid - p.kc_ini))
        .when(dsp < d3, F.lit(p.kc_mid))
        .when(dsp < p.lgp, p.kc_mid + (dsp - d3) / ramp(p.l_late) * (p.kc_end - p.kc_mid))
    )


def dekad_gdd(tmax_c, tmin_c, base: float = C.GDD_BASE_C, cap: float = C.GDD_CAP_C) -> Column:
    return floor_at((cap_at(tmax_c, cap) + as_col(tmin_c)) / 2 - base, 0.0) * 10


def lapse_correct(t_c, elev_m, elev_coarse_m) -> Column:
    return as_col(t_c) - C.LAPSE_C_PER_M * (as_col(elev_m) - as_col(elev_coarse_m))


def thermal_offset(base: int, t_norm_c, t_ref: float = 22.0, step: float = 6.0) -> Column:
    """Emergence lag in dekads, longer where it is cooler, kept within 1..3."""
    return clamp(F.round((t_ref - as_col(t_norm_c)) / step) + base, 1.0, 3.0).cast("int")
