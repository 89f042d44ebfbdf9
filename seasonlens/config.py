"""Agronomic parameters. Every number here is a fixed published or configured value."""
from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CropParams:
    """FAO-56 stage lengths (dekads), crop coefficients and rooting depth."""

    crop: str
    lgp: int
    l_ini: int
    l_dev: int
    l_mid: int
    l_late: int
    kc_ini: float
    kc_mid: float
    kc_end: float
    root_depth_m: float = 1.0

    @property
    def veg_end(self) -> int:
        return self.l_ini + self.l_dev

    @property
    def flo_end(self) -> int:
        return self.veg_end + self.l_mid

    def variety(self, name: str, **override) -> "CropParams":
        return replace(self, crop=name, **override)


# FAO-56 coefficients per crop.
MAIZE = CropParams("maize", 12, 3, 4, 3, 2, 0.30, 1.20, 0.35, 1.0)
WHEAT = CropParams("wheat", 12, 3, 4, 3, 2, 0.40, 1.15, 0.35, 1.0)
TEFF = CropParams("teff", 9, 2, 3, 3, 1, 0.30, 1.10, 0.40, 0.6)
# Short-duration (85-90 day) maize overrides the stage lengths only.
EARLY_STAGES = {"lgp": 9, "l_ini": 2, "l_dev": 3, "l_mid": 2, "l_late": 2}
MAIZE_EARLY = MAIZE.variety("maize_early", **EARLY_STAGES)
CROPS = {c.crop: c for c in (MAIZE, WHEAT, TEFF)}


@dataclass(frozen=True)
class SoilConfig:
    default_whc_mm: float = 100.0
    init_frac: float = 0.0
    source: str = "texture"
    wp_over_fc: float = 0.45
    min_whc_mm: float = 25.0


SOIL = SoilConfig()

# Emergence lag in dekads; any other crop uses DEFAULT_EMERGENCE.
EMERGENCE_OFFSET = {"maize": 2, "wheat": 1, "teff": 1}
DEFAULT_EMERGENCE = 1

# FAO-33 stage yield response, heat and vegetation weights, reference yields.
KY = {"veg": 0.4, "flo": 1.5, "grf": 0.5}
KY_SEASON = 1.25
HEAT_CAP_C = 33.0
HEAT_LOSS = 0.06
VEG_WEIGHT = 0.4
ZFPAR_FULL = 2.0
YM_SHORT_THA = 4.5
YM_MAIN_THA = 6.0
PIXEL_HA = 6.25

# Wet-side stage weights and thresholds.
EXCESS_WEIGHT = {"veg": 1.0, "flo": 0.6, "grf": 0.35}
WET_DEKAD_MM = 100.0
SPI_WET = 1.5
SPI_DRY = -1.0
AER_ET_MM = 4.0
AER_START = 0.5
AER_SCALE_DAYS = 4.0
AER_W0 = 0.8

# Thermal clock.
LAPSE_C_PER_M = 0.0065
GDD_BASE_C = 9.0
GDD_CAP_C = 30.0
GDD_MATURITY = {1: 1300.0, 2: 1500.0, 3: 1700.0}
STAGE_FRACTION = {
    "peak_vegetative": 0.45,
    "flowering": 0.55,
    "grain_filling": 0.65,
    "maturity": 1.0,
}

# Data-derived maturity class breaks.
LGP_EARLY_MAX = 7
LGP_LATE_MIN = 15
LGP_LATE_COOL_MIN = 12
COOL_ELEV_M = 1800.0
COOL_BELTS = ("TA", "UH", "LH")
BELTS = ("TA", "UH", "LH", "UM", "LM", "IL", "CL")

# Share of crop area affected -> alert class.
ASAP_BREAKS = ((75.0, "Critical"), (50.0, "Alert"), (25.0, "Watch"))

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
