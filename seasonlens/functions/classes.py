"""Class breaks and flags (column expressions)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from seasonlens import config as C
from seasonlens.functions.masks import as_col


def wrsi_class(wrsi) -> Column:
    """Five classes: 1 failure < 50 <= 2 poor < 60 <= 3 mediocre < 80 <= 4 < 95 <= 5."""
    w = as_col(wrsi)
    return (
        F.when(w < 50, 1).when(w < 60, 2).when(w < 80, 3).when(w < 95, 4).when(w >= 95, 5)
    )


def wrsi_class_coarse(wrsi) -> Column:
    """Three-way fallback for products shipped without a class band."""
    w = as_col(wrsi)
    return F.when(w >= 80, 5).when(w >= 50, 3).when(w.isNotNull(), 1)


def asap_class(affected_pct) -> Column:
    pct, out = as_col(affected_pct), None
    for cut, name in C.ASAP_BREAKS:
        out = F.when(pct >= cut, F.lit(name)) if out is None else out.when(pct >= cut, F.lit(name))
    return out.when(pct.isNotNull(), F.lit("None"))


def maturity_from_lgp(lgp, elev_m) -> Column:
    """1 early, 2 medium, 3 late from growing-period length and elevation."""
    lgp, cool = as_col(lgp), as_col(elev_m) >= C.COOL_ELEV_M
    return (
        F.when((lgp < C.LGP_EARLY_MAX) & ~cool, 1)
        .when((lgp >= C.LGP_LATE_MIN) | (cool & (lgp >= C.LGP_LATE_COOL_MIN)), 3)
        .when(lgp.isNotNull() & as_col(elev_m).isNotNull(), 2)
    )


def gdd_maturity(maturity_class) -> Column:
    m = as_col(maturity_class)
    return (
        F.when(m == 1, C.GDD_MATURITY[1]).when(m == 3, C.GDD_MATURITY[3])
        .when(m.isNotNull(), C.GDD_MATURITY[2])
    )


def aez_belt(code) -> Column:
    """First two-letter belt of a zone code, NULL for lakes, parks and the like."""
    first = F.regexp_extract(as_col(code), "([A-Z]{2})", 1)
    return F.when(first.isin(*C.BELTS), first)


def aez_zone(code) -> Column:
    """Driest zone number in the code; a trailing 'O' is per-humid zone 0."""
    code = as_col(code)
    digits = F.regexp_extract_all(code, F.lit(r"(\d+)"), 1)
    driest = F.array_max(F.transform(digits, lambda s: s.cast("int")))
    zone = F.when(F.size(digits) > 0, driest).when(F.rtrim(code).endswith("O"), 0)
    return F.when(aez_belt(code).isNotNull(), zone)


def aez_maturity(belt, zone) -> Column:
    belt, zone = as_col(belt), as_col(zone)
    cool = F.coalesce(belt.isin(*C.COOL_BELTS), F.lit(False))
    return (
        F.when(zone.isNull(), "unclassified")
        .when(cool, F.when(zone <= 3, "late").otherwise("medium"))
        .when(zone <= 2, "late").when(zone <= 4, "medium").otherwise("early")
    )


def maturity_rank(name) -> Column:
    """Report order: early, medium, late, then the rest."""
    n = as_col(name)
    return F.when(n == "early", 0).when(n == "medium", 1).when(n == "late", 2).otherwise(9)


def name_key(s) -> Column:
    """Join key for place names: upper case, no ' or ., - read as space, trimmed."""
    return F.trim(F.translate(F.upper(as_col(s)), "-'.", " "))
