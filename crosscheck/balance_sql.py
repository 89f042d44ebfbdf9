"""Water-balance recurrences as recursive CTE-free SQL: an ordered list reduced step by step."""
from __future__ import annotations

from crosscheck.views import clamp, kc
from seasonlens.config import CropParams


def season_sql(planting: str, p: CropParams, lo: int, hi: int, col: str = "planting") -> str:
    """Season rows: px_id, year, gd, dsp, p, wr.  ``planting`` yields px_id, year, <col>."""
    return f"""
    SELECT s.px_id, s.year, s.gd, s.gd - q.{col} AS dsp, s.p, {kc(f'(s.gd - q.{col})', p)} * s.et0 AS wr FROM (
      SELECT px_id, year, dekad AS gd, p, et0 FROM v_climate WHERE dekad BETWEEN {lo} AND {hi}
      UNION ALL SELECT px_id, year - 1, dekad + 36, p, et0 FROM v_climate WHERE dekad + 36 BETWEEN {lo} AND {hi}) s
    JOIN ({planting}) q ON q.px_id = s.px_id AND q.year = s.year WHERE q.{col} IS NOT NULL"""


def balance_sql(planting: str, p: CropParams, ss: int, se: int, whc: str = "1e2", col: str = "planting", whc_from: str = "") -> str:
    """px_id, year, wrsi, deficit_mm, aet_mm, wr_mm, sw_end_mm, complete; NULL where a dekad is missing."""
    lo, hi = max(1, ss - 1), se + p.lgp + 1
    rows = season_sql(planting, p, lo, hi, col)
    join = f"JOIN ({whc_from}) USING (px_id)" if whc_from else ""
    return f"""
    SELECT px_id, year, r.aet / greatest(r.wr, 1e-6) * 100 AS wrsi, r.wr - r.aet AS deficit_mm, r.aet AS aet_mm, r.wr AS wr_mm, r.sw AS sw_end_mm, CAST(r IS NOT NULL AS INTEGER) AS complete
    FROM (SELECT px_id, year, CASE WHEN n = {hi - lo + 1} AND whole THEN list_reduce(s, lambda a, x: {{'sw': greatest(least(a.sw + x.p - least(a.sw + x.p, x.wr), a.cap), 0e0),
             'aet': a.aet + least(a.sw + x.p, x.wr), 'wr': a.wr + x.wr, 'p': 0e0, 'cap': a.cap}},
             {{'sw': 0e0, 'aet': 0e0, 'wr': 0e0, 'p': 0e0, 'cap': cap}}) END AS r
          FROM (SELECT px_id, year, {whc} AS cap, count(DISTINCT gd) AS n, bool_and(p IS NOT NULL AND wr IS NOT NULL) AS whole, list({{'sw': 0e0, 'aet': 0e0, 'wr': wr, 'p': p, 'cap': 0e0}} ORDER BY gd) AS s
                FROM ({rows}) {join} GROUP BY ALL))"""


def stepwise_sql(planting: str, p: CropParams, ss: int, se: int, extra: int, col: str = "planting", whc_from: str = "") -> str:
    """Body of a WITH RECURSIVE: ``run`` holds one row per season and dekad with its AET."""
    lo, hi = max(1, ss - 1), se + p.lgp + extra
    whc = f"SELECT * FROM (@) JOIN ({whc_from}) USING (px_id)" if whc_from else "SELECT *, 100e0 AS whc_mm FROM (@)"
    return f"""
    srow AS MATERIALIZED ({whc.replace('@', season_sql(planting, p, lo, hi, col))}),
    run AS (
      SELECT px_id, year, gd, dsp, p, wr, least(p, wr) AS aet, greatest(least(p - least(p, wr), whc_mm), 0e0) AS sw FROM srow WHERE gd = {lo}
      UNION ALL
      SELECT s.px_id, s.year, s.gd, s.dsp, s.p, s.wr, least(r.sw + s.p, s.wr),
             greatest(least(r.sw + s.p - least(r.sw + s.p, s.wr), s.whc_mm), 0e0)
      FROM run r JOIN srow s ON s.px_id = r.px_id AND s.year = r.year AND s.gd = r.gd + 1)"""


def staged_sql(p: CropParams, ss: int = 7, se: int = 15) -> str:
    """Staged results from ``run``, NULL where it does not reach the last dekad; wrsi of a stage is 0 when its
    snapshot dekad is outside."""
    whole = f"count(aet) = {se + p.lgp + 2 - max(1, ss - 1) + 1}"
    b = {"veg": (0, p.veg_end), "flo": (p.veg_end, p.flo_end), "grf": (p.flo_end, p.lgp)}
    cols = []
    for s, (lo, hi) in b.items():
        on = f"dsp >= {lo} AND dsp < {hi}"
        cols += [f"coalesce(max(CASE WHEN dsp = {hi} THEN cum_aet / greatest(cum_wr, 1e-6) * 100 END), 0) AS wrsi_{s}",
                 f"coalesce(max(CASE WHEN {on} THEN ({clamp('1 - aet / greatest(wr, 1e-6)', '0', '1')}) * 100 END), 0) AS wsi_{s}",
                 f"coalesce(sum(CASE WHEN {on} THEN aet END), 0) AS aet_{s}", f"coalesce(sum(CASE WHEN {on} THEN wr END), 0) AS wr_{s}"]
    return f"""
    SELECT px_id, year, {', '.join(_when(whole, c) for c in cols)}, CAST({whole} AS INTEGER) AS complete FROM (
      SELECT *, sum(aet) OVER w AS cum_aet, sum(wr) OVER w AS cum_wr FROM run WINDOW w AS (PARTITION BY px_id, year ORDER BY gd)) GROUP BY ALL"""


def _when(cond: str, column: str) -> str:
    value, name = column.rsplit(" AS ", 1)
    return f"CASE WHEN {cond} THEN {value} END AS {name}"
