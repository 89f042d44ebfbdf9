"""The derived input tables as SQL, mirroring ``inputs.py`` column for column.

The supplied tables carry no climate, so daily rain, observations, soil layers, grids and admin
pixels are derived from them by integer and dyadic arithmetic that both engines evaluate exactly.
Order matters: a view may only read earlier ones.
"""
from __future__ import annotations

MONTH_LIST = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def dk(d: str) -> str:
    return f"CAST((month({d})-1)*3 + least(3, (day({d})-1)//10 + 1) AS INTEGER)"


def start(year: str, k: str) -> str:
    """First day of a (possibly > 36) dekad."""
    return (f"make_date(CAST({year} + (({k})-1)//36 AS INTEGER), CAST(((({k})-1)%36)//3 + 1 AS INTEGER), "
            f"CAST(((({k})-1)%3)*10 + 1 AS INTEGER))")


def label(k: str) -> str:
    r = f"CAST(round_even({k}, 0) AS INTEGER)"
    return (f"CAST({r} AS VARCHAR) || '·' || {MONTH_LIST}[(({r}-1)%36)//3 + 1] || "
            f"CASE WHEN {r} > 36 THEN '+1y' ELSE '' END")


def clamp(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"


def unit(x: str, lo: str, hi: str) -> str:
    return clamp(f"(({x}) - {lo}) / ({hi} - {lo})", "0e0", "1e0")


def ra(lat: str, doy: str) -> str:
    b = f"(({doy}) * (2 * pi() / 365e0))"
    decl = f"(409e-3 * sin({b} - 139e-2))"
    la = f"radians({lat})"
    ws = f"acos(least(greatest(-tan({la}) * tan({decl}), -1e0), 1e0))"
    return (f"((24 * 60 / pi()) * 82e-3 * (1 + 33e-3 * cos({b})) * ({ws} * sin({la}) * sin({decl}) "
            f"+ cos({la}) * cos({decl}) * sin({ws})) * 408e-3)")


def kc(dsp: str, p) -> str:
    d1, d2, d3 = p.l_ini, p.l_ini + p.l_dev, p.l_ini + p.l_dev + p.l_mid
    return (f"(CASE WHEN {dsp} < 0 OR {dsp} >= {p.lgp} THEN 0e0 WHEN {dsp} < {d1} THEN {p.kc_ini}::DOUBLE "
            f"WHEN {dsp} < {d2} THEN {p.kc_ini}::DOUBLE + ({dsp} - {d1}) / {p.l_dev}::DOUBLE * ({p.kc_mid}::DOUBLE - {p.kc_ini}::DOUBLE) "
            f"WHEN {dsp} < {d3} THEN {p.kc_mid}::DOUBLE "
            f"ELSE {p.kc_mid}::DOUBLE + ({dsp} - {d3}) / {p.l_late}::DOUBLE * ({p.kc_end}::DOUBLE - {p.kc_mid}::DOUBLE) END)")


def wrsi_class(w: str) -> str:
    return (f"CASE WHEN {w} < 50 THEN 1 WHEN {w} < 60 THEN 2 WHEN {w} < 80 THEN 3 WHEN {w} < 95 THEN 4 "
            f"WHEN {w} >= 95 THEN 5 END")


# distance-to-peak greenness level 0..18 of a date (peak at dekad 15)
def level(d: str) -> str:
    return f"(18 - least(abs({dk(d)} - 15), 36 - abs({dk(d)} - 15)))"


AEZ_CODES = "['UM4','LM5','LH2','UHO','IL6','CL5','TA1','UM2-3','LAKE','LM3']"

VIEWS: dict[str, str] = {
    "v_grid": """
        SELECT s_suppkey AS px_id, ((s_suppkey*37)%160)/8e0 - 5e0 AS lat, 33e0 + ((s_suppkey*53)%128)/16e0 AS lon,
               CAST((s_suppkey*131)%2600 AS DOUBLE) AS elev_m FROM supplier""",
    "v_dekad_spine": """
        SELECT px_id, CAST(y.v AS INTEGER) AS year, CAST(k.v AS INTEGER) AS dekad
        FROM v_grid, (SELECT unnest(range(1995, 2002)) AS v) y, (SELECT unnest(range(1, 37)) AS v) k""",
    "v_rain_records": """
        SELECT l_suppkey AS px_id, CAST(l_shipdate AS DATE) AS d,
               l_quantity * (CASE WHEN month(l_shipdate) IN (3,4,5,10,11,12) THEN 2 + (l_suppkey + month(l_shipdate)) % 3
                             ELSE (l_suppkey + month(l_shipdate)) % 2 END) * 25e-2 AS rain_mm FROM lineitem""",
    "v_rain_rows": f"""
        SELECT px_id, d, rain_mm FROM v_rain_records
        UNION ALL SELECT px_id, {start('year', 'dekad')}, 0e0 FROM v_dekad_spine""",
    "v_rain_daily": "SELECT px_id, d, sum(rain_mm) AS rain_mm FROM v_rain_records GROUP BY px_id, d",
    "v_rain_record": """
        SELECT px_id, d, CASE WHEN (px_id*7 + dayofyear(d)*3 + year(d)) % 331 <> 0 THEN coalesce(rain_mm, 0e0) END AS rain_mm
        FROM (SELECT px_id, d FROM v_grid, (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d))
        LEFT JOIN v_rain_daily USING (px_id, d) WHERE (px_id + dayofyear(d) + year(d)*5) % 613 <> 0""",
    "v_rain": f"""
        SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, sum(rain_mm) AS p
        FROM v_rain_rows GROUP BY ALL""",
    "v_temps_daily": """
        SELECT px_id, d, 303e0 + ((px_id*7 + dayofyear(d)*3) % 25) * 25e-2 AS tmax_k,
               288e0 + ((px_id*5 + dayofyear(d)) % 17) * 25e-2 AS tmin_k
        FROM v_grid, (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
        UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), 301e0 + (CAST(l_quantity AS INTEGER) % 40) * 25e-2, 286e0 + (CAST(l_quantity AS INTEGER) % 24) * 25e-2
        FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '2002-01-01'""",
    "v_temps": f"""
        SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, avg(tmax_k) - 273.15::DOUBLE AS tmax_c,
               avg(tmin_k) - 273.15::DOUBLE AS tmin_c FROM v_temps_daily GROUP BY ALL""",
    "v_climate": f"""
        SELECT t.px_id, t.year, t.dekad, r.p, t.tmax_c, t.tmin_c, g.lat, g.elev_m,
               23e-4 * {ra('g.lat', "dayofyear(" + start('t.year', 't.dekad') + ") + 5")}
               * ((tmax_c + tmin_c)/2 + 178e-1) * sqrt(greatest(tmax_c - tmin_c, 0e0))
               * date_diff('day', {start('t.year', 't.dekad')}, {start('t.year', '(t.dekad+1)')}) AS et0
        FROM v_temps t JOIN v_rain r USING (px_id, year, dekad) JOIN v_grid g USING (px_id)""",
    "v_optical": f"""
        SELECT l_suppkey AS px_id, CAST(l_shipdate AS DATE) AS d, 500 + l_partkey%300 AS b3,
               700 + l_partkey%400 - 15*{level('l_shipdate')} AS b4, 900 + l_partkey%300 AS b5,
               1000 + 70*{level('l_shipdate')} + l_orderkey%400 AS b6,
               1150 + 70*{level('l_shipdate')} + l_orderkey%400 + l_orderkey%200 AS b7,
               1350 + 70*{level('l_shipdate')} + l_orderkey%400 + l_orderkey%200 AS b8,
               1400 + 70*{level('l_shipdate')} + l_orderkey%400 + l_orderkey%200 AS b8a,
               1500 + l_orderkey%500 AS b11, 1000 + l_partkey%500 AS b12, l_tax*125e-1 AS cs_cdf
        FROM lineitem""",
    "v_indices": """
        SELECT px_id, d, (b8-b4)/(b8+b4) AS ndvi, 25e-1*(b8-b4)/(b8+24e-1*b4+1) AS evi2, (b6-b5)/(b6+b5) AS ndre1,
               (b7-b5)/(b7+b5) AS ndre2, (b8a-b5)/(b8a+b5) AS rendvi, b7/b5 - 1 AS cire
        FROM (SELECT px_id, d, b4/1e4 AS b4, b5/1e4 AS b5, b6/1e4 AS b6, b7/1e4 AS b7, b8/1e4 AS b8, b8a/1e4 AS b8a
              FROM v_optical WHERE cs_cdf >= 6e-1)""",
    "v_s2": f"""
        SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, quantile_cont(ndvi, 0.5) AS ndvi, quantile_cont(evi2, 0.5) AS evi2,
               quantile_cont(ndre1, 0.5) AS ndre1, quantile_cont(ndre2, 0.5) AS ndre2,
               quantile_cont(rendvi, 0.5) AS rendvi, quantile_cont(cire, 0.5) AS cire
        FROM v_indices GROUP BY ALL""",
    "v_sar": f"""
        SELECT l_suppkey AS px_id, CAST(l_shipdate AS DATE) AS d, -14e0 + (l_quantity % 16) * 25e-2 AS vv_db,
               -28e0 + (l_quantity % 16) * 25e-2 + {level('l_shipdate')} * 25e-2 AS vh_db,
               CASE WHEN l_linenumber <= 6 THEN 'IW' ELSE 'EW' END AS instrument_mode,
               CASE WHEN l_returnflag = 'R' THEN ['VV'] ELSE ['VV','VH'] END AS polarisations,
               CASE WHEN l_linestatus = 'F' THEN 'DESCENDING' ELSE 'ASCENDING' END AS orbit FROM lineitem""",
    "v_s1": f"""
        SELECT s.px_id, s.year, s.dekad, vv, vh, vh_vv, rvi FROM v_dekad_spine s LEFT JOIN (
          SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, avg(vv) AS vv, avg(vh) AS vh,
                 avg(vh/vv) AS vh_vv, avg(4*vh/(vv+vh)) AS rvi
          FROM (SELECT px_id, d, pow(1e1, vv_db/1e1) AS vv, pow(1e1, vh_db/1e1) AS vh FROM v_sar
                WHERE instrument_mode = 'IW' AND orbit = 'DESCENDING' AND list_contains(polarisations, 'VV')
                  AND list_contains(polarisations, 'VH')) GROUP BY ALL) c USING (px_id, year, dekad)""",
    "v_fpar_obs": f"""
        SELECT l_suppkey AS px_id, CAST(l_shipdate AS DATE) AS d, 10 + 3*{level('l_shipdate')} + l_linenumber AS raw
        FROM lineitem""",
    "v_fpar": f"""
        SELECT px_id, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad, avg(raw) * 1e-2 AS fpar
        FROM v_fpar_obs GROUP BY ALL""",
    "v_g": f"""
        SELECT px_id, year, dekad, coalesce(({unit('ndre1', '0e0', '7e-1')} + {unit('fpar', '0e0', '9e-1')}) / 2,
               {unit('rvi', '1e-1', '8e-1')}) AS g
        FROM v_s1 LEFT JOIN v_s2 USING (px_id, year, dekad) LEFT JOIN v_fpar USING (px_id, year, dekad)""",
    "v_ndvi_obs": f"""
        SELECT l_suppkey AS px_id, CAST(l_shipdate AS DATE) AS d, 3000 + 250*{level('l_shipdate')} + l_orderkey%900 AS raw
        FROM lineitem""",
    "v_pheno": """
        SELECT px_id, CAST(year AS INTEGER) AS year, CAST(c.cycle AS INTEGER) AS cycle,
               CAST(CASE WHEN tot % 7 = 0 THEN 32767
                    ELSE date_diff('day', DATE '1970-01-01', make_date(CAST(year AS INTEGER),1,1)) + 60 + tot % 90 + (c.cycle-1)*180 END AS INTEGER) AS greenup_days
        FROM (SELECT l_suppkey AS px_id, year(l_shipdate) AS year, CAST(sum(l_quantity) AS BIGINT) AS tot
              FROM lineitem GROUP BY ALL), (SELECT unnest([1,2]) AS cycle) c""",
    "v_mask": """
        SELECT s_suppkey AS px_id, 'maize' AS product, CASE WHEN (s_suppkey*7)%10 < 8 THEN 100 ELSE 0 END AS classification FROM supplier
        UNION ALL SELECT s_suppkey, 'temporarycrops', CASE WHEN (s_suppkey*3)%10 < 9 THEN 100 ELSE 0 END FROM supplier""",
    "v_soil": """
        SELECT p_partkey // 20 AS px_id, [0,5,15,30,60,100][p_partkey%6 + 1] AS top_cm, [5,15,30,60,100,200][p_partkey%6 + 1] AS bot_cm,
               avg(120 + (p_partkey*11)%250 + p_size) AS clay_gkg, avg(250 + (p_partkey*7)%350) AS sand_gkg,
               avg(60 + p_size*2) AS soc_dgkg FROM part GROUP BY ALL""",
    "v_nodes": """
        SELECT p_partkey // 20 AS px_id, [0,10,30,60,100,200][p_partkey%6 + 1] AS depth_cm,
               avg(25 + p_size%15) AS fc_vol_pct, avg(8 + p_size%7) AS wp_vol_pct FROM part GROUP BY ALL""",
    "v_pixels": f"""
        SELECT o_orderkey AS px_id, r_name AS county, n_name AS constituency, n_name || '-W' || (c_custkey % 5) AS name,
               CAST(year(o_orderdate) AS INTEGER) AS year, {AEZ_CODES}[c_custkey % 10 + 1] AS aez,
               CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE {dk('o_orderdate')} END AS planting,
               {dk('o_orderdate')} AS planting_all, tp % 108 AS wrsi, (tp % 300) * 5e-1 AS deficit_mm,
               {wrsi_class('(tp % 108)')} AS wrsi_class, ((tp % 57) - 28) / 8e0 AS spi3,
               (tp*3 + o_orderkey) % 111 AS wrsi_veg, (tp*5 + o_orderkey) % 111 AS wrsi_flo, (tp*7 + o_orderkey) % 111 AS wrsi_grf,
               (tp*3 + 7*o_orderkey) % 111 AS wsi_veg, (tp*5 + 7*o_orderkey) % 111 AS wsi_flo, (tp*7 + 3*o_orderkey) % 111 AS wsi_grf,
               (tp*11 + o_orderkey) % 111 AS cpi, (tp*13 + o_orderkey) % 111 AS s_water, (tp*17 + o_orderkey) % 111 AS s_heat,
               (tp*19 + o_orderkey) % 111 AS s_veg, (tp*13 + o_orderkey) % 1700 AS yield_tha_x100,
               1 + (tp + o_orderkey) % 60 AS peak_vegetative_dekad, 1 + (tp + 3*o_orderkey) % 60 AS flowering_dekad,
               1 + (tp + 5*o_orderkey) % 60 AS grain_filling_dekad, 1 + (tp + 7*o_orderkey) % 60 AS maturity_dekad,
               (tp*17) % 60 AS lvpd, (tp*19) % 101 AS waterlog_idx, CASE WHEN tp % 3 = 0 THEN 1 ELSE 0 END AS false_start,
               CASE WHEN tp % 4 = 0 THEN 1 ELSE 0 END AS spi3_wet, (tp*23) % 115 AS fcci
        FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS tp FROM orders) o
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "v_hist": """
        SELECT county, constituency, name, CAST(planting AS INTEGER) AS dekad, count(*) AS n FROM v_pixels
        WHERE planting BETWEEN 1 AND 36 GROUP BY ALL""",
    "v_cells": """
        SELECT p_partkey AS px_id, CAST(p_partkey // 64 AS INTEGER) AS row, CAST(p_partkey % 64 AS INTEGER) AS col,
               33e0 + (p_partkey % 64 + 5e-1) * 125e-3 AS lon, 55e-1 - (p_partkey // 64 + 5e-1) * 125e-3 AS lat,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 4e1 END AS elev_m FROM part""",
    "v_edges": """
        SELECT seq, 33e0 + (x1 + 5e-1) * 125e-3 AS x1, 55e-1 - (y1 + 5e-1) * 125e-3 AS y1,
               33e0 + (x2 + 5e-1) * 125e-3 AS x2, 55e-1 - (y2 + 5e-1) * 125e-3 AS y2 FROM (
          SELECT seq, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM (
            SELECT s_suppkey AS seq, [cx - hw, cx, cx + hw, cx + 25e-2] AS xs, [cy, cy - hh, cy, cy + hh] AS ys
            FROM (SELECT s_suppkey, (s_suppkey*20)%64 AS cx, (s_suppkey*20)//64 AS cy, 225e-2 + (s_suppkey%4)*5e-1 AS hw,
                         175e-2 + (s_suppkey%3)*5e-1 AS hh FROM supplier)
            UNION ALL
            SELECT s_suppkey, [cx - 75e-2, cx - 75e-2, cx + 75e-2, cx + 75e-2], [cy - 75e-2, cy + 75e-2, cy + 75e-2, cy - 75e-2]
            FROM (SELECT s_suppkey, (s_suppkey*20)%64 AS cx, (s_suppkey*20)//64 AS cy FROM supplier WHERE s_acctbal > 5000)
          ), (SELECT unnest([1,2,3,4]) AS i))""",
    "v_fine": f"""
        SELECT l_partkey AS px_id, {dk('l_shipdate')} AS dekad,
               avg(13/64e0 + {level('l_shipdate')}/64e0 + (l_quantity % 8)/128e0) AS f FROM lineitem GROUP BY ALL""",
    "v_coarse": f"""
        SELECT CAST((l_partkey//64)//4 AS INTEGER) AS row, CAST((l_partkey%64)//4 AS INTEGER) AS col, {dk('l_shipdate')} AS dekad,
               avg(15/64e0 + {level('l_shipdate')}/64e0 + l_linenumber/128e0) AS c FROM lineitem GROUP BY ALL""",
    "v_fc": """
        SELECT c.px_id, c.row, c.col, k.dekad, f.f, o.c
        FROM v_cells c, (SELECT CAST(unnest(range(1, 37)) AS INTEGER) AS dekad) k
        LEFT JOIN v_fine f ON f.px_id = c.px_id AND f.dekad = k.dekad
        LEFT JOIN v_coarse o ON o.row = c.row//4 AND o.col = c.col//4 AND o.dekad = k.dekad""",
    "v_forecast": """
        SELECT px_id, d, ((px_id*3 + day(d)) % 7) * 5e-1 AS rain_mm
        FROM v_grid, (SELECT CAST(unnest(generate_series(DATE '1999-04-01', DATE '1999-04-30', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "v_calendar": f"""
        SELECT s_suppkey, n_name AS country, ['maize','Wheat','teff'][s_suppkey%3 + 1] AS crop, 'S' || (s_suppkey % 2) AS season,
               ['High','Medium','Low','None'][s_suppkey%4 + 1] AS crop_viability,
               {MONTH_LIST}[(s_suppkey*5)%12 + 1] || '-d' || (s_suppkey%3 + 1) || '-' || {MONTH_LIST}[(s_suppkey*5 + 2)%12 + 1] || '-d' || ((s_suppkey*2)%3 + 1) AS indicative_planting_window,
               {MONTH_LIST}[(s_suppkey*5)%12 + 1] || '-d' || (s_suppkey%3 + 1) || '-' || {MONTH_LIST}[(s_suppkey*5 + 3)%12 + 1] || '-d' || ((s_suppkey*2)%3 + 1) AS sos_detection_window
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "v_files": """
        SELECT 'planting_' || replace(n_name, '_', '') || '_maize_' || CASE WHEN month(o_orderdate) <= 6 THEN 'Longrains' ELSE 'Shortrains' END || '_' || year(o_orderdate) AS base,
               o_orderkey, o_orderdate AS mtime, o_orderkey % 4 AS ver
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "v_tiles": f"""
        SELECT l_linenumber AS tile_seq, CAST(l_partkey//64 AS INTEGER) AS row, CAST(l_partkey%64 AS INTEGER) AS col,
               max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE {dk('l_shipdate')} END) AS planting,
               max(CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS INTEGER) - 25 END) AS anom
        FROM lineitem GROUP BY ALL""",
    # rainfall onset (25/20 with the P/PET gate, window 7..15) and the planting it stands for
    "v_onset": """
        SELECT px_id, year, min(CASE WHEN p >= 25 AND p1 + p2 >= 20 AND p / greatest(et0, 1e-3) >= 5e-1 AND dekad <= 13 THEN dekad END) AS onset
        FROM (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM v_climate WHERE dekad BETWEEN 7 AND 15
              WINDOW w AS (PARTITION BY px_id, year ORDER BY dekad)) GROUP BY ALL""",
    # greenness season start (window 7..15)
    "v_sos": """
        SELECT px_id, year, min(CASE WHEN g >= lo + (hi - lo) * 25e-2 AND nxt - g > 0 THEN dekad END) AS sos, any_value(hi - lo) AS amp
        FROM (SELECT *, min(g) OVER w AS lo, max(g) OVER w AS hi, lead(g) OVER (PARTITION BY px_id, year ORDER BY dekad) AS nxt
              FROM v_g WHERE dekad BETWEEN 7 AND 15 WINDOW w AS (PARTITION BY px_id, year)) GROUP BY ALL""",
    "v_clim": f"SELECT px_id, dekad, avg(p) AS p FROM v_rain WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL",
    "v_ratio": "SELECT px_id, dekad, avg(p) AS p, avg(et0) AS et0 FROM v_climate WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL",
}
