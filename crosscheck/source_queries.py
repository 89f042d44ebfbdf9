"""Scans, sources, sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.time_queries import WINDOW_SQL
from crosscheck.util import rounded
from crosscheck.views import label
from seasonlens.config import EARLY_STAGES
from seasonlens.operators import observations as OB, soil as SO, spatial as SP
from seasonlens.sources import calendars as CA, products as PR, sinks as SK, tables as TB


@query("src1_season_calendar", f"""
    SELECT country, crop, season, count(*) AS n, min(sos_start) AS first_start, max(sos_end) AS last_end
    FROM ({WINDOW_SQL}) GROUP BY ALL""")
def _(spark, sf):
    path = TB.new_path(spark, "calendar")
    cols = [c.split()[0] for c in CA.CALENDAR_SCHEMA.split(", ")]
    SK.write_table(I.calendar(spark, sf).select(*cols), path)
    return CA.with_windows(CA.read_calendar(spark, path)).groupBy("country", "crop", "season").agg(
        F.count(F.lit(1)).alias("n"), F.min("sos_start").alias("first_start"), F.max("sos_end").alias("last_end"))


@query("src2_viable_products", """
    SELECT * FROM v_calendar WHERE crop_viability IN ('High', 'Medium') AND lower(crop) = 'maize'""")
def _(spark, sf):
    return CA.viable_products(I.calendar(spark, sf), crop="Maize")


@query("src3_crop_parameters", """
    SELECT s_suppkey, c.crop, c.season, 9 AS lgp, 2 AS l_ini, 3 AS l_dev, 2 AS l_mid, 2 AS l_late, 3e-1 AS kc_ini, 12e-1 AS kc_mid, 35e-2 AS kc_end, 1e0 AS root_depth_m
    FROM v_calendar c WHERE lower(crop) = 'maize'
    UNION ALL SELECT s_suppkey, crop, season, 12, 3, 4, 3, 2, 4e-1, 115e-2, 35e-2, 1e0 FROM v_calendar WHERE lower(crop) = 'wheat'
    UNION ALL SELECT s_suppkey, crop, season, 9, 2, 3, 3, 1, 3e-1, 11e-1, 4e-1, 6e-1 FROM v_calendar WHERE lower(crop) = 'teff'""")
def _(spark, sf):
    early = spark.createDataFrame([("maize", *EARLY_STAGES.values())], "crop string, " + ", ".join(f"{k} int" for k in EARLY_STAGES))
    params = CA.with_variety(CA.crop_table(spark), early).withColumnRenamed("crop", "_crop")
    cal = I.calendar(spark, sf).select("s_suppkey", "crop", "season")
    return cal.join(F.broadcast(params), F.lower("crop") == F.col("_crop")).drop("_crop")  # three rows


@query("src4_scene_filter", """
    SELECT px_id, count(*) AS n, sum(vv_db) AS vv FROM v_sar
    WHERE d >= DATE '1998-01-01' AND d < DATE '1999-01-05' AND instrument_mode = 'IW' AND orbit = 'DESCENDING'
      AND list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH') GROUP BY ALL""")
def _(spark, sf):
    return OB.radar_scenes(OB.scenes_in_year(I.sar(spark, sf), 1998, "d")).groupBy("px_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vv_db").alias("vv"))


@query("src5_linked_band", """
    SELECT l.l_suppkey AS px_id, count(*) AS n, count(o.o_totalprice) AS linked, round(avg(o.o_totalprice), 4) AS score
    FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""")
def _(spark, sf):
    obs = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("px_id"), F.col("l_orderkey").alias("scene"))
    aux = I.table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("scene"), F.col("o_totalprice").alias("score"))
    return OB.link_band(obs, aux, ["scene"], ["score"]).groupBy("px_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("linked"), F.round(F.avg("score"), 4).alias("score"))


@query("src6_zone_selection", """
    SELECT s_suppkey AS zone_id, n_name AS country, r_regionkey AS level FROM supplier JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey WHERE n_name IN ('NATION_1', 'NATION_6', 'NATION_11') AND r_regionkey = 1""")
def _(spark, sf):
    s = I.table(spark, sf, "supplier").join(I.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    zones = s.select(F.col("s_suppkey").alias("zone_id"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("level"))
    return TB.select_zones(zones, [TB.boundary_name(c) for c in ("NATION_1", "NATION_6", "NATION_11")], 1)


@query("src7_tile_mosaic", """
    SELECT row, col, coalesce(arg_max(CASE WHEN planting > 0 THEN planting END, CASE WHEN planting > 0 THEN tile_seq END), 0) AS planting
    FROM v_tiles GROUP BY ALL""")
def _(spark, sf):
    return SP.mosaic(I.tiles(spark, sf), ["planting"])


@query("src7_multiband_mosaic", """
    SELECT a.row, a.col, coalesce(p.planting, 0) AS planting, coalesce(q.anom, 0) AS anom
    FROM (SELECT DISTINCT row, col FROM v_tiles) a
    LEFT JOIN (SELECT row, col, planting FROM v_tiles WHERE planting <> 0
               QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY tile_seq DESC) = 1) p USING (row, col)
    LEFT JOIN (SELECT row, col, anom FROM v_tiles WHERE anom <> 0
               QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY tile_seq DESC) = 1) q USING (row, col)""")
def _(spark, sf):
    return SP.mosaic(I.tiles(spark, sf), ["planting", "anom"], rule="nonzero")


@query("src8_newest_version", """
    SELECT base, file, CAST(mtime AS DATE) AS mtime FROM (SELECT base, base || CASE WHEN ver = 0 THEN '' ELSE ' (' || ver || ')' END || '.tif' AS file, mtime FROM v_files)
    QUALIFY row_number() OVER (PARTITION BY base ORDER BY mtime DESC, file DESC) = 1""")
def _(spark, sf):
    v = F.col("ver").cast("string")
    name = F.concat("base", F.when(F.col("ver") == 0, "").otherwise(F.concat(F.lit(" ("), v, F.lit(")"))), F.lit(".tif"))
    return PR.newest_version(I.files(spark, sf).select(name.alias("file"), "mtime")).withColumn("mtime", F.col("mtime").cast("date"))


@query("src9_tile_grouping", """
    SELECT base AS product, count(*) AS n_tiles, min(file) AS first_tile, max(file) AS last_tile FROM (
      SELECT base, base || '-' || lpad(CAST(ver AS VARCHAR), 10, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '.tif' AS file FROM v_files)
    GROUP BY ALL""")
def _(spark, sf):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    name = F.concat("base", F.lit("-"), pad("ver"), F.lit("-"), pad("o_orderkey"), F.lit(".tif"))
    return PR.group_tiles(I.files(spark, sf).select(name.alias("file")))


@query("src10_product_label", """
    SELECT o_orderkey, file, nullif(regexp_extract(file, 'planting_([A-Za-z]+)_([a-z]+)_([A-Za-z]+)_([0-9]{4})_stats', 1), '') AS country,
      CASE WHEN ok THEN 'maize' END AS crop, CASE WHEN ok THEN split_part(file, '_', 4) ELSE '?' END AS season,
      CASE WHEN ok THEN CAST(split_part(file, '_', 5) AS INTEGER) END AS year,
      CASE WHEN ok THEN 'Maize · ' || split_part(file, '_', 4) || ' · ' || split_part(file, '_', 5) ELSE file END AS label
    FROM (SELECT o_orderkey, replace(base, 'NATION', 'Nation') AS b0,
            CASE WHEN ver = 3 THEN base ELSE 'planting_' || split_part(split_part(base, '_', 2), 'ION', 1) || 'ION_maize_' || split_part(base, '_', 4) || '_' || split_part(base, '_', 5) || '_stats.csv' END AS file,
            ver <> 3 AS ok FROM v_files)""")
def _(spark, sf):
    f = I.files(spark, sf)
    # letters-only country so that the pattern can match; every fourth name stays foreign
    good = F.concat(F.regexp_replace("base", r"ION\d+_", "ION_"), F.lit("_stats.csv"))
    return PR.product_label(f.select("o_orderkey", F.when(F.col("ver") == 3, F.col("base")).otherwise(good).alias("file")))


@query("snk1_raster_export", """
    SELECT px_id, year, county AS product, CASE WHEN wrsi_veg > 100 THEN NULL ELSE wrsi_veg END AS wrsi_veg, wrsi_flo, wrsi_grf, wsi_veg, wsi_flo, wsi_grf, cpi,
           CAST(trunc(cpi / 100e0 * 45e-1 * 100) AS INTEGER) AS yield_tha_x100, CAST(trunc(s_water / 128e0 * 100) AS INTEGER) AS s_water,
           CAST(trunc(s_heat / 128e0 * 100) AS INTEGER) AS s_heat, CAST(trunc(s_veg / 128e0 * 100) AS INTEGER) AS s_veg FROM v_pixels""")
def _(spark, sf):
    px = I.pixels(spark, sf).withColumns({
        "product": F.col("county"), "wrsi_veg": F.when(F.col("wrsi_veg") <= 100, F.col("wrsi_veg")),
        "yield_tha": F.col("cpi") / 100.0 * 4.5, "s_water": F.col("s_water") / 128.0,
        "s_heat": F.col("s_heat") / 128.0, "s_veg": F.col("s_veg") / 128.0})
    path = TB.new_path(spark, "raster")
    SK.write_raster(SK.cpi_stack(px, ["px_id", "product", "year"]), path)
    return spark.read.parquet(path)


@query("snk2_table_export", """
    SELECT constituency, count(*) AS n_px, round(avg(wrsi), 6) AS wrsi FROM v_pixels GROUP BY ALL""")
def _(spark, sf):
    rows = I.pixels(spark, sf).groupBy("constituency").agg(F.count(F.lit(1)).alias("n_px"), F.round(F.avg("wrsi"), 6).alias("wrsi"))
    path = TB.new_path(spark, "stats")
    SK.write_table(rows, path)
    return spark.read.csv(path, header=True, schema="constituency string, n_px long, wrsi double")


_FC = """(fct + (1283e-3*fct*fct - 374e-3*fct - 15e-3))"""
TEXTURE_SQL = f"""
    SELECT *, {_FC} AS fc, (wpt + (14e-2*wpt - 2e-2)) AS wp, (least(bot_cm, 100e0) - top_cm) * 10 AS th FROM (
      SELECT *, -251e-3*sa + 195e-3*cl + 11e-3*om + 6e-3*sa*om - 27e-3*cl*om + 452e-3*sa*cl + 299e-3 AS fct,
             -24e-3*sa + 487e-3*cl + 6e-3*om + 5e-3*sa*om - 13e-3*cl*om + 68e-3*sa*cl + 31e-3 AS wpt,
             278e-3*sa + 34e-3*cl + 22e-3*om - 18e-3*sa*om - 27e-3*cl*om - 584e-3*sa*cl + 78e-3 AS st FROM (
        SELECT px_id, top_cm, bot_cm, sand_gkg/1e3 AS sa, clay_gkg/1e3 AS cl, soc_dgkg/1e2*1724e-3 AS om FROM v_soil WHERE top_cm < 100))"""
WHC_SQL = f"SELECT px_id, greatest(sum(greatest(fc - wp, 0) * th), 25) AS whc_mm FROM ({TEXTURE_SQL}) GROUP BY px_id"


@query("snk3_materialized_capacity", f"SELECT px_id, round(whc_mm, 6) AS whc_mm FROM ({WHC_SQL})")
def _(spark, sf):
    path = TB.new_path(spark, "whc")
    build = lambda: SO.texture_whc(I.soil_layers(spark, sf))
    TB.materialize(spark, path, build)
    return rounded(TB.materialize(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("rebuilt"))), "whc_mm")


@query("snk4_pixel_points", f"""
    SELECT lon, lat, CAST(planting AS DOUBLE) AS planting, {label('planting')} AS dekad_label, 'POINT (' || lon || ' ' || lat || ')' AS geometry_wkt
    FROM (SELECT row, col, max(planting) AS planting FROM v_tiles GROUP BY ALL) t
    JOIN (SELECT row, col, round_even(lon, 6) AS lon, round_even(lat, 6) AS lat FROM v_cells) USING (row, col) WHERE planting BETWEEN 1 AND 36""")
def _(spark, sf):
    v = I.tiles(spark, sf).groupBy("row", "col").agg(F.max("planting").alias("planting"))
    return SK.pixel_wkt(I.cells(spark, sf).join(v, ["row", "col"]), ["planting"], geometry="point")


@query("snk4_pixel_squares", """
    SELECT lon, lat, CAST(elev AS DOUBLE) AS elev, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS geometry_wkt
    FROM (SELECT *, round_even(lon - 625e-4, 6) AS x0, round_even(lon + 625e-4, 6) AS x1, round_even(lat - 625e-4, 6) AS y0, round_even(lat + 625e-4, 6) AS y1
          FROM (SELECT round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, elev_m / 40 AS elev FROM v_cells)) WHERE elev > 0 AND elev <= 100""")
def _(spark, sf):
    c = I.cells(spark, sf).withColumn("elev", F.col("elev_m") / 40)
    return SK.pixel_wkt(c, ["elev"], kind="wrsi", res=0.125)


def _zones(spark, sf):
    z = I.pixels(spark, sf).select("county", "constituency", "name").distinct()
    wkt = lambda c: F.concat(F.lit("POINT ("), F.length(c).cast("string"), F.lit(" "), F.ascii(F.substring(c, -1, 1)).cast("string"), F.lit(")"))
    l3 = z.select(F.lit(3).alias("level"), "county", "constituency", "name", wkt("name").alias("wkt"))
    l1 = z.select(F.lit(1).alias("level"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("constituency"),
                  F.col("county").alias("name"), wkt("county").alias("wkt")).distinct()
    return l3.unionByName(l1)


@query("snk5_attach_geometry", """
    SELECT county, constituency, name, count(*) AS n_px, 'POINT (' || length(name) || ' ' || ascii(right(name, 1)) || ')' AS geometry_wkt
    FROM v_pixels GROUP BY ALL""")
def _(spark, sf):
    rows = I.pixels(spark, sf).groupBy("county", "constituency", "name").agg(F.count(F.lit(1)).alias("n_px"))
    return SK.attach_geometry(rows, _zones(spark, sf), 3)


@query("snk6_product_documents", """
    SELECT product, level, '{"product":' || product || ',"level":' || level || ',"units":[' || string_agg(u, ',' ORDER BY p || '|' || c || '|' || n) || ']}' AS doc FROM (
      SELECT product, level, p, c, n, '{"n":"' || n || '","p":"' || p || '","c":"' || c || '","a":{"n":' || CAST(CAST(n_px AS DOUBLE) AS VARCHAR) || ',"def":' ||
             CASE WHEN product = 1999 THEN 'null' ELSE CAST(round(d, 3) AS VARCHAR) END || '}}' AS u FROM (
        SELECT year AS product, 3 AS level, county AS p, constituency AS c, name AS n, count(*) AS n_px, sum(deficit_mm) AS d FROM v_pixels GROUP BY ALL
        UNION ALL SELECT year, 1, '', '', county, count(*), sum(deficit_mm) FROM v_pixels GROUP BY ALL)) GROUP BY product, level""")
def _(spark, sf):
    px = I.pixels(spark, sf).withColumn("product", F.col("year"))
    agg = [F.count(F.lit(1)).alias("n_px"), F.sum("deficit_mm").alias("d")]
    l3 = px.groupBy("product", "county", "constituency", "name").agg(*agg).withColumn("level", F.lit(3))
    l1 = px.groupBy("product", F.col("county").alias("name")).agg(*agg).withColumn("level", F.lit(1))
    rows = l3.unionByName(l1, allowMissingColumns=True).withColumn(
        "d", F.when(F.col("product") == 1999, F.lit(float("nan"))).otherwise(F.col("d")))
    return SK.product_documents(rows, {"n_px": "n", "d": "def"})


@query("snk7_ward_documents", """
    SELECT CASE WHEN county = 'MIDDLE EAST' THEN 'Middle East' ELSE upper(left(county, 1)) || lower(substr(county, 2)) END AS county, '{' || string_agg('"' || w || '":{"obs":' || obs || ',"est":' || est || ',"err":' || (est - obs) || ',"farmers":' || farmers || ',"n_px":' || n_px || '}', ',' ORDER BY w) || '}' AS doc
    FROM (SELECT county, 'Nation_' || substr(lower(name), 8) AS w, CAST(floor(avg(planting_all)) AS INTEGER) AS obs, min(planting) AS est, count(planting) AS farmers, count(*) AS n_px
          FROM v_pixels GROUP BY county, name) WHERE est IS NOT NULL GROUP BY county""")
def _(spark, sf):
    rows = I.pixels(spark, sf).groupBy("county", F.col("name").alias("ward")).agg(
        F.floor(F.avg("planting_all")).alias("obs"), F.min("planting").alias("est"), F.count("planting").alias("farmers"),
        F.count(F.lit(1)).alias("n_px"))
    return SK.ward_documents(rows)


@query("snk8_positional_bands", """
    SELECT px_id, CASE WHEN waterlog_idx > 0 THEN false_start END AS fs, CASE WHEN waterlog_idx > 0 THEN waterlog_idx END AS wl,
           CASE WHEN waterlog_idx > 0 THEN spi3_wet END AS wet FROM v_pixels""")
def _(spark, sf):
    px = I.pixels(spark, sf).select("px_id", "false_start", "waterlog_idx", "spi3_wet")
    return SK.rename_bands(px, ["px_id"], ["fs", "wl", "wet"], "wl")
