import json
import os

import pytest
from pyspark.sql import functions as F

from seasonlens.config import CROPS, EARLY_STAGES, MAIZE_EARLY
from seasonlens.sources import calendars as CA, products as PR, sinks as SK, tables as TB


def test_calendar_round_trip(spark, tmp_path):
    p = tmp_path / "cal.csv"
    p.write_text("country,crop,season,crop_viability,indicative_planting_window,sos_detection_window\n"
                 "Kenya,Maize,Long rains,High,Mar-d2-Apr-d3,Mar-d3-May-d3\n"
                 "Kenya,Wheat,Long rains,Low,Mar-d2-Apr-d3,Mar-d3-May-d3\n"
                 "Kenya,Maize,Short rains,Medium,Oct-d1-Nov-d2,Nov-d2-Jan-d1\n")
    cal = CA.with_windows(CA.viable_products(CA.read_calendar(spark, str(p)), "Kenya", "maize"))
    got = {r.season: (r.sos_start, r.sos_end, r.win_start, r.win_end) for r in cal.collect()}
    assert got == {"Long rains": (9, 15, 8, 12), "Short rains": (32, 37, 28, 32)}


def test_variety_override(spark):
    early = spark.createDataFrame([("maize", *EARLY_STAGES.values())], "crop string, " + ", ".join(f"{k} int" for k in EARLY_STAGES))
    got = {r.crop: r for r in CA.with_variety(CA.crop_table(spark), early).collect()}
    assert got["maize"].lgp == MAIZE_EARLY.lgp and got["maize"].kc_mid == 1.2 and got["teff"].lgp == CROPS["teff"].lgp


def test_newest_file_wins(spark, tmp_path):
    for i, n in enumerate(("wrsi.tif", "wrsi (2).tif", "wrsi (1).tif", "other-0000-0001.tif", "other-0000-0000.tif")):
        (tmp_path / n).write_text("x")
        os.utime(tmp_path / n, (1_700_000_000 + i, 1_700_000_000 + i))
    files = PR.list_files(spark, str(tmp_path), "*.tif")
    names = files.withColumn("file", F.replace("file", F.lit("%20"), F.lit(" ")))
    assert {r.base: r.file for r in PR.newest_version(names).collect()}["wrsi"] == "wrsi (1).tif"
    tiles = {r["product"]: (r.n_tiles, r.last_tile) for r in PR.group_tiles(names).collect()}
    assert tiles["other"] == (2, "other-0000-0001.tif")


def test_product_label(spark):
    d = spark.createDataFrame([("planting_Kenya_maize_Longrains_2024_stats.csv",), ("notes.csv",)], "file string")
    got = [tuple(r)[1:] for r in PR.product_label(d).collect()]
    assert got == [("Kenya", "maize", "Longrains", 2024, "Maize · Longrains · 2024"), (None, None, "?", None, "notes.csv")]


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2.0)], "px_id int, whc_mm double")

    path = str(tmp_path / "whc")
    for _ in range(2):
        assert TB.materialize(spark, path, build).count() == 1
    assert len(calls) == 1


def test_int16_storage(spark):
    r = spark.range(1).select(SK.to_int16(F.lit(4.567), 100.0), SK.to_int16(F.lit(-1.9)), SK.to_int16(F.lit(1e9)), SK.to_int16(F.lit(None).cast("double"))).first()
    assert tuple(r) == (456, -1, 32767, None)


def test_raster_partitions_prune(spark, tmp_path):
    d = spark.createDataFrame([(i, "p", 2000 + i % 3, i) for i in range(30)], "px_id int, product string, year int, v int")
    path = str(tmp_path / "r")
    SK.write_raster(d, path)
    s = TB.scan(spark, path, years=[2001])
    assert s.count() == 10 and "PartitionFilters: [isnotnull(year" in s._jdf.queryExecution().toString()


def test_wkt(spark):
    d = spark.createDataFrame([(36.5, -1.25, 9), (36.5, -1.25, 0)], "lon double, lat double, planting int")
    p = SK.pixel_wkt(d, ["planting"], geometry="point").collect()
    assert len(p) == 1 and p[0].geometry_wkt == "POINT (36.5 -1.25)" and p[0].dekad_label == "9·Mar"
    q = SK.pixel_wkt(d, ["planting"], res=0.5).first().geometry_wkt
    assert q == "POLYGON ((36.25 -1.5, 36.75 -1.5, 36.75 -1.0, 36.25 -1.0, 36.25 -1.5))"


def test_documents(spark):
    d = spark.createDataFrame([("k", 3, "C", "S", "W", 1.23456, float("nan"))], "product string, level int, county string, constituency string, name string, a double, b double")
    doc = json.loads(SK.product_documents(d, {"a": "x", "b": "y"}).first().doc)
    assert doc == {"product": "k", "level": 3, "units": [{"n": "W", "p": "C", "c": "S", "a": {"x": 1.235, "y": None}}]}
    w = spark.createDataFrame([("NAIROBI", "UPPER HILL", 9, 8, None, 12)], "county string, ward string, obs int, est int, farmers int, n_px int")
    r = SK.ward_documents(w).first()
    assert r.county == "Nairobi" and json.loads(r.doc) == {"Upper Hill": {"obs": 9, "est": 8, "err": -1, "farmers": 0, "n_px": 12}}


def test_shared_dir_reads_the_session():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.value or default

    local = type("C", (), {"master": "local[2]"})
    session = lambda v: type("S", (), {"conf": Conf(v), "sparkContext": local})()
    assert TB.new_path(session("hdfs://shared/work/"), "x").startswith("hdfs://shared/work/x-")
    assert TB.shared_dir(session(None)) == TB.shared_dir(session(None))


def test_rasters_are_few_files_and_half_written_tables_are_rebuilt(spark, tmp_path):
    rows = spark.range(4000, numPartitions=16).selectExpr("id AS px_id", "'p' AS product", "CAST(2000 + id % 2 AS INT) AS year")
    SK.write_raster(rows, str(tmp_path / "r"), files=3)
    folders = list((tmp_path / "r" / "product=p").iterdir())
    assert len(folders) == 2 and all(len(list(f.glob("part-*.parquet"))) <= 3 for f in folders)
    path, built = str(tmp_path / "t"), []
    make = lambda: built.append(1) or spark.range(5)
    assert TB.materialize(spark, path, make).count() == 5 and TB.materialize(spark, path, make).count() == 5 and len(built) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()                               # as after a writer lost in its commit
    assert TB.materialize(spark, path, make).count() == 5 and len(built) == 2


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})
    with pytest.raises(ValueError):
        TB.shared_dir(Session)


def test_large_numbers_of_a_document_have_no_exponent(spark):
    import json

    from seasonlens.sources import sinks as SK
    vals = [("a", 19283746.5), ("b", 12.0), ("c", 0.25), ("d", float("nan")), ("e", None), ("f", -1234567890123.0), ("g", 10.0), ('h"}', 1.0004), ("i", 1e8), ("j", 1e20)]
    rows = spark.createDataFrame([(1999, 1, n, None, None, v) for n, v in vals], "product int, level int, name string, county string, constituency string, v double")
    doc, = [r["doc"] for r in SK.product_documents(rows, {"v": "x"}).collect()]
    assert doc.startswith('{"product":1999,"level":1,"units":[{"n":"a","p":"","c":"","a":{"x":19283746.5}},')
    texts = [u.split('"x":')[1].split("}")[0] for u in doc.split('"a":{')[1:]]
    assert texts == ["19283746.5", "12.0", "0.25", "null", "null", "-1234567890123.0", "10.0", "1.0", "100000000.0", "100000000000000000000.0"]
    assert [u["n"] for u in json.loads(doc)["units"]] == [n for n, _ in vals]
