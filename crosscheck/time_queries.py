"""Dekad scalars and calendars."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.views import MONTH_LIST, dk, label, start
from seasonlens.functions import dekads as D
from seasonlens.operators import frames as FR, rainfall as RA
from seasonlens.sources.calendars import with_windows


@query("time1_date_to_dekad", f"SELECT o_orderkey, {dk('o_orderdate')} AS dekad FROM orders")
def _(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", D.date_to_dekad("o_orderdate").alias("dekad"))


@query("time2_dekad_start", f"""
    SELECT o_orderkey, year(o_orderdate) AS year, {dk('o_orderdate')} + 36 * (o_orderkey % 2) AS dekad,
           {start('year(o_orderdate)', f"({dk('o_orderdate')} + 36 * (o_orderkey % 2))")} AS start_date FROM orders""")
def _(spark, sf):
    k = D.date_to_dekad("o_orderdate") + 36 * (F.col("o_orderkey") % 2)
    return I.table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), k.alias("dekad"),
        D.dekad_start(F.year("o_orderdate"), k).alias("start_date"))


@query("time3_dekad_label", f"""
    SELECT o_orderkey, {label(f"({dk('o_orderdate')} + 36 * (o_orderkey % 2) + (o_orderkey % 4) / 4e0)")} AS label FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    v = D.date_to_dekad("o_orderdate") + 36 * (k % 2) + k % 4 / 4.0
    return I.table(spark, sf, "orders").select("o_orderkey", D.dekad_label(v).alias("label"))


def _tok(x: str) -> str:
    return f"(list_position({MONTH_LIST}, substr({x}, 1, 3)) - 1) * 3 + CAST(right({x}, 1) AS INTEGER)"


_S = "split_part(sos_detection_window,'-',1)||'-'||split_part(sos_detection_window,'-',2)"
_E = "split_part(sos_detection_window,'-',3)||'-'||split_part(sos_detection_window,'-',4)"
_PS, _PE = _S.replace("sos_detection", "indicative_planting"), _E.replace("sos_detection", "indicative_planting")
WINDOW_SQL = f"""
    SELECT *, CASE WHEN e0 < sos_start THEN e0 + 36 ELSE e0 END AS sos_end, CASE WHEN pe0 < win_start THEN pe0 + 36 ELSE pe0 END AS win_end
    FROM (SELECT *, {_tok('(' + _S + ')')} AS sos_start, {_tok('(' + _E + ')')} AS e0,
                 {_tok('(' + _PS + ')')} AS win_start, {_tok('(' + _PE + ')')} AS pe0 FROM v_calendar)"""


@query("time4_window_tokens", f"SELECT s_suppkey, sos_start, sos_end, win_start, win_end FROM ({WINDOW_SQL})")
def _(spark, sf):
    return with_windows(I.calendar(spark, sf)).select("s_suppkey", "sos_start", "sos_end", "win_start", "win_end")


@query("time5_dekad_days", f"""
    SELECT o_orderkey, date_diff('day', {start('year(o_orderdate)', dk('o_orderdate'))},
           {start('year(o_orderdate)', f"({dk('o_orderdate')}+1)")}) AS n_days FROM orders""")
def _(spark, sf):
    return I.table(spark, sf, "orders").select(
        "o_orderkey", D.dekad_days(F.year("o_orderdate"), D.date_to_dekad("o_orderdate")).alias("n_days"))


@query("time6_calendar_dekads", f"""
    SELECT l_suppkey AS px_id, year(l_shipdate) AS year, {dk('l_shipdate')} AS dekad, sum(l_quantity) AS v FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("px_id"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity")
    return FR.dekadal(rows, [F.sum("l_quantity").alias("v")])


@query("time6_fixed10_dekads", f"""
    SELECT l_suppkey AS px_id, y AS year, k AS dekad, sum(l_quantity) AS v
    FROM lineitem, (SELECT unnest(range(1994, 2002)) AS y) , (SELECT unnest(range(1, 37)) AS k)
    WHERE CAST(l_shipdate AS DATE) >= {start('y', 'k')} AND CAST(l_shipdate AS DATE) < {start('y', 'k')} + 10 GROUP BY ALL""")
def _(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("px_id"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity")
    return FR.dekadal(rows, [F.sum("l_quantity").alias("v")], mode="fixed10")


@query("time7_global_dekad", """
    SELECT px_id, year, dekad AS gd, p FROM v_rain WHERE dekad BETWEEN 28 AND 52 AND year BETWEEN 1995 AND 2000
    UNION ALL SELECT px_id, year - 1, dekad + 36, p FROM v_rain WHERE dekad + 36 BETWEEN 28 AND 52 AND year - 1 BETWEEN 1995 AND 2000""")
def _(spark, sf):
    """The seasons that the record holds whole: 1995 to 2000."""
    return FR.season_frame(I.rain(spark, sf), 28, 52, years=(1995, 2000))


@query("time8_greenup_dekad", """
    SELECT px_id, year, cycle, least(greatest(CAST(ceil((nullif(greenup_days, 32767)
           - date_diff('day', DATE '1970-01-01', make_date(year, 1, 1))) / 10139e-3) AS INTEGER), 1), 36) AS dekad
    FROM v_pheno WHERE greenup_days <> 32767
    UNION ALL SELECT px_id, year, cycle, NULL FROM v_pheno WHERE greenup_days = 32767""")
def _(spark, sf):
    return I.phenology(spark, sf).select("px_id", "year", "cycle", D.greenup_to_dekad("greenup_days", "year").alias("dekad"))


@query("time9_observed_date_dekad", """
    SELECT l_orderkey, l_linenumber, l_partkey, (month(l_shipdate)-1)*3 + CASE WHEN day(l_shipdate) <= 10 THEN 1
           WHEN day(l_shipdate) <= 20 THEN 2 ELSE 3 END AS dekad FROM lineitem""")
def _(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.date_to_dekad("l_shipdate").alias("dekad"))


@query("time10_three_month_total", """
    SELECT px_id, year, sum(rain_mm) AS p3 FROM (
      SELECT px_id, rain_mm, month(d) AS m, CASE WHEN month(d) > 1 THEN year(d) + 1 ELSE year(d) END AS year FROM v_rain_rows
      WHERE month(d) IN (11, 12, 1)) GROUP BY ALL HAVING count(DISTINCT m) = 3""")
def _(spark, sf):
    return RA.three_month_totals(I.rain_rows(spark, sf), 1, absent="dry").drop("coverage")


@query("time11_dense_days", """
    SELECT t.px_id, t.d, coalesce(r.rain_mm, 0) AS rain_mm FROM (SELECT DISTINCT px_id, d FROM v_temps_daily) t LEFT JOIN v_rain_daily r USING (px_id, d)""")
def _(spark, sf):
    spine = FR.day_spine(I.grid(spark, sf), "1995-01-01", "2001-12-31")
    return FR.densify(I.rain_daily(spark, sf), spine, ["px_id", "d"], {"rain_mm": 0.0})
