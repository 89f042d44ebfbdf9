"""Daily records with masked and missing days: totals, normals, index and gate that know what is known."""
from __future__ import annotations

from pyspark.sql import functions as F

from crosscheck import inputs as I
from crosscheck.registry import query
from crosscheck.util import rounded
from crosscheck.views import dk, start
from seasonlens.operators import onset as O, rainfall as RA

BY = ["px_id", "dekad"]
_END = f"({start('year', 'dekad + 1')})"
# complete dekads of single years
YEARLY = f"""
    SELECT px_id, dekad, year, CASE WHEN known = n THEN p END AS p, known / n AS coverage FROM (
      SELECT px_id, dekad, year, sum(rain_mm) AS p, count(rain_mm) AS known, date_diff('day', {start('year', 'dekad')}, {_END}) AS n
      FROM (SELECT px_id, rain_mm, CAST(year(d) AS INTEGER) AS year, {dk('d')} AS dekad FROM v_rain_record) GROUP BY ALL)"""
# March to May is 92 days in every year
TOTALS = """
    SELECT px_id, year, CASE WHEN known = 92 THEN p END AS p3, known / 92 AS coverage FROM (
      SELECT px_id, CAST(year(d) AS INTEGER) AS year, sum(rain_mm) AS p, count(rain_mm) AS known FROM v_rain_record WHERE month(d) IN (3, 4, 5) GROUP BY ALL)"""


def yearly(spark, sf, first, last):
    return RA.yearly_dekads(I.rain_record(spark, sf), (first, last))


@query("time10_coverage", f"SELECT px_id, year, p3, round(coverage, 6) AS coverage FROM ({TOTALS})")
def _(spark, sf):
    return rounded(RA.three_month_totals(I.rain_record(spark, sf), 5), "coverage")


@query("rain5_complete_dekads", f"SELECT px_id, dekad, year, p, round(coverage, 6) AS coverage FROM ({YEARLY}) WHERE year BETWEEN 1995 AND 2000")
def _(spark, sf):
    return rounded(yearly(spark, sf, 1995, 2000), "coverage")


@query("rain5_merged_normal", f"""
    SELECT px_id, dekad, count(p) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 4) AS sd FROM ({YEARLY}) WHERE year BETWEEN 1996 AND 2001 AND p IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """The normal of 1995-2000, with 2001 merged into it and 1995 taken out again."""
    stored = RA.moments(yearly(spark, sf, 1995, 2000), "p", BY)
    out = RA.update_climatology(stored, I.rain_record(spark, sf), 2001, drop=1995)
    out = out.select(*BY, "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("sd"))
    return rounded(rounded(out, "mean"), "sd", n=4)


@query("spi1_stored_normals", f"""
    WITH t AS MATERIALIZED ({TOTALS}),
    m AS (SELECT px_id, greatest(avg(p3), 1e-3) AS mu, greatest(stddev_pop(p3), 1e-3) AS sd FROM t WHERE year <= 2000 GROUP BY px_id HAVING count(p3) > 0)
    SELECT px_id, year, p3, CASE WHEN p3 IS NOT NULL THEN round(least(greatest((pow(p3 / mu, 1/3e0) - 1 + 1/a9) * sqrt(a9), -35e-1), 35e-1), 6) END AS spi3
    FROM (SELECT t.px_id, year, p3, mu, 9 * greatest(pow(mu / sd, 2), 1e-3) AS a9 FROM t LEFT JOIN m USING (px_id)) WHERE mu IS NOT NULL""")
def _(spark, sf):
    totals = RA.three_month_totals(I.rain_record(spark, sf), 5).drop("coverage")
    normals = RA.moments(totals.filter("year <= 2000"), "p3", ["px_id"])
    known = totals.join(normals.select("px_id"), "px_id", "left_semi")
    return rounded(RA.spi3_from_moments(known, normals), "spi3")


@query("gate3_unknown_days", f"""
    WITH days AS (SELECT px_id, year, onset, i, CAST({start('year', 'onset')} + CAST(i AS INTEGER) AS DATE) AS d
                  FROM v_onset, (SELECT unnest(range(0, 20)) AS i) WHERE onset IS NOT NULL),
    told AS (SELECT px_id, year, string_agg(CASE WHEN rain_mm IS NULL THEN 'u' WHEN rain_mm >= 1 THEN 'w' ELSE 'd' END, '' ORDER BY i) AS s,
                    coalesce(sum(CASE WHEN i < 5 THEN rain_mm END), 0) AS acc FROM days LEFT JOIN v_rain_record USING (px_id, d) GROUP BY ALL),
    runs AS (SELECT *, list_max(list_transform(string_split(replace(s, 'u', 'w'), 'w'), lambda x: length(x))) AS least,
                    list_max(list_transform(string_split(replace(s, 'u', 'd'), 'w'), lambda x: length(x))) AS most, instr(left(s, 5), 'u') > 0 AS open FROM told),
    said AS (SELECT *, CASE WHEN most <= 7 AND acc >= 20 THEN 0 WHEN least > 7 OR (acc < 20 AND NOT open) THEN 1 END AS false_start FROM runs)
    SELECT o.px_id, o.year, CASE WHEN coalesce(false_start, 0) = 0 THEN onset END AS planting, false_start,
           CASE WHEN least = most THEN least END::INTEGER AS max_dry_days, CASE WHEN NOT open THEN acc END AS onset_acc_mm
    FROM v_onset o LEFT JOIN said USING (px_id, year)""")
def _(spark, sf):
    out = O.gate_false_starts(I.planting(spark, sf), I.rain_record(spark, sf), bounds=(7, 15), absent="unknown")
    return out.select("px_id", "year", "planting", "false_start", "max_dry_days", "onset_acc_mm")
