"""Site-relative line de-duplication with DataFrame operations only.

A line is boilerplate on its host when the pages of that host that contain it, divided by all pages of
the host, exceed ``ratio`` (and at least ``min_pages`` contain it).  Boilerplate lines are dropped from
every page of that host; all other lines, blank ones included, stay in order.

Lines are compared without surrounding white space, by a 64-bit hash: a false drop needs a collision
with one of the host's few boilerplate lines.  A host has at most (mean distinct lines a page) / ratio
of them, so the per-host list is bounded by the page length and not by the number of pages.

Copies: every row counts as a page of its own, as in the SQL of the query, so a text with more than ``ratio`` of a
host's pages loses all its lines.  With ``copies_once`` equal texts of a host count as one page.  With ``most`` a page of
which a larger share of the characters would go stays whole: it is a copy of other pages (near copies have most lines in
common), which a near-duplicate stage has to settle, and not a page with boilerplate on it.

Nulls: a NULL text stays NULL with 0 lines; NULL hosts form one host.  A text that loses all lines
becomes ''.  Equal rows count as pages of their own.  An empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.llm.store import set_aside, stored

RATIO = 0.05
MIN_PAGES = 5
ADDED = ("n_lines", "n_dropped")
#: Names that the operator uses itself.
NAMES = {*ADDED, "_host", "_salt", "_kept", "_size", "lines"}
#: Boilerplate lists of at most this many lines in all are sent to every task; beyond it, they are joined.
BROADCAST_LINES = 200_000
#: Ways a host's pages are spread when the lists are joined.
SALTS = 64


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _key(line: Column) -> Column:
    """NULL for a blank line."""
    bare = F.trim(F.translate(line, "\t\r\f\v", "    "))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """_host, lines: the hashes of each host's boilerplate lines.  Line counts combine map-side."""
    of_host, of_page = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("-")), F.array_distinct(F.transform(_lines(text), _key))
    keyed = pages.select(of_host.alias("_host"), of_page.alias("_page"), F.xxhash64(text).alias("_t"))
    if copies_once:  # rows of line hashes are shuffled, not texts; one of a group of copies leaves a map task
        keyed = stored(keyed.distinct(), "counted")
    seen = keyed.select("_host", F.explode("_page").alias("_line"))
    per_line = seen.filter(F.col("_line").isNotNull()).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    totals = keyed.groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    hot = per_line.filter(F.col("_n") >= min_pages).join(totals, "_host").filter(F.col("_n") > ratio * F.col("_all"))
    return hot.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     broadcast_lines: int = BROADCAST_LINES, copies_once: bool = False, most: float | None = None) -> DataFrame:
    """The pages with ``text`` cleaned, and ``n_lines, n_dropped``."""
    pages = set_aside(pages, NAMES)
    hot = stored(boilerplate_lines(pages, text, host, ratio, min_pages, copies_once), "boilerplate")
    n = hot.agg(F.sum(F.size("lines"))).first()[0] or 0
    keyed = pages.withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("-")))
    if n <= broadcast_lines:
        rows = keyed.join(F.broadcast(hot), "_host", "left")
    else:  # a host's pages go to SALTS partitions, and its list to each of them
        spread = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = keyed.withColumn("_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(spread, ["_host", "_salt"], "left")
    every = _lines(text)
    kept = F.filter(every, lambda x: F.coalesce(~F.array_contains("lines", _key(x)), F.lit(True)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(every)).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "_kept": F.when(F.col("lines").isNotNull(), kept)})
    if most is not None:
        left = F.aggregate("_kept", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
        all_of_it = F.length(F.translate(F.col(text), "\n", "")).cast("long")
        rows = rows.withColumn("_size", all_of_it).withColumn("_kept", F.when(F.col("_size") - left <= most * F.col("_size"), F.col("_kept")))
    return rows.select(
        *[F.when(F.col("_kept").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")).alias(text)
          if c == text else F.col(c) for c in pages.columns],
        "n_lines", F.when(F.col("_kept").isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
