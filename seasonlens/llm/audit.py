"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Filters A to D look at one text, E at all of them: a text is E where a row with a smaller key has the same text.
E is an existential self-join, a left-semi join on hash, exact text and smaller key, so that a group of copies is
never paired with itself.  Its ids are united with the ids that fail the other filters, each id's failures become
one bit combination, and combinations are counted per part: all orders of the chain are read from those counts,
at most 32 x 4 a part, without another look at a text.

* Texts are shuffled once to meet the repeated hashes.  Right side of the semi-join: one row per repeated (hash, text), its
  smallest key, combined map-side.  Left side: the rows whose hash repeats.
* Hot texts: a hash with more than ``1/HOT_SHARE`` of all rows, and ``SALT_ROWS`` at least, is dealt over salts by
  key, its one right row copied to each.  There are at most ``HOT_SHARE`` such hashes, which bounds the broadcast.

Nulls: a NULL text is empty, a NULL part is '', a NULL key is neither smaller nor larger than another (never E) and has no label.
Rows with equal keys are no copies of each other; each counts.  Several labels of one key: any of them suffices.
An empty table gives an empty table.  Other columns are not looked at.
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.llm.store import stored

#: At most so many hashes are broadcast as hot.
HOT_SHARE = 100_000
#: Rows of one text that are compared in one place.
SALT_ROWS = 1_000
FILTERS = "ABCDE"
ORDERS = 120
_WHITE = r"[ \t-\r]+"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_failures(text: Column) -> dict[str, Column]:
    """Whether the text alone fails A (few words), B (few distinct words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(50).cast("long") * n,
            "C": F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.length(text), "D": text.rlike("[#$%&*|]")}


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """key, part, bits, rows: one row per different (key, part, text) with its failures as bits and how many rows it stands for."""
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("h", _hash(F.col("text")))
    alone = sum((F.when(fails, bit(f)).otherwise(0) for f, fails in text_failures(F.col("text")).items()), F.lit(0))
    rows = stored(texts.select("key", "part", "h", alone.cast("int").alias("bits")), "failures")
    marks = rows.select("*", F.lit(1).cast("long").alias("rows")).unionByName(
        _copies(texts, rows).select("key", "part", "h", F.lit(bit("E")).alias("bits"), F.lit(0).cast("long").alias("rows")))
    return marks.groupBy("key", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows")).drop("h")


def _copies(texts: DataFrame, rows: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """key, part, h of every row whose text a row with a smaller key has as well."""
    total = rows.count()
    again = rows.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    again = stored(again.select("h", (F.lit(1) + F.floor(F.col("n") / salt_rows)).cast("int").alias("salts"), "n"), "repeated")
    hot = again.filter(F.col("n") > max(salt_rows, total // HOT_SHARE)).select("h", F.col("salts").alias("hot_salts"))
    deal = F.pmod(F.xxhash64("key", F.lit("salt")), F.coalesce("hot_salts", F.lit(1)).cast("long")).cast("int")
    dealt = lambda of: of.join(F.broadcast(hot), "h", "left").withColumn("salt", deal).drop("hot_salts")
    spread = again.join(F.broadcast(hot), "h", "left").select(
        "h", F.explode(F.sequence(F.lit(0), F.coalesce("hot_salts", F.lit(1)) - 1)).alias("salt"))
    # only rows of repeated hashes go on; their texts are written once and read by both sides.  The hashes grow with the
    # table, so they are merged at every size: what a small table could broadcast, a large one could not
    repeated = stored(dealt(texts.filter(F.col("key").isNotNull())).join(spread.hint("merge"), ["h", "salt"]), "copies")
    first = repeated.groupBy("h", "text").agg(F.min("key").alias("low")).join(spread, "h")
    left, right = repeated.alias("d"), first.alias("e")
    same = (F.col("d.h") == F.col("e.h")) & (F.col("d.salt") == F.col("e.salt")) & (F.col("d.text") == F.col("e.text"))
    return left.join(right, same & (F.col("e.low") < F.col("d.key")), "left_semi").select("key", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
                 label_key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, bits, n, good, toxic: how many rows of a part fail just these filters, and how many of them carry a label."""
    said = labels.filter(F.col(label_key).isNotNull()).groupBy(F.col(label_key).cast("long").alias("key")).agg(
        F.max((F.coalesce(F.col(good), F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce(F.col(toxic), F.lit(0)) == 1).cast("int")).alias("toxic"))
    found = failures(docs, key, text, part).join(said, "key", "left")
    of = lambda name: F.sum(F.col("rows") * F.coalesce(name, F.lit(0))).cast("long").alias(name)
    return found.groupBy("part", "bits").agg(F.sum("rows").alias("n"), of("good"), of("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders: 600 rows."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for i, f in enumerate(order, 1):
            out.append(("".join(order), i, bit(f), before))
            before |= bit(f)
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the combinations: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (removed by the step's filter, summed over all orders)."""
    spark, n = counts.sparkSession, F.col("n")
    steps = F.broadcast(spark.createDataFrame(_steps(), "filter_order string, step int, own int, earlier int"))
    places = F.array(*[F.struct(F.lit(own).alias("own"), F.lit(b).alias("earlier")) for own, b in sorted({s[2:] for s in _steps()})])  # 80
    failed, before = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("earlier")) != 0
    here = failed & ~before
    total = lambda when, what=n: F.sum(F.when(when, what).otherwise(0)).cast("long")
    # the filter is first among the failing ones of a row in 120 / (their number) of the orders
    first = (F.lit(ORDERS) / F.greatest(F.bit_count("bits"), F.lit(1))).cast("long")
    placed = counts.select("*", F.explode(places).alias("at")).select("*", "at.own", "at.earlier")
    read = placed.groupBy("part", "own", "earlier").agg(
        total(~failed & ~before).alias("kept"), total(here).alias("removed"), total(failed & before).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"), total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"), total(failed, n * first).alias("shapley"))
    return read.join(steps, ["own", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The audit of all orders, from documents and labels."""
    return interactions(combinations(docs, labels, **names))
