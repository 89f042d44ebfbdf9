"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into about sqrt(n) blocks of its permuted documents, so both the block table and
one block stay small beside the source.  A source's quota (whole passes, then whole blocks, then one
part block) is exact.  The quotas are split over the output shards by a tree: at every node the left
half gets a multivariate-hypergeometric share of the node's quotas.  A shard then owns a range of each
source's permuted draws, disjoint from all other shards, and orders its rows by a seeded hash.

Nulls: a NULL text has no words, a NULL source is the last source.  A source without words has the
target 0.  Rows that are equal in every column are drawn like any other rows.  An empty table gives an
empty mix.  Columns of the input are kept; the columns added are named in ``ADDED``.
The statistics are one row per source; nothing is collected to the driver.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seasonlens.llm.store import set_aside, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
ADDED = ("size", "source_size", "target", "draws")
#: Names that the operator uses itself.
NAMES = {*ADDED, "_src", "_h", "_block", "_off", "_given", "n_rows", "n_blocks", "words_due",
         "_g", "epoch", "shard", "words", "mix_order"}
_DRAWS = "array<struct<epoch:int,shard:int,words:bigint>>"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """_src, n_rows, source_size, target: weights by the order of sources, capped at max_repeat passes.

    The capped sources are those of the smallest size per weight, so one ordered running sum finds
    the level at which the excess has been reshared.
    """
    per = sized.groupBy("_src").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    order = W.orderBy("_src")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * max_repeat
    by_ratio = W.orderBy(cap / F.col("_w"), "_src")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({
        "_cap": cap,
        "_level": (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / F.sum("_w").over(onward)})
    # the first row whose cap is not below its own level fixes the level for all rows after it
    level = F.min(F.when(F.col("_cap") >= F.col("_w") * F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), "_src", "_level"))).over(everything)
    return per.withColumn("_l", level["_level"]).select(
        "_src", "n_rows", "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_l")), F.col("_cap")).alias("target"))


def _split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas per shard: halve the shards, draw the left half's counts, go on in both halves."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    n = int(quota.sum())
    take = rng.multivariate_hypergeometric(quota, n * left // shards, method="marginals") if n else quota
    return np.vstack([_split(take, left, rng), _split(quota - take, shards - left, rng)])


def shard_quotas(quotas: DataFrame, splits: tuple[int, ...], seed: int) -> DataFrame:
    """(_src, n_draws) -> (_src, shard, lo, hi).  Each tier of the tree splits every node of the tier
    above, so one task holds the sources of one node times one fan-out."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "_src", F.col("n_draws").alias("q"))
    def splitter(tier: int, fan: int):
        def split_node(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_src")
            node = int(pdf["node"].iloc[0])
            got = _split(pdf["q"].to_numpy(np.int64), fan, np.random.default_rng([seed, tier, node]))
            return pd.DataFrame({"node": np.repeat(node * fan + np.arange(fan), len(pdf)),
                                 "_src": np.tile(pdf["_src"].to_numpy(), fan), "q": got.ravel()})
        return split_node
    for tier, fan in enumerate(splits):
        nodes = nodes.groupBy("node").applyInPandas(splitter(tier, fan), "node long, _src string, q long")
    upto = W.partitionBy("_src").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    return nodes.select("_src", F.col("node").cast("int").alias("shard"), (F.sum("q").over(upto) - F.col("q")).alias("lo"),
                        F.sum("q").over(upto).alias("hi")).filter("hi > lo")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
                  share: float = SHARE, max_repeat: float = MAX_REPEAT, splits: tuple[int, ...] = (8, 8),
                  seed: int = 17) -> DataFrame:
    """Every input row with ``size, source_size, target`` and ``draws``: the passes in which the mix
    takes it, the shard each goes to and how many of its words (from the front) are taken."""
    docs = set_aside(docs, NAMES)
    src = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))  # 't' comes after every 's...'
    sized = docs.select("*", src.alias("_src"), word_count(text).alias("size"))
    per = source_targets(sized.select("_src", "size"), weights, share, max_repeat).withColumns({
        "n_blocks": F.ceil(F.sqrt("n_rows")).cast("long"), "words_due": F.round("target").cast("long")})
    # one row per source, stored: Spark sees its true size and broadcasts it only below its own threshold
    per = stored(per, "mix-sources")
    salt = F.xxhash64(F.lit(seed), F.col("_src"), F.col(key), F.xxhash64(F.col(text)))
    placed = sized.withColumn("_h", salt).join(per, "_src").withColumn("_block", F.pmod("_h", "n_blocks"))
    blocks = placed.groupBy("_src", "_block").agg(F.sum("size").alias("words"))
    turn = W.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed + 1), "_src", "_block"), "_block")
    upto = turn.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = blocks.select("*", (F.row_number().over(turn) - 1).cast("long").alias("rank"),
                           (F.sum("words").over(upto) - F.col("words")).alias("before"))
    per_block = ranked.join(per.select("_src", "source_size", "n_blocks", "words_due"), "_src")
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words_due") / F.col("source_size")) - 1, F.lit(0)).cast("int"))
    draws = per_block.filter("source_size > 0").withColumn("epoch", F.explode(passes)).withColumn(
        "budget", F.least("words", F.col("words_due") - F.col("epoch").cast("long") * F.col("source_size") - F.col("before"))
    ).filter("budget > 0")
    # draws of a source are numbered pass by pass in its permuted order; blocks without words have none
    number = W.partitionBy("_src").orderBy("epoch", "rank")
    draws = draws.select("_src", "_block", "epoch", "budget", (F.row_number().over(number) - 1).cast("long").alias("j"))
    quotas = shard_quotas(draws.groupBy("_src").agg(F.count(F.lit(1)).alias("n_draws")), splits, seed)
    slots = quotas.select("_src", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("j"))
    given = draws.join(slots, ["_src", "j"]).groupBy("_src", "_block").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "shard", F.col("budget").alias("words")))).alias("_given"))

    rest = docs.columns
    rows = placed.join(given, ["_src", "_block"], "left")
    inside = W.partitionBy("_src", "_block").orderBy("_h", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_off", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    mine = F.transform(F.coalesce("_given", F.array().cast(_DRAWS)), lambda g: F.struct(
        g["epoch"].alias("epoch"), g["shard"].alias("shard"),
        F.greatest(F.least(F.col("size"), g["words"] - F.col("_off")), F.lit(0)).cast("long").alias("words")))
    return rows.select(*rest, "size", "source_size", "target", F.filter(mine, lambda g: g["words"] > 0).alias("draws"))


def taken(draws: str = "draws") -> Column:
    return F.aggregate(draws, F.lit(0).cast("long"), lambda a, g: a + g["words"])


def mixed_rows(mixed: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """One row per draw: the input columns, ``epoch, shard, mix_order`` and the text cut to the words
    taken.  Read a shard in ``mix_order`` for its local shuffle."""
    rest = [c for c in mixed.columns if c not in ADDED]
    one = mixed.select("*", F.explode("draws").alias("_g"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("_g.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("_g.words").cast("int")), " "))
    cut = cut.otherwise(F.col(text))
    return one.withColumn(text, cut).select(
        *rest, F.col("_g.epoch").alias("epoch"), F.col("_g.shard").alias("shard"), F.col("_g.words").alias("words"),
        F.xxhash64(F.lit(seed + 2), F.col("_g.shard"), F.col("_g.epoch"), F.col(key)).alias("mix_order"))
