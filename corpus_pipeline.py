"""From raw documents to a training mix: language, lines, near duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``;
the last returns one row per draw of the mix.  A stage's result is written as Parquet to the shared folder and
read again as the next one's documents, so a lost executor repeats one stage at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seasonlens.llm import decontaminate, jaccard, language, lines, mixing
from seasonlens.llm.store import given
from seasonlens.sources.tables import new_path

#: Posterior under which a language is not believed.
MIN_SCORE = 0.5
#: Share of a document that may be boilerplate.
MOST = 0.5
#: Draws, shards and the kernels' approximations are not SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a believable language."""
    found = language.identify(docs, language.fit(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(given(docs, language.NAMES))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each source's boilerplate lines from its documents; all documents stay.  Equal texts count as one page of a
    source, and a document that would lose more than ``MOST`` of itself stays whole: it is one of a group of copies, of
    which the next stage has to find one to keep."""
    cut = lines.drop_boilerplate(docs, copies_once=True, most=MOST)
    cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(given(docs, lines.NAMES))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of near duplicates."""
    return jaccard.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words occur in benchmark passages."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_verdict(decontaminate.find_contamination(docs, bench))
    return found.filter(~F.col("contaminated")).select(given(docs, decontaminate.NAMES))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per draw: the document (its text cut where the quota ends), its pass, shard and place in the shard."""
    return mixing.mixed_rows(mixing.mix_documents(docs))


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
