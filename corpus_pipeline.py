"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundlens.llm import decontaminate, langid, mixing, ngram_join, queries, toxicity
from fundlens.llm.common import Stage

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity_score(model, F.col("text")) < TOXIC)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with two nearly equally likely ones, go."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), langid.identify_language(queries.language_model(docs), F.col("text")).alias("found"))
    return rows.filter((F.col("found.lang") != langid.UNKNOWN) & ~F.col("found.ambiguous")).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest id stays."""
    return ngram_join.one_per_component(docs, ngram_join.similar_documents(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words go."""
    return decontaminate.remove_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.taken_words(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # two stages are trained classifiers


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    stage = Stage(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return docs


PIPELINE = {"pipeline": (run, ORACLE_SQL)}
