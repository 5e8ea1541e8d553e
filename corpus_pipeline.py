"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, then a weighted mix of sources.

Each stage works on all rows that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.llm import decontaminate, jaccard, langid, mixing, secrets
from slimwire.llm.common import scratch, table, written

#: Below this confidence a text's language isn't told; a coin toss between two families and two languages has 0.25.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told (operator 4); those without a letter or without a clear language go."""
    model = langid.train(langid.held_out(docs).filter("not held_out").select("text", "lang"))
    judged = langid.identify(docs, model, "__lang", "__score")
    return judged.filter((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (operator 6)."""
    return jaccard.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found (operator 7)."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their texts (operator 1)."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the weighted mix takes, with the words taken, repeats counted (operator 5)."""
    return mixing.mix_sources(docs, F.array("source")).filter("taken > 0")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secret_scan", secret_scan), ("mix", mix)]

#: SQL can't express learned machines and a latent space, so there is none; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``: each result is written to the shared folder and read as the next one's docs; what
    a stage read and wrote on its way is removed once its own result is whole."""
    docs, made = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark, made) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
