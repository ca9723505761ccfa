"""From raw documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendscope.llm import decontaminate, line_crf, line_dedup, mixing, near_dup
from spendscope.llm.texts import table
from spendscope.session import settle


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as bad go."""
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.good_documents(docs, field)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand somewhere before are cut; documents of which nothing is left go."""
    return line_dedup.deduplicated(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dup.one_of_each(docs)


def take_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", reject_bad),
    ("line_dedup", cut_repeats),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", take_out_benchmark),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the rolling boundaries; see tests/llm/test_llm_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
