"""A training corpus from the documents: quality, near duplicates, repeated passages, benchmark leaks, and a mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import bm25_decontam, ngram_join, quality_fm, soft_mixing, suffix_dedup
from melisma.llm.common import discard, durable, written

#: Passages of over 50 words are caught from this many bytes on.
PASSAGE_BYTES = 200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_fm.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that stand in several places are cut out of the texts; n_chars is counted again."""
    return suffix_dedup.remove(docs, PASSAGE_BYTES).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return bm25_decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain posteriors and the rate at which each document enters the mix; no document goes."""
    return soft_mixing.mix(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: The classifier and the fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir.

    Each is written before the next begins; then its input and its operators' own tables go. The last stage's stay, as its rows
    are still to be computed.
    """
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with written() as made:
            docs = stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                return docs
            docs = durable(docs)
        discard(spark, before + made[:-1])
        before = made[-1:]
