"""From raw documents to a training mix: quality, repeated lines, near copies, benchmark passages, source shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscore.llm import decontaminate, jaccard, line_dedup, mixing, quality
from txscore.llm._common import materialize, reader


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model gives an even chance of a good grade, at least."""
    return quality.select(docs, quality.quality_model(docs, reader(spark, sf_dir, "labels")), least=0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated passages; those that lose all their words go."""
    done = line_dedup.dedup_lines(docs)
    left = done.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"n_chars": F.char_length("text").cast("long")}
    return left.select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its 5-word shingles."""
    return jaccard.keep_one(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't make up a twentieth of."""
    return decontaminate.decontaminate(docs, reader(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that sources weigh 1, 2, 3 in turn."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: Fitted models and entropy balancing aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reader(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
