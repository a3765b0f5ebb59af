"""The queries op1 to op10 and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscore.llm import ann, decontaminate, html_text, jaccard, line_dedup, mixing, quality, tokens, toxicity, warc
from txscore.llm._common import reader
from txscore.llm.oracles import ORACLES


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(reader(spark, sf_dir, "pages"))
    back = warc.read_warc(archives, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(reader(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(reader(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole join, links included; its SQL has the columns without n_links, which op5_jaccard_links returns."""
    return op5_jaccard_links(spark, sf_dir).select("doc_id", "n_shingles", "component_id")


def op5_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(reader(spark, sf_dir, "documents"), 3, 90)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(reader(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(reader(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reader(spark, sf_dir, "documents").select("doc_id", "text")
    graded = quality.grade(docs, quality.quality_model(docs, reader(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold() == 0, F.lit(False))
    return graded.select("*", held_out.alias("held_out"), (F.col("tail_probability") >= 0.5).alias("kept"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(reader(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_html_text": op4_html_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op5_jaccard_links": op5_jaccard_links,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
