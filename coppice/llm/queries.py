"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, jaccard_join, language_id, media, mixing, pii, quality, sentencepiece, toxicity, url_filter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels), [docs["doc_id"], toxicity.held_out().alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    scored = quality.score_quality(docs, quality.fit(docs, labels), [docs["doc_id"], quality.held_out().alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.fit(pages))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(table(spark, sf_dir, "documents"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece.encode_documents(docs, [docs["doc_id"]], digests=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify_language(docs, model, [docs["doc_id"], language_id.held_out().alias("held_out")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality, op3_url_filter, op4_pii, op5_ngram_jaccard_join, op6_embedding_near_dedup, op7_media_columns, op8_mixing_sources, op9_sentencepiece, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": jaccard_join.ORACLE,
        "op6_embedding_near_dedup": embedding_dedup.ORACLE,
        "op8_mixing_sources": mixing.ORACLE,
    }
