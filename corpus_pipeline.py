"""The corpus pipeline: stages over documents, each one an operator of coppice.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import save, table
from coppice.llm.jaccard_join import ngram_jaccard_join
from coppice.llm.language_id import fit, held_out, identify_language
from coppice.llm.mixing import apply_mix, mix_sources
from coppice.llm.pii import find_pii
from coppice.llm.sentencepiece import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay, under the predicted one; those without (no letter at all) go."""
    docs = docs.select(COLUMNS)
    model = fit(docs.filter(~held_out()))
    found = identify_language(docs, model, [docs[c] for c in COLUMNS])
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least doc_id (nulls last, then by text). Rows of equal
    doc_id and text count as one, with the least of their other columns. An id may stand for several texts: rows go or
    stay by their text. Texts without a word are no copies of others."""
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    gone = ngram_jaccard_join(docs.select("doc_id", "text"), with_key=True).filter("not kept").select("doc_id", "text_key").distinct()
    # Partial sums bring equal rows together before they are dealt out by id and text.
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    docs = docs.select(COLUMNS).withColumn("text_key", key).groupBy("doc_id", "text_key").agg(F.min(F.struct(*rest)).alias("rest"), F.min("text").alias("text"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    stay = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    return stay.select("doc_id", "text", "rest.*").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data are generalised, and n_chars follows the text."""
    out = find_pii(docs.select(COLUMNS), keep=COLUMNS, with_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat by whole epochs; the cut falls within one document a source.
    Documents without words stay out. Rows take part one by one, whatever their ids; the draw is by id and text."""
    draw = F.concat_ws(":", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    docs = save(docs.select(*COLUMNS, draw.alias("draw"), F.monotonically_increasing_id().alias("mix_id")), "mixture-rows")
    out = apply_mix(docs, mix_sources(docs, "mix_id", draw_col="draw"), "mix_id")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids instead of its text."""
    keep = [docs["doc_id"], docs["lang"], docs["source"]]
    return encode_documents(docs, keep).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", mixture),
    ("sentencepiece", tokens),
]
#: Trained models and hashing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
