"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet to the shared folder and read back as the next one's docs. All but the last return the columns of
``documents``. No SQL can express the language model, the near-duplicate links or the tokenizer, so
``ORACLE_SQL`` is None and the tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm import language, mixing, near_dup, sentencepiece_scan, substrings
from paraforge.llm.common import stored, table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with score 0 (they share nothing with the language found), go; a missing ``lang``
    becomes the predicted one. With no labelled document to learn from, all documents with a letter stay."""
    model = language.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.lit(language.UNKNOWN)))
    lang, score = unused(docs, "lang_pred", "score")
    found = language.predict(docs, model, lang, score).filter((F.col(lang) != language.UNKNOWN) & (F.col(score) > 0))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return near_dup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat across documents go; other texts stay as they are."""
    rows = substrings.strip_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return (rows.withColumn("text", text)
            .withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents that it does not take, and empty ones, go."""
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids (array of int) of each document of the mix."""
    import public_tokenizers

    rows = sentencepiece_scan.encode(docs.select("doc_id", "source", "lang", "text"),
                                     public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "source", "lang", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
