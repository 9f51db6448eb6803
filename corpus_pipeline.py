"""A training corpus from raw documents: five stages, each an operator of ``ledgerline.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.  No stage is expressible in SQL as a whole (trained scores, random rounding, BPE), so
``ORACLE_SQL`` is None and the tests hold every stage against a brute-force version.

Defined results: an empty table passes through as an empty one, and so does a stage that keeps nothing; null
texts count as empty and come out of the third stage as empty ones; rows that are equal in all columns, and rows without
an id, are documents like others (the second stage keeps one of equal texts of an id, and all rows without
an id); other columns pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, minhash_dedup, mixing, pii, toxicity
from ledgerline.llm.common import WRITTEN, cut, discard, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels (held-out fold apart) does not call toxic; without labels all stay."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id; texts without words, and rows without an id, all stay."""
    return minhash_dedup.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text; null texts become empty."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; empty texts by chance, the null source as one of its own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every text that the mix holds."""
    return byte_bpe.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's result is written; what it and the stages before it wrote on the way is deleted then, so only
    the last table stays in the shared folder.
    """
    docs, first = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, since=first, keep=1)
    return docs
