"""From raw documents to token ids: quality, near-duplicates, personal data, mixture, tokens.

A stage begins by deleting the intermediate tables of the stages before it, so their results must have been
written by then.

What stages do with awkward rows: a null or empty text fails the base rule of the first stage; very long texts are
measured, compared, searched and encoded whole; rows that repeat an id, or have none, are rows of their own in every
stage, and only their texts decide; an empty table stays empty; columns beyond those of documents are carried along,
whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repurchase.llm import bpe, mixing, neardup, pii, quality
from repurchase.llm.storage import fresh, release, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rule or a risk-controlled cutoff rejects.

    A document without lang belongs to the stratum of the empty name; without labels only the base rule rejects.
    """
    release(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, rows without id last.

    Texts without words are linked with nothing and stay. Nothing depends on the order of rows but which of several
    rows with one id and near-duplicate texts stays.
    """
    release(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars stays that of the original text."""
    release(spark)
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their first word, up to three times; ones without words once.

    Null is a source of its own.
    """
    release(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token ids; a null text has none."""
    release(spark)
    return bpe.encode_documents(docs, "doc_id", "source", outputs="ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Sketches, learned spans and token merges have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage returns is written and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
