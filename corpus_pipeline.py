"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import neardup, packing, queries, secrets, store, toxicity

#: SQL for run()'s rows: none, as the stages' models and hashes are not expressible; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic, by a model of the table of labels and the documents at hand.

    Equal texts share a fate; repeated rows, null ids and null or empty texts are rows like others, and these texts stay
    unless the model calls a text without toxic words toxic. Texts of any length are scored whole. Without labels of both
    classes, and of an empty table, every row stays. Other columns stay as they are, whatever their names.
    """
    store.small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, queries.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, null ids last.

    Ties of equal ids go to the smaller hash of the text; of repeated rows one stays. Null, empty and blank texts are one
    group. Texts of any length count whole; an empty table stays empty; other columns stay as they are, whatever their names and types.
    """
    store.small_batches(spark)
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars corrected where a text has changed.

    Null and empty texts, null ids and repeated rows stay; texts of any length are masked whole; an empty table stays empty;
    other columns stay as they are, whatever their names.
    """
    return secrets.redact(docs, known=queries.secret_words())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 4096 tokens.

    Null and empty texts are one piece of one token; null ids and repeated rows are documents like others; equal lengths are
    placed by content and id; texts of any length are cut whole; an empty table gives no row. Other columns are not read.
    """
    store.small_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's result written down and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
