"""The corpus pipeline: documents without toxic rows, near duplicates and benchmark passages, secrets redacted, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from fieldloom.llm.common import load, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model is trained on the labels of this data set.

    Null and empty texts have the score of no n-grams, rows with a null id are scored like others, repeated rows share
    their verdict; without labels of both kinds all have the labels' share of toxic ones. No rows: no rows.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, load(spark, sf_dir, "labels")), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word n-grams, Jaccard similarity of 0.8 or more.

    The least id stays (a null id only if there is no other), of repeated rows the first by all columns. Null, empty and
    blank texts are copies of each other: one of them stays. No rows: no rows.
    """
    return ngram_join.keep_one(docs, threshold="0.8", n=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region within a tenth of a benchmark item's characters in edits.

    Null and empty texts stay, rows with a null id are judged by their text, repeated rows share their verdict. Without
    benchmark items all stay; no rows: no rows.
    """
    return decontaminate.drop_leaked(docs, load(spark, sf_dir, "benchmark"), rate="0.1")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars counted anew.

    Null texts stay null and empty ones empty; repeated rows, null ids and all other columns stay as they are. The ordinary
    words are those of this stage's documents. No rows: no rows.
    """
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    Null and empty texts are one piece of the end token; null ids and repeated rows have pieces of their own. No rows: no
    rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Tokenization, MinHash and the genetic search can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
