"""The training-corpus pipeline: documents in, encoded documents out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents, with whatever else stands
in them and whatever it is called.

Defined cases: a null text counts as empty, and is judged, deduplicated and
encoded as the empty text; texts of any length go through whole; ids may be null
or repeated, as rows are followed by their texts; of rows repeated whole one
leaves the second stage; where several texts of one class share its least id, or
have no id, one of them stays; empty tables of documents, labels or benchmark
items give empty or untouched results, and run() then an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import ensure_importable
from tessera.llm import bpe, decontam, exact_dedup, minhash, quality
from tessera.llm.common import Steps, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    index = exact_dedup.open_index(spark)
    kept = exact_dedup.drop_copies(docs, index)
    index.discard()  # begun for this run alone, and what stays does not read it
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the least doc_id stays."""
    return minhash.one_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens of every document that came this far."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", clean_of_benchmarks),
    ("bpe encoding", encoded),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    docs, steps = table(spark, sf_dir, "documents"), Steps(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = steps.written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    steps.over(docs)
    return docs
