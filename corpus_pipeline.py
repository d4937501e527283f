"""From raw documents to token ids: quality, near duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.decontaminate import keep_clean
from quern.llm.importance import keep_sampled
from quern.llm.jaccard_join import keep_one
from quern.llm.personal_data import redact
from quern.llm.sentencepiece_scan import encoded
from quern.scratch import discard, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws for the target; those it rejects go.

    Empty and null texts have no evidence against them; equal rows are kept or rejected together.
    """
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest doc_id.

    Documents without an id come last, of repeated rows one stays, texts without words all stay.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark; null and empty texts are clean."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by its kind; null text stays null."""
    return redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, text_ok) of every document; null and empty texts have no pieces."""
    return encoded(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: The quality classifier is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; a stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
