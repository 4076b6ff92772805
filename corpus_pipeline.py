"""A training-data pipeline: quality filter, near-duplicate removal, redaction, mixing, encoding.

Every stage works on all documents its predecessor kept; all but the last return the columns of documents.

Defined results, for each stage besides what its operator's module states: rows of null ids, null or empty texts and texts of any length pass (the classifier scores
a null or empty text by its intercept, null ids and texts have no near copies, redaction leaves nulls as they are, a null source is a source, a null text has null
tokens); repeated rows are treated alike, and as copies of one id none of them goes; ties are settled by the least id (copies) or the kept side (a score of 0);
an empty table gives an empty table; extra columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.llm import bpe, jaccard, mixing, pii, quality
from lucidframe.llm.common import dropped, ensure_checkpoint_dir, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the NB-SVM fitted on the labels rejects go."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of the least id stays."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; n_chars follows the text."""
    return pii.redact(docs, entities=None, count=None).withColumn("n_chars", F.length("text").cast("long"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to weights of their rows ** 0.5, and all rows are shuffled."""
    return mixing.poisson_mix(docs, copy_col=None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stored as Parquet and read again by the next."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier, a CRF and BPE are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None
