"""All registered queries of the relational and semantic engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucidframe.plans import files, relational, semantic


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with a mail address, by the semantic filter."""
    return semantic.engine(spark, sf_dir).sql("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND text MEANS 'has a mail address'")


def queries() -> dict:
    return relational.queries() | files.queries() | semantic.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | files.oracle_sql() | semantic.oracle_sql()
