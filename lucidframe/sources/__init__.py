"""Readers and writers of files by suffix; everything else is spark.read and df.write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "txt": "text", "parquet": "parquet"}


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return FORMATS.get(name.rsplit(".", 1)[-1].lower(), "parquet") if "." in name else "parquet"


def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table of files (globs included); CSV has a header unless options say otherwise."""
    kind = format_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        options = {"header": "true", "sep": "\t" if path.endswith(".tsv") else ","} | ({} if schema else {"inferSchema": "true"}) | options
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write(df: DataFrame, path: str, **options) -> None:
    kind = format_of(path)
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options).save(path)
