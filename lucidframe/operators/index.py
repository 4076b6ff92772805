"""Semantic index: chunks of distinct texts with their embeddings, as Parquet; exact search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidframe.errors import SemanticError
from lucidframe.functions.columns import CHUNK_WORDS, OVERLAP_WORDS, chunks, cosine_to, doc_hash, normalise
from lucidframe.operators.context import Semantic, small_batches

FETCH = 256  # chunks that a pre-filter considers
FLOOR = 0.35
PER_DOC = 3
SEPARATOR = "\n---\n"
CHUNK_SCHEMA = "h long, chunk int, text string, vector array<float>"


@dataclass
class Index:
    table: str
    column: str
    path: str
    embed_id: str
    dim: int
    words: int = CHUNK_WORDS
    overlap: int = OVERLAP_WORDS

    def chunks(self, ctx: Semantic) -> DataFrame:
        return ctx.spark.read.schema(CHUNK_SCHEMA).parquet(self.path + "/chunks")

    def members(self, ctx: Semantic) -> DataFrame:
        return self.chunks(ctx).select("h").distinct()


def text_chunks(texts: DataFrame, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """h, chunk, text of every distinct non-null text; one empty chunk for a text of white space. texts: text."""
    docs = texts.where("text is not null").select(doc_hash(F.col("text")).alias("h"), "text").dropDuplicates(["h"])
    parts = docs.select("h", F.posexplode_outer(chunks(F.col("text"), words, overlap)).alias("chunk", "text"))
    return parts.select("h", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))


def embedded(ctx: Semantic, parts: DataFrame, dim: int) -> DataFrame:
    model = ctx.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, model.embed_batch):
                part = batch.slice(at, model.embed_batch)
                vectors = model.embed([t or " " for t in part.column(2).to_pylist()])  # services refuse an empty text
                if any(len(v) != dim for v in vectors):
                    raise SemanticError(f"the embedder gave {sorted({len(v) for v in vectors})} dimensions, the index has {dim}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], ["h", "chunk", "text", "vector"])

    return parts.repartition(ctx.parallel).mapInArrow(run, CHUNK_SCHEMA)


def _meta(ctx: Semantic, path: str) -> dict | None:
    if not ctx.path_exists(path + "/meta"):
        return None
    return ctx.spark.read.json(path + "/meta").first().asDict()


def create_index(ctx: Semantic, df: DataFrame, table: str, column: str, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Index:
    dim = len(ctx.model.embed(["probe"])[0])
    index = Index(table, column, f"{ctx.root}/index/{table}.{column}", ctx.model.embed_id, dim, words, overlap)
    texts = df.select(F.col(f"`{column}`").cast("string").alias("text"))
    with small_batches(ctx.spark):
        embedded(ctx, text_chunks(texts, words, overlap), dim).write.mode("overwrite").parquet(index.path + "/chunks")
    meta = [(index.embed_id, dim, words, overlap)]
    ctx.spark.createDataFrame(meta, "embed_id string, dim int, words int, overlap int").coalesce(1).write.mode("overwrite").json(index.path + "/meta")
    ctx.indexes[table, column] = index
    return index


def open_index(ctx: Semantic, table: str, column: str) -> Index:
    path = f"{ctx.root}/index/{table}.{column}"
    meta = _meta(ctx, path)
    if meta is None:
        raise SemanticError(f"{path} is no semantic index: its metadata is missing")
    if meta["embed_id"] != ctx.model.embed_id:
        raise SemanticError(f"the index on {table}({column}) was made with {meta['embed_id']}, the session embeds with {ctx.model.embed_id}")
    ctx.indexes[table, column] = Index(table, column, path, meta["embed_id"], meta["dim"], meta["words"], meta["overlap"])
    return ctx.indexes[table, column]


def refresh_index(ctx: Semantic, df: DataFrame, table: str, column: str) -> int:
    """Embed the texts that the index lacks; how many."""
    if (table, column) not in ctx.indexes:
        raise SemanticError(f"there is no semantic index on {table}({column})")
    index = ctx.indexes[table, column]
    texts = df.select(F.col(f"`{column}`").cast("string").alias("text"))
    new = text_chunks(texts, index.words, index.overlap).join(index.members(ctx), "h", "left_anti")
    new = ctx.stored(embedded(ctx, new, index.dim), "refresh")
    new.write.mode("append").parquet(index.path + "/chunks")
    return new.select("h").distinct().count()


def search(ctx: Semantic, index: Index, query: str, fetch: int | None = FETCH, floor: float | None = FLOOR) -> DataFrame:
    """h, chunk, text, score of the nearest chunks."""
    vector = ctx.model.embed([query])[0]
    ctx.counters["embed_calls"] += 1
    hits = index.chunks(ctx).select("h", "chunk", "text", cosine_to(F.col("vector"), vector).alias("score"))
    if floor is not None:
        hits = hits.where(F.col("score") >= floor)
    if fetch is not None:
        hits = hits.orderBy(F.desc("score"), "h", "chunk").limit(fetch)
    return hits


def evidence(hits: DataFrame, per_doc: int = PER_DOC) -> DataFrame:
    """h, score (its best) and excerpts of each text that was hit."""
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy(F.desc("score"), "chunk"))).where(F.col("r") <= per_doc)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"])
    return best.groupBy("h").agg(F.max("score").alias("score"), F.array_join(parts, SEPARATOR).alias("excerpts"))


def doc_vectors(ctx: Semantic, index: Index) -> DataFrame:
    """h, v: mean of each text's chunk vectors, of length 1."""
    return mean_vectors(index.chunks(ctx).select("h", F.col("vector")))


def mean_vectors(rows: DataFrame, key: str = "h", vector: str = "vector") -> DataFrame:
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.where(F.col(vector).isNotNull()).groupBy(key).agg(vector_to_array(mean).alias("v")).select(key, normalise(F.col("v")).alias("v"))


def open_indexes(ctx: Semantic) -> list[str]:
    """Open every index below the root that the session's model can use; their names."""
    jvm, sc = ctx.spark.sparkContext._jvm, ctx.spark.sparkContext
    base = jvm.org.apache.hadoop.fs.Path(f"{ctx.root}/index")
    fs = base.getFileSystem(sc._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(base) if fs.exists(base) else []:
        name = status.getPath().getName()
        table, _, column = name.rpartition(".")
        meta = _meta(ctx, f"{ctx.root}/index/{name}") if table else None
        if meta and meta["embed_id"] == ctx.model.embed_id:
            open_index(ctx, table, column)
            found.append(name)
    return sorted(found)
