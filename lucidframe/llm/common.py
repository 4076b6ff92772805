"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the path the driver uses (on a cluster: --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def release() -> None:
    """Give what this worker has freed back to the system: workers live on, and their executor's next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only where none is named (tests) fall back to the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the checkpoint folder and read again: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove what stored() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c(name: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of df (compared as Spark does, without case)."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the component's least node) of an edge list: large-star and small-star rounds until nothing changes."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        # large star: every larger neighbour is linked to the least of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour and the node itself are linked to the least
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.toDF("u", "v")).distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.toDF("node", "root").union(e.select("v", "v").distinct())
        before = now


def list_array(parts: list[np.ndarray], kind: pa.DataType, valid: list[bool] | None = None) -> pa.ListArray:
    """A list column from one numpy array a row; rows where valid is false are null."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    mask = None if valid is None or all(valid) else pa.array([not v for v in valid], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind), mask=mask)
