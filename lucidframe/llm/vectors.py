"""Embedding near-duplicates by a subspace pigeonhole join: which vectors have cosine >= t, and their classes.

Vectors are normalised, so that the condition is |x - y|^2 <= r^2 = 2 (1 - t), and rotated by a fixed random orthogonal matrix, which
spreads any difference over all coordinates. Cut into blocks of BLOCK coordinates, a pair within r is within r_b, r_b^2 = r^2 * block / dim, in
one block at least. Each block is range-joined on a grid over its first g coordinates, of cells WIDE times r_b wide: a vector goes to its own cell and,
in each coordinate that lies within r_b of the cell's lower side, to the next lower one, so that two vectors within r_b meet in
the cell of their coordinatewise minimum, and a vector has (1 + 1 / WIDE)^g copies a block on average. Cells of many vectors are cut into
buckets, of which each two meet in a task of their own. In a cell, vectors are ordered by a further coordinate, compared within r_b of it
over the block, then over all coordinates as bytes, with slack for their rounding. The union over blocks is verified with the exact vectors.
Nothing is approximate: g (from the number of vectors) and the buckets change cost, not results.

Equal vectors are one class from the start: thousands of copies cost no pairs.

Result of near_vectors: vec_id, class_id, links. Vectors are linked if their cosine is t or more; class_id is the least id among all that are reached over
links, links the number of other ids linked directly (copies included). Result of near_pairs: vec_a < vec_b, cosine of linked classes of equal
vectors, each by its least id.

Defined results: rows of null id are left out; null or empty vectors, zero vectors and vectors with a null, NaN or infinite coordinate have no
links and their own id as class; any other finite vector counts, however large or small its coordinates; vectors of different lengths aren't compared;
rows that repeat an id with equal vectors count once, with different ones the links of each add up and its classes join where it is their least
id; ties don't matter, as nothing is ranked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidframe.llm.common import c, components, ensure_checkpoint_dir, ensure_workers
from lucidframe.llm.tokens import U, mix

THRESHOLD = 0.975
BLOCK = 8
WIDE = 2.0
CELL_ROWS = 3_000  # vectors aimed at in a cell, their copies apart
CELL_MOST = 16_000  # rows of a cell beyond which it is cut into buckets
STEP = 127.0
EPS = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim + 1).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, block: int = BLOCK) -> list[tuple[int, int]]:
    n = max(1, round(dim / block))
    at = [dim * i // n for i in range(n + 1)]
    return list(zip(at, at[1:]))


def grid(n: int, dim: int, t: float, block: int = BLOCK) -> int:
    """Coordinates of a block that its grid uses."""
    width = WIDE * math.sqrt(2 * (1 - t) * block / dim)
    share = min(0.9, width * math.sqrt(dim) / 4.1)  # of the vectors in a slab on average, were they uniform directions
    return max(1, min(round(math.log(max(n / CELL_ROWS, 1.0)) / -math.log(share)), block, dim))


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square leaves the range of numbers
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated_bytes(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEP).astype(np.int8)


def placed(x: np.ndarray, parts: list[tuple[int, int]], dim: int, t: float, g: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, rows, cells): where rotated unit vectors x go."""
    for b, (lo, hi) in enumerate(parts):
        near = math.sqrt(2 * (1 - t) * (hi - lo) / dim) + EPS
        y = x[:, lo : min(lo + g, hi)]
        own = np.floor(y / (WIDE * near)).astype(np.int64)
        lower = np.floor((y - near) / (WIDE * near)).astype(np.int64) < own
        for below in itertools.product((0, 1), repeat=own.shape[1]):
            rows = np.flatnonzero((lower | (np.array(below) == 0)).all(axis=1))
            if not len(rows):
                continue
            key = np.full(len(rows), U(b * 1000003 + dim), np.uint64)
            for col, o in enumerate(below):
                key = mix(key + (own[rows, col] - o).view(np.uint64) * U(0x9E3779B97F4A7C15) + U(col + 1))
            yield b, rows, key


def rotated(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    turn = rotation(dim)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            yield part, part.column(1).flatten().to_numpy().reshape(-1, dim) @ turn


def cell_counts(dim: int, t: float, g: int):
    """cell, n: how many rows go to each cell, added up by part."""
    parts = cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in rotated(batches, dim):
            key, n = np.unique(np.concatenate([k for _, _, k in placed(x, parts, dim, t, g)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    return run


def cells(dim: int, t: float, g: int, hot: np.ndarray, buckets: np.ndarray):
    """cell, b, side, k, q: a row for each place of each vector; in cells cut into buckets, for each two buckets."""
    parts = cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in rotated(batches, dim):
            q = pa.array([r.tobytes() for r in rotated_bytes(x)], pa.binary())
            for b, rows, key in placed(x, parts, dim, t, g):
                side = np.zeros(len(rows), np.int8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    r = np.where(hot[at] == key, buckets[at], 1)
                    which = np.repeat(np.arange(len(rows)), r)
                    v = np.arange(len(which)) - np.repeat(np.cumsum(r) - r, r)
                    u = (mix(part.column(0).to_numpy()[rows].view(np.uint64)) % r.astype(np.uint64)).astype(np.int64)[which]
                    lo, hi = np.minimum(u, v).astype(np.uint64), np.maximum(u, v).astype(np.uint64)
                    rows, key = rows[which], np.where(r[which] > 1, mix(key[which] + lo * U(0x9E3779B97F4A7C15) + hi * U(0xC2B2AE3D27D4EB4F)), key[which])
                    side = np.where(u == v, 0, np.where(u < v, 1, 2)).astype(np.int8)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(rows), b, np.int32)), pa.array(side), part.column(0).take(take), q.take(take)], ["cell", "b", "side", "k", "q"])

    return run


def compare(dim: int, t: float, g: int):
    """a, b: pairs of a cell that may be within r."""
    parts = cuts(dim)
    starts = [lo for lo, _ in parts]
    radius = np.array([math.sqrt(2 * (1 - t) * (hi - lo) / dim) for lo, hi in parts])
    slack = np.array([math.sqrt(hi - lo) / STEP + 1e-4 for lo, hi in parts])
    all_near = (math.sqrt(2 * (1 - t)) + math.sqrt(dim) / STEP + 1e-4) ** 2 + 1e-4

    def run(group: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        side = group.column("side").to_numpy()
        if len(side) > 1 and (side[0] == 0 or side.min() < side.max()):
            q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32) / np.float32(STEP)
            block = group.column("b")[0].as_py()
            lo, hi = parts[block]
            along = q[:, min(lo + g, hi - 1)]
            order = np.argsort(along, kind="stable")
            q, along, side, k = q[order], along[order], side[order], group.column("k").to_numpy()[order]
            y = np.ascontiguousarray(q[:, lo:hi])
            yy = (y * y).sum(axis=1)
            near = (radius[block] + slack[block]) ** 2 + 1e-4
            stop = np.searchsorted(along, along + np.float32(radius[block] + 1 / STEP + 1e-4), "right")
            for s in range(0, len(q), 512):
                e = min(len(q), s + 512)
                far = stop[e - 1]
                d = yy[s:e, None] + yy[None, s:far] - 2 * (y[s:e] @ y[s:far].T)
                i, j = np.nonzero(d <= near)
                i, j = i + s, j + s
                keep = (i < j) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[keep], j[keep]
                for at in range(0, len(i), 200_000):
                    a, b = i[at : at + 200_000], j[at : at + 200_000]
                    diff = q[a] - q[b]
                    each = np.add.reduceat(diff * diff, starts, axis=1)
                    ok = each.sum(axis=1) <= all_near
                    # a pair that is within the radius of an earlier block for certain is found there
                    ok &= ~(np.sqrt(each[:, :block]) + slack[:block] < radius[:block]).any(axis=1)
                    found_a.append(k[a[ok]])
                    found_b.append(k[b[ok]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vector in place of each vector."""
    for batch in batches:
        v = batch.column(2)
        sizes = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty_like(flat)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            place = (at[rows][:, None] + np.arange(dim)).ravel()
            out[place] = unit(flat[place], int(dim)).ravel()
        u = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))
        yield pa.RecordBatch.from_arrays([*batch.columns, u], ["id", "copies", "v", "k", "u"])


def prepared(rows: DataFrame, id_col: str, vector: str, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, v) of every row with an id; those of sound vectors; id, copies, v, k, u of each class of equal ones."""
    if not 0 < t < 1:
        raise ValueError("threshold must be between 0 and 1")
    spark = rows.sparkSession
    ensure_workers(spark)
    ensure_checkpoint_dir(spark)
    v = c(vector)
    if rows.select(v.alias("v")).schema["v"].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    given = rows.where(c(id_col).isNotNull()).select(c(id_col).alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    classes = plain.dropDuplicates(["v", "id"]).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("id", "copies", "v", F.monotonically_increasing_id().alias("k"))
    schema = type(classes.schema)(list(classes.schema.fields)).add("u", T.ArrayType(T.DoubleType()))
    return given, plain, classes.mapInArrow(units, schema).checkpoint()


def linked(classes: DataFrame, t: float) -> DataFrame:
    """a, b (ids), ka, kb, copies_a, copies_b, cosine of linked classes."""
    spark, result = classes.sparkSession, None
    for dim, n in sorted(tuple(r) for r in classes.groupBy(F.size("u").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        own = classes.where(F.size("u") == dim).select("k", "u")
        g = grid(n, dim, t)
        # of cells with more than CELL_MOST rows there are at most rows / CELL_MOST
        many = own.mapInArrow(cell_counts(dim, t, g), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > CELL_MOST).toArrow()
        hot, buckets = many.column("cell").to_numpy().view(np.uint64), -(-many.column("n").to_numpy() * 2 // CELL_MOST)
        order = np.argsort(hot)
        spread = own.mapInArrow(cells(dim, t, g, hot[order], buckets[order]), "cell long, b int, side byte, k long, q binary")
        pairs = spread.groupBy("cell").applyInArrow(compare(dim, t, g), "a long, b long").distinct()
        result = pairs if result is None else result.unionByName(pairs)
    if result is None:
        result = spark.createDataFrame([], "a long, b long")
    ends = classes.select("k", "id", "copies", "u")
    both = result.join(ends.toDF("a", "ida", "copies_a", "ua"), "a").join(ends.toDF("b", "idb", "copies_b", "ub"), "b")
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    both = both.select(F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("a").alias("ka"), F.col("b").alias("kb"), "copies_a", "copies_b", F.least(cosine, F.lit(1.0)).alias("cosine"))
    return both.where(F.col("cosine") >= t - 1e-12)


def near_pairs(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", t: float = THRESHOLD) -> DataFrame:
    """vec_a, vec_b, cosine of linked classes of equal vectors: see the module."""
    found = linked(prepared(rows, id_col, vector, t)[2], t)
    return found.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"), "cosine")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", t: float = THRESHOLD) -> DataFrame:
    """vec_id, class_id, links: see the module."""
    given, plain, classes = prepared(rows, id_col, vector, t)
    found = linked(classes, t).select("a", "b", "ka", "kb", "copies_a", "copies_b").checkpoint()
    links = found.select(F.col("ka").alias("k"), F.col("copies_b").alias("n")).union(found.select("kb", "copies_a")).groupBy("k").agg(F.sum("n").alias("linked"))
    roots = components(found.select("a", "b"))
    several = classes.select("k", "id", "copies", "v").join(links, "k", "left").where("copies > 1 or linked is not null")
    several = several.join(roots.select(F.col("node").alias("id"), F.col("root").alias("class")), "id", "left")
    several = several.select("v", F.coalesce("class", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    own = plain.dropDuplicates(["v", "id"]).join(several, "v").select("id", "class_id", "links")
    alone = given.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return alone.union(own).groupBy(F.col("id").alias("vec_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD} - 1e-12),
reach AS (SELECT u, v FROM near UNION SELECT reach.u, near.v FROM reach JOIN near ON near.u = reach.v),
root AS (SELECT u, least(u, min(v)) AS root FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS links FROM near GROUP BY u)
SELECT vec_id, coalesce(root, vec_id) AS class_id, coalesce(links, 0)::BIGINT AS links FROM e LEFT JOIN root ON root.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
