"""Column functions of the semantic engine; all run in the JVM but fnv1a64, which is an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_WORDS = 384
OVERLAP_WORDS = 48
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64_bytes(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_many(texts: list[str]) -> np.ndarray:
    """FNV-1a of many texts, one vector step a byte position."""
    raw = [t.encode() for t in texts]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    lengths = np.array([len(raw[i]) for i in order], np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
    h = np.full(len(raw), _OFFSET, np.uint64)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(raw) and lengths[0] else []
    for p, n in enumerate(alive):
        h[:n] = (h[:n] ^ data[at[:n] + p]) * np.uint64(_PRIME)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return out.view(np.int64)


def fnv1a64(col: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes, as a signed number."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype="Int64")
        there = texts.notna()
        if there.any():
            out[there] = fnv1a64_many(texts[there].tolist())
        return out

    return run(col)


def hex16(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def doc_hash(col: Column) -> Column:
    """Identity of a text within the engine."""
    return F.xxhash64(col)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine similarity of vectors to one vector, by batches; 0 where a norm is 0, null for null."""
    q = np.asarray(query, np.float64)
    length = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        there = vectors.notna().to_numpy()
        out = np.full(len(vectors), np.nan)
        if there.any():
            x = np.stack(vectors[there].to_numpy()).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1)) * length
            out[there] = np.divide((x * q).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
        return pd.Series(out).where(there, None)

    return run(v)


def normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def chunks(text: Column, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Windows of words, each overlapping the one before; none for a text of white space."""
    step = words - overlap

    def windows(w: Column) -> Column:  # w is bound: a text is split once, however many windows it has
        last = F.greatest(F.ceil((F.size(w) - words) / F.lit(step)).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, words), " "))

    split = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    whole = F.filter(F.array(split), lambda w: F.size(w) > 0)
    return F.coalesce(F.flatten(F.transform(whole, windows)), F.array().cast("array<string>"))
