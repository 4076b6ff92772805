"""Quality classifier: naive Bayes support vectors (NB-SVM) over n-gram indicators.

Features of a text are the n-grams that occur in it, as indicators: word 1- and 2-grams, and 1- to 3-grams of token
shapes (case, digits, the same word as before, or a run of signs itself). Each feature is scaled by its log-count ratio
r = log((a + p) / |a + p|) - log((a + q) / |a + q|), p and q counting the good and bad training texts that have it; a text is
divided by its norm. A linear model with hinge loss is fitted by dual coordinate descent, and its weights are interpolated
with their mean magnitude.

The model is fitted on at most SAMPLE labelled ids, taken by hash (the bound is the parameter sample), on their whole texts; every row is scored, on
its whole text. The driver holds 4 bytes a distinct feature of the sample's texts.

Defined results: a null or empty text has no feature and the model's intercept as score; a null id is scored and never
trained on; repeated rows are scored alike; labels without documents, null labels and repeated label rows with the
same label don't count more; an id labelled both 0 and 1 isn't trained on; with fewer than two classes of labels all rows get score 0 and are kept; a score of exactly 0 (a tie) is
kept; texts of any length count whole; an empty table gives an empty table; other columns pass through, and new columns that would clash take a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import c, ensure_workers, fresh, release
from lucidframe.llm.tokens import CODE, STEP, U, IS_WORD, mix, pieces, powers, raw

SAMPLE = 4_000
BITS = 21  # word features are hashed to 2 ** BITS buckets
SHAPES = 1 << 12  # shape features to these
SMOOTH = 1.0
C = 1.0
BETA = 0.5  # share of the fitted weights, the rest is their mean magnitude
EPOCHS = 30
LEAST = 2  # training texts a feature must occur in

_rng = np.random.default_rng(77)
_LOWER = CODE.copy()
_LOWER[65:91] = CODE[97:123]
_other = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.where(IS_WORD, _LOWER, _other)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER[_SPACE] = 0
_KIND = np.where(_SPACE, 0, np.where(IS_WORD, 1, 2)).astype(np.uint8)
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """doc, hash, is_word, shape of each token (a run of word characters or of signs), and each text's first token."""
    data, at = raw(texts)
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e.astype(bool), e.astype(np.uint64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(new & (kind > 0))
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e.astype(bool), e.astype(np.uint64), first
    up, down = powers(len(data) + 1)
    h = mix(np.add.reduceat(_LOWER[data] * up[: len(data)], start) * down[start])
    word = kind[start] == 1
    upper = np.add.reduceat(_UPPER[data], start)
    digit = np.add.reduceat(_DIGIT[data], start) > 0
    length = np.add.reduceat((kind > 0).astype(np.int32), start)
    begins = _UPPER[data[start]] > 0
    shape = np.where(digit, 4, np.where((upper > 1) & (upper * 2 > length), 3, np.where(begins, 2, 1)))
    where = np.flatnonzero(word)
    again = np.zeros(len(start), bool)
    if len(where) > 1:
        again[where[1:]] = (h[where[1:]] == h[where[:-1]]) & (doc[where[1:]] == doc[where[:-1]])
    shape = np.where(again, shape + 4, shape)
    shape = np.where(word, mix(shape.astype(np.uint64) + U(11)), h)  # signs stand for themselves
    return doc, h, word, shape, first


def features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, feature) of every distinct feature of every text, sorted; known: features to keep."""
    doc, h, word, shape, _ = tokens(texts)
    n = len(texts)
    wd, wh = doc[word], h[word]
    two = mix(wh[:-1] * STEP[0] + wh[1:] * STEP[1])
    same = wd[:-1] == wd[1:]
    ids = np.concatenate((wh >> U(64 - BITS), two[same] >> U(64 - BITS))).astype(np.int64)
    where = np.concatenate((wd, wd[:-1][same]))
    if known is not None:
        keep = known[ids]
        ids, where = ids[keep], where[keep]
    key = np.unique((where << (BITS + 1)) | ids)
    has = np.zeros((n, SHAPES), bool)
    g, last = shape * STEP[2], doc
    for k in range(3):
        if k:
            g = g[:-1] + shape[k:] * STEP[2 + k]
            last = doc[k:]
        ok = doc[: len(g)] == last
        has[doc[: len(g)][ok], (mix(g[ok] + U(k)) >> U(52)).astype(np.int64)] = True
    row, col = np.nonzero(has)
    col = col + (1 << BITS)
    if known is not None:
        keep = known[col]
        row, col = row[keep], col[keep]
    key = np.concatenate((key, (row.astype(np.int64) << (BITS + 1)) | col))
    key.sort()
    return key >> (BITS + 1), key & ((1 << (BITS + 1)) - 1)


@dataclass
class Model:
    ids: np.ndarray  # known features
    ratio: np.ndarray  # their log-count ratios
    weight: np.ndarray
    intercept: float

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.zeros((1 << BITS) + SHAPES, bool)
        known[self.ids] = True
        r, wr = np.zeros(len(known), np.float32), np.zeros(len(known), np.float32)
        r[self.ids] = self.ratio
        wr[self.ids] = self.ratio * self.weight
        return known, r, wr


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, n: int, epochs: int = EPOCHS, seed: int = 5, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i) by dual coordinate descent."""
    w, alpha = np.zeros(n), np.zeros(len(rows))
    square = np.array([v @ v for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] <= 0:
                continue
            f, v = rows[i], values[i]
            slope = y[i] * (w[f] @ v) - 1
            a = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if a != alpha[i]:
                w[f] += (a - alpha[i]) * y[i] * v
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < tolerance:
            break
    return w


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model | None:
    """rows: distinct features of each training text; good: its label."""
    if not len(rows) or good.all() or not good.any():
        return None
    size = (1 << BITS) + SHAPES
    p = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(good)]).astype(np.int64), minlength=size).astype(float)
    q = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(~good)]).astype(np.int64), minlength=size).astype(float)
    ids = np.flatnonzero(p + q >= LEAST)
    p, q = SMOOTH + p[ids], SMOOTH + q[ids]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    place = np.full(size, -1)
    place[ids] = np.arange(len(ids))
    fs, vs = [], []
    for r in rows:
        f = place[r]
        f = f[f >= 0]
        v = ratio[f]
        v = v / max(np.linalg.norm(v), 1e-12)
        fs.append(np.append(f, len(ids)))  # the intercept
        vs.append(np.append(v, 1.0))
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, C * len(y) / (2 * good.sum()), C * len(y) / (2 * (~good).sum()))
    w = descend(fs, vs, y, cost, len(ids) + 1)
    b, w = w[-1], w[:-1]
    w = (1 - BETA) * np.abs(w).mean() + BETA * w
    return Model(ids, ratio, w, BETA * b)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    ensure_workers(docs.sparkSession)
    there = docs.where(c(text).isNotNull()).select(c(id_col).alias("id")).where("id is not null").distinct()
    given = labels.select(c(id_col).alias("id"), c(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    given = given.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    chosen = given.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)  # ids only
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), given.schema)
    texts = docs.select(c(id_col).alias("id"), c(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for _, part in pieces(batch.column(2)):
                row, f = features(part)
                out += np.split(f, np.searchsorted(row, np.arange(1, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.int32).tobytes() for x in out], pa.binary())], ["h", "y", "f"])
        release()

    found = texts.select(F.xxhash64("id").alias("h"), "y", "text").mapInArrow(run, "h long, y int, f binary")
    # features are made once, in parallel; a few of these partitions at a time come to the driver
    rows = sorted((r.h, r.f, r.y) for r in found.repartition(16, "h").toLocalIterator(prefetchPartitions=True))
    return [np.frombuffer(f, np.int32) for _, f, _ in rows], np.array([y == 1 for _, _, y in rows], bool)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    return fit(*training_rows(docs, labels, id_col, text, label, sample))


def score_texts(model: Model | None, texts: pa.Array, table=None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    known, r, wr = table or model.table()
    out = np.empty(len(texts))
    for a, part in pieces(texts):
        row, f = features(part, known)
        norm = np.bincount(row, r[f].astype(float) ** 2, len(part))
        dot = np.bincount(row, wr[f].astype(float), len(part))
        out[a : a + len(part)] = dot / np.maximum(np.sqrt(norm), 1e-12) + model.intercept
    return out


def classify(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score", keep: str = "keep") -> DataFrame:
    """docs with the score and whether the document is kept (score of 0 at least)."""
    ensure_workers(docs.sparkSession)
    score, keep, t = fresh(docs, score, keep, "quality_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table() if model else None
        for batch in batches:
            s = score_texts(model, batch.column(batch.num_columns - 1), table)
            columns = batch.columns[:-1] + [pa.array(s, pa.float64()), pa.array(s >= 0)]
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    names = [*docs.columns, score, keep]
    schema = docs.schema
    given = docs.withColumn(t, c(text).cast("string"))
    for n, kind in ((score, "double"), (keep, "boolean")):
        schema = type(schema)(list(schema.fields)).add(n, kind)
    return given.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps."""
    scored = classify(docs, train(docs, labels, id_col, text, label, sample), text, "quality_score", "quality_keep")
    return scored.where(c(scored.columns[-1])).select(*[c(x) for x in docs.columns])
