import random

import numpy as np
import pyarrow as pa

from lucidframe.llm import quality as Q

DOCS = "doc_id long, text string, score double, quality_text string"


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        kind = rng.random()
        if kind < 0.6:
            out.append((" ".join(w).capitalize() + ".", 1))
        elif kind < 0.75:
            out.append((" ".join([w[0]] * 40), 0))
        elif kind < 0.9:
            out.append((" ".join(x.upper() + "!!" for x in w), 0))
        else:
            out.append((" ".join(x + rng.choice(["###", "$$$"]) for x in w), 0))
    return out


def test_held_out_accuracy_and_bounded_sample(spark):
    rows = texts(1, 1500)
    docs = spark.createDataFrame([(i, t, 0.0, "q") for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    found, y = Q.training_rows(docs, labels, "doc_id", "text", "quality", 400)
    assert len(found) == len(y) == 400
    model = Q.fit(found, y)
    held = texts(2, 600)
    s = Q.score_texts(model, pa.array([t for t, _ in held]))
    assert np.mean((s >= 0) == np.array([y == 1 for _, y in held])) > 0.98
    kept = Q.quality_filter(docs, labels, sample=400)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == (y == 1) for i, (_, y) in enumerate(rows)]) > 0.98


def brute_features(text):
    """Distinct words, bigrams and shape n-grams of a text, spelled out."""
    import re

    toks = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", text)
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    is_word = [bool(re.match(r"[A-Za-z0-9\x80-\U0010ffff]", t)) for t in toks]
    shapes, before = [], None
    for t, w in zip(toks, is_word):
        if not w:
            shapes.append(t)
            continue
        upper = sum("A" <= ch <= "Z" for ch in t)
        s = 4 if any("0" <= ch <= "9" for ch in t) else 3 if upper > 1 and upper * 2 > len(t.encode()) else 2 if "A" <= t[0] <= "Z" else 1
        shapes.append(s + 4 * (low(t) == before))
        before = low(t)
    words = [low(t) for t, w in zip(toks, is_word) if w]
    return len(set(words)), len(set(zip(words, words[1:]))), len({tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)})


def test_features_as_spelled_out():
    batch = ["The cat, the CAT!! the cat", "", "aa aa aa bb ÉÉ x1 x1", None, "one", "A b C d ... end--"]
    row, f = Q.features(pa.array(batch))
    for i, t in enumerate(batch):
        mine = f[row == i]
        words = int((mine < 1 << Q.BITS).sum())
        one, two, shapes = brute_features(t or "")
        assert words == one + two and len(mine) - words == shapes
        alone = Q.features(pa.array([t], pa.string()))[1]
        assert alone.tolist() == mine.tolist()


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 1]) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [np.arange(5)] * 60
    w = Q.descend(rows, list(x), y, np.ones(60), 5, epochs=5000, tolerance=1e-7)
    goal = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    best = min(goal(w + d) for d in rng.normal(size=(4000, 5)) * 0.03)
    assert goal(w) <= best + 1e-3


def test_edge_cases(spark):
    rows = texts(3, 300)
    docs = spark.createDataFrame([(i, t, 0.0, "q") for i, (t, _) in enumerate(rows)] + [(None, "words here", 1.0, "q"), (900, None, None, None), (901, "", None, None), (0, rows[0][0], 0.0, "q"), (902, "word " * 200_000, None, None)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (5, None), (7777, 0), (0, rows[0][1]), (1, 1 - rows[1][1])], "doc_id long, quality int")
    found, _ = Q.training_rows(docs, labels, "doc_id", "text", "quality", 4000)
    assert len(found) == 300  # id 1 has both labels; id 0 is there twice
    out = Q.classify(docs, Q.train(docs, labels))
    assert out.columns == [*docs.columns, "_score", "keep"]
    got = out.collect()
    assert len(got) == docs.count() and all(r._score is not None for r in got)
    empty = [r._score for r in got if r.doc_id in (900, 901)]
    assert empty[0] == empty[1]
    assert len({r._score for r in got if r.doc_id == 0}) == 1
    none = spark.createDataFrame([], labels.schema)
    assert Q.train(docs, none) is None and Q.quality_filter(docs, none).count() == docs.count()
    assert Q.quality_filter(docs.limit(0), labels).count() == 0
