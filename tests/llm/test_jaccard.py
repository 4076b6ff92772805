import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lucidframe.llm import jaccard as J
from lucidframe.llm.common import components
from lucidframe.llm.tokens import words

SCHEMA = "doc_id long, text string, node string, a long"


def grams(text, n=3):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, t=J.THRESHOLD, n=3):
    sets = [(i, grams(x, n)) for i, x, *_ in rows if i is not None and x is not None]
    sets = [(i, s) for i, s in sets if s]
    out = {}
    for k, (i, s) in enumerate(sets):
        for j, r in sets[:k]:
            if i != j and len(s & r) >= t * len(s | r) - 1e-9:
                key = (min(i, j), max(i, j))
                out[key] = max(out.get(key, 0), len(s & r) / len(s | r))
    return out


def joined(rows, t=J.THRESHOLD, n=3):
    """doc_id: (class_id, links); rows that repeat an id must have equal texts."""
    ids = {i for i, *_ in rows if i is not None}
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows, t, n):
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def result(df, **how):
    out = J.jaccard_join(df, **how)
    assert out.columns == ["doc_id", "class_id", "links"]
    rows = out.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def corpus(seed=1, groups=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 8, 20, 60, 200, 900]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 8])):
            doc = [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(vocabulary) for x in base]
            doc = doc[: max(1, len(doc) - rng.choice([0, 0, 1, len(doc) // 6]))]
            rows.append((k, " ".join(doc), "x", k))
            k += 1
    return rows


@pytest.mark.parametrize("t", [0.3, 0.5, 0.75, 0.9])
def test_classes_links_and_pairs_as_by_brute_force(spark, t):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, t)
    assert result(df, t=t) == joined(rows, t) and len(want) > 50
    least = {}
    for i, x, *_ in sorted(rows):
        least.setdefault(grams(x), i)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.jaccard_pairs(df, t=t).collect()}
    assert got == pytest.approx({k: j for k, j in want.items() if j < 1 and set(k) <= set(least.values())})


@pytest.mark.parametrize("t", [0.5, 0.6, 0.75, 0.9])
def test_every_ratio_of_sizes(spark, t):
    base = [f"p{i}" for i in range(400)]
    sizes = [*range(1, 40), *range(40, 130, 3), *range(130, 401, 11)]
    rows = [(k, " ".join(base[:k]), None, 0) for k in sizes]
    got = {(r.doc_a, r.doc_b) for r in J.jaccard_pairs(spark.createDataFrame(rows, SCHEMA), t=t).collect()}
    assert got == brute(rows, t).keys()


def test_what_changes_the_plan_changes_no_result(spark, monkeypatch):
    rows = corpus(5)
    df, want = spark.createDataFrame(rows, SCHEMA), joined(rows)
    for name, value in (("BROADCAST_MB", 0), ("BUCKET", 3), ("BUCKET_GRAMS", 500), ("SMALL", 3), ("HOT", 2), ("OFTEN", 1), ("CHUNK", 300), ("TASK_ROWS", 1000)):
        monkeypatch.setattr(J, name, value)
    assert result(df) == want
    monkeypatch.setattr(J, "frequent_ngrams", lambda docs, n: J.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64)))
    assert result(df) == want


def test_cells_of_a_hot_ngram_meet_in_pairs(monkeypatch):
    monkeypatch.setattr(J, "HOT", 40)
    fp = np.sort(np.random.default_rng(4).integers(0, 2**50, 300))
    g, at = np.tile(np.array([7 << 50], np.uint64), 300), np.arange(301)
    key, who = J.block_keys(g, at, fp, 0.5, J.Frequent(g[:1], np.array([300])), 9)
    assert len(key) == 300 * 7
    met = {(x, y) for k in set(key) for x in who[key == k].tolist() for y in who[key == k].tolist()}
    assert met == {(x, y) for x in fp.tolist() for y in fp.tolist()}
    stars = [r for b in J.candidates(key, who, 0.5) for r in b.to_pylist()]
    assert all(r["star"] for r in stars) and {r["b"] for r in stars} == set(fp.tolist())


def test_nulls_empty_texts_ties_and_repeated_rows(spark):
    same = "one two three four five six"
    rows = [(1, same, None, 1), (1, same, None, 1), (2, same.upper(), None, 2), (None, same, None, 3), (3, None, None, 3), (4, "", None, 4), (5, " !? ", None, 4), (6, "one", None, 4), (7, "One.", None, 5), (8, "one two", None, 5), (9, "one two three four five six seven", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 1), 7: (6, 1), 8: (8, 0), 9: (1, 2)}
    assert [tuple(r) for r in J.jaccard_pairs(df).collect()] == [(1, 9, 0.8)]
    kept = J.keep_one(df)
    assert kept.columns == ["doc_id", "text", "node", "a"]
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 1, 3, 4, 5, 6, 8]


def test_an_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g h", None, 0), (1, "p q r s t u v w", None, 0), (2, "p q r s t u v w", None, 0), (3, "a b c d e f g h i", None, 0)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == {1: (1, 2), 2: (1, 1), 3: (1, 1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert J.jaccard_join(empty).count() == J.jaccard_pairs(empty).count() == 0
    assert J.keep_one(empty).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long), None, 0), (2, " ".join(long[:-2000]), None, 0), (3, " ".join(long[:29_000]), None, 0)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_groups_of_many_copies(spark):
    base = [f"k{i}" for i in range(150)]
    rows = [(i, " ".join(base), None, 0) for i in range(500)] + [(1000 + i, " ".join(base[:i] + ["new"] + base[i + 1 :]), None, 0) for i in range(0, 150, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == {i: (0, 574) for i, *_ in rows}
    assert [r.doc_id for r in J.keep_one(df).collect()] == [0]


def test_its_sql_on_near_copies(spark):
    import duckdb

    rows = corpus(9)
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    assert {r[0]: r[1:] for r in con.sql(J.oracle_sql()).fetchall()} == joined(rows) == result(spark.createDataFrame(rows, SCHEMA))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == want


def test_pairs_and_stars_of_blocks():
    rng = np.random.default_rng(1)
    key, fp = rng.integers(0, 3000, 20_000), rng.integers(0, 50, 20_000)
    key = np.concatenate((key, np.full(40, 5000), np.full(30, 5001)))
    fp = np.concatenate((fp, np.arange(40), np.arange(7, 37)))
    pairs, stars = {}, {}
    for k in np.unique(key):
        u = np.unique(fp[key == k]).tolist()
        for x in u if len(u) > J.SMALL else ():
            stars[u[0], x] = stars.get((u[0], x), 0) + 1
        for i in range(len(u) if len(u) <= J.SMALL else 0):
            for j in range(i):
                pairs[u[j], u[i]] = pairs.get((u[j], u[i]), 0) + 1
    got = [r for b in J.candidates(key, fp, 0.5) for r in b.to_pylist()]
    assert {(r["a"], r["b"]): r["n"] for r in got if not r["star"]} == pairs
    assert {(r["a"], r["b"]): r["n"] for r in got if r["star"]} == stars and len(stars) == 70


def test_products_and_intersections():
    rng = np.random.default_rng(2)
    members = [np.unique(rng.integers(0, 300, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    want = np.array([[len(np.intersect1d(x, y)) for y in members] for x in members])
    assert (J.products(members) * (1 - np.eye(40)) == want * (1 - np.eye(40))).all()
    a, b = rng.integers(0, 20, 30), rng.integers(20, 40, 30)
    assert (J.intersections(members, a, b) == want[a, b]).all()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = words(pa.array(["Ab cd", None, "", "x-AB, ÉTÉ été ab", "z" * 5000 + " ab"]))
    spelled = ["ab", "cd", "x", "ab", "été", "été", "ab", "z" * 5000, "ab"]
    assert len(w.hash) == len(spelled)
    for i in range(len(spelled)):
        for j in range(i):
            assert (w.hash[i] == w.hash[j]) == (spelled[i] == spelled[j])


def test_ngrams_that_meet_by_chance_make_few_candidates(spark, monkeypatch):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    rows = [(k, " ".join(f"r{rng.randrange(10**9)}" if rng.random() < 0.4 else rng.choice(common) for _ in range(300)), None, 0) for k in range(150)]
    rows += [(1000, rows[0][1] + " and more", None, 0)]
    docs = J.prepared(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 0.5)
    monkeypatch.setattr(J, "FREQUENT", 0)  # as in a corpus of more frequent n-grams than are counted
    found = J.blocks(docs, 3, 0.5, J.frequent_ngrams(docs, 3), 2).mapInArrow(J.meeting(0.5), "a long, b long, n long, star boolean").collect()
    assert sum(r.n for r in found if r.n > 50) > 100
    assert len(found) < 500
    assert result(spark.createDataFrame(rows, SCHEMA)) == joined(rows)
    assert (J.emitted(np.arange(8, 33), 0.5) < np.arange(8, 33)).all()


def test_least_joined():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (50, 20), (300, 280), (40, 700)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert J.least_joined(n, a, b).tolist() == want.tolist()
    chain = np.random.default_rng(7).permutation(5000)
    assert (J.least_joined(5000, chain[1:], chain[:-1]) == 0).all()
