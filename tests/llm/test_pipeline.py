import random

import pyarrow as pa
import pytest

import corpus_pipeline as CP
from lucidframe.llm import bpe, mixing, pii, quality
from lucidframe.llm.common import table
from tests.llm.test_bpe_mixing import poisson
from tests.llm.test_jaccard import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rt", "sh", "l")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(15, 90))]
        if i % 7 == 0:
            text, good = " ".join(x.upper() + "!!" for x in w), 0
        else:
            text, good = " ".join(w), 1
        if i % 10 == 3:
            text += f" write to {w[0]}.{i}@mail.example.com or 10.2.{i % 250}.9"
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c"]), len(text)))
        if i < 250:
            labels.append((i, good, 0))
        if i % 20 == 5:
            copy = w[:]
            copy[3] = "changed"
            rows.append((1000 + i, " ".join(copy) if i % 40 == 5 else text, "en", "b", len(text)))
    rows += [(5000, "", "en", "a", 0), (None, "some words of a row without id", "en", None, 30), (5001, None, None, "a", None)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_by_hand_and_the_whole(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    assert [n for n, _ in CP.STAGES] == ["quality_classifier", "near_duplicates", "personal_data", "mixing_sources", "encoding"]
    stages = dict(CP.STAGES)

    def run(name, given):
        path = str(tmp_path / name)
        stages[name](spark, given, folder).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "encoding":
            assert out.columns == COLUMNS
        return out

    good = run("quality_classifier", docs)
    model = quality.train(docs, labels)
    want = [tuple(r) for r in docs.collect() if quality.score_texts(model, pa.array([r.text], pa.string()))[0] >= 0]
    assert rows_of(good) == sorted(want, key=str)
    assert not any("!!" in (r.text or "") for r in good.collect()) and good.where("doc_id < 1000").count() > 330

    unique = run("near_duplicates", good)
    rows = [tuple(r) for r in good.collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute([r[:2] for r in rows]):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert rows_of(unique) == sorted((r for r in rows if r[0] is None or find(r[0]) == r[0]), key=str)
    assert unique.count() < good.count()

    private = run("personal_data", unique)
    field = pii.trained()
    want = []
    for i, t, lang, source, n in rows_of(unique):
        new = t and pii.redacted(t, pii.find(field, pa.array([t]))[0])
        want.append((i, new, lang, source, None if new is None else len(new)))
    assert rows_of(private) == sorted(want, key=str)
    assert not any("@" in (r.text or "") or "10.2." in (r.text or "") for r in private.collect())

    mixed = run("mixing_sources", private)
    rows = rows_of(private)
    n = {s: sum(r[3] == s for r in rows) for s in {r[3] for r in rows}}
    total = sum(x**0.5 for x in n.values())
    want = [r for r in rows for _ in range(poisson(mixing.SEED, "" if r[0] is None else r[0], n[r[3]] ** 0.5 / total * len(rows) / n[r[3]]))]
    assert rows_of(mixed) == sorted(want, key=str)

    tokens = run("encoding", mixed)
    own = bpe.BPE()
    assert sorted((r.doc_id, r.tokens) for r in tokens.where("doc_id is not null and tokens is not null").collect()) == sorted((r.doc_id, own.encode(r.text)) for r in mixed.where("doc_id is not null and text is not null").collect())
    assert rows_of(CP.run(spark, folder)) == rows_of(tokens)


def test_stages_of_an_empty_table(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for name, stage in CP.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "encoding" or out.columns == COLUMNS)


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(40)]
        for k in range(1 + g % 4):
            doc = base[:]
            doc[rng.randrange(40)] = f"other{g}{k}"
            rows.append((g * 10 + k, " ".join(doc if k else base), "en", "a", 0))
            if k == 2:
                rows.append((g * 10 + 5, " ".join(doc), "en", "b", 0))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, DOC_a long")
    kept = CP.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [g * 10 for g in range(12)]
