import base64
import math
import random

import pytest

from lucidframe.llm import bpe, mixing

TEXTS = ["Hello, world! I'll don't", "", "  spaces\n\n\tand tabs  ", "été naïve ß 漢字 🙂", "a" * 3000, "x1234567 y", None, "<|endoftext|>", "Á\u0000b"]


def reference():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_like_a_public_tokenizer_and_decodes_back():
    own, other = bpe.BPE(), reference()
    rng = random.Random(1)
    random_texts = ["".join(rng.choice("abcdeth 'sé漢\n.,!12") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for t in [t for t in TEXTS if t is not None] + random_texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t


def test_ascii_texts_are_cut_alike():
    own, rng = bpe.BPE(), random.Random(9)
    every = "".join(map(chr, range(128)))
    for _ in range(3000):
        t = "".join(rng.choice(every if rng.random() < 0.5 else " \n'abAB12.,\tstlvermd") for _ in range(rng.randint(0, 40)))
        assert own.find_ascii(t) == own.find(t)
    assert own.find_ascii(every) == own.find(every)


def test_merge_without_the_whole_token_is_greedy_by_rank():
    own = bpe.BPE()

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranks = [(own.ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == math.inf:
                return [own.ranks[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("aehilnorst") for _ in range(rng.randint(1, 40))).encode()
        if piece not in own.ranks:
            assert own.merge(piece) == slow(piece)


def test_bpe_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "abc", None), (1, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = bpe.bpe_encode(df, decode=True).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None and r.text) == sorted((i, t) for i, t, _ in rows if i is not None and t)
    assert [r.n_tokens for r in out if r.text is None] == [None] and [r.n_tokens for r in out if r.text == ""] == [0, 0]
    assert all(r.n_tokens == len(r.tokens) for r in out if r.tokens is not None)
    back = bpe.bpe_decode(bpe.bpe_encode(df)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t) for i, t, _ in rows}
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no token"):
        bpe.bpe_decode(spark.createDataFrame([(1, [50256])], "doc_id long, tokens array<int>")).collect()


def poisson(seed, key, rate):
    import hashlib

    u = (int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p = 0, math.exp(-rate)
    below = p
    while below <= u:
        k += 1
        p *= rate / k
        below += p
    return k


def test_mixing_as_by_hand(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b", "q") for i in range(2000)] + [(None, "n", "a", "q"), (5000, None, None, "q"), (3, "t3", "a", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    out = mixing.poisson_mix(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "_copy"]
    n = {s: sum(r[2] == s for r in rows) for s in ("a", "b", None)}
    total = sum(x**0.5 for x in n.values())
    rate = {s: x**0.5 / total * len(rows) / x for s, x in n.items()}
    want = {}
    for i, t, s, _ in rows:
        want[i, t] = want.get((i, t), 0) + poisson(mixing.SEED, "" if i is None else i, rate[s])
    got = {}
    for r in out.collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    again = [tuple(r) for r in mixing.poisson_mix(df).collect()]
    assert again == [tuple(r) for r in out.collect()]


def test_mixing_reaches_given_weights_and_shuffles(spark):
    df = spark.createDataFrame([(i, "a" if i < 9000 else "b" if i < 9900 else "c") for i in range(10_000)], "doc_id long, source string")
    rows = mixing.poisson_mix(df, weights={"a": 1, "b": 1}, size=2.0, copy_col=None).collect()
    n = {s: sum(r.source == s for r in rows) for s in "abc"}
    assert n["c"] == 0 and abs(n["a"] - 10_000) < 400 and abs(n["b"] - 10_000) < 500
    thirds = [sum(r.source == "b" for r in rows[k :: 1][: len(rows) // 3]) for k in (0, len(rows) // 3, 2 * len(rows) // 3)]
    assert max(thirds) < 1.15 * min(thirds)
    ids = [r.doc_id for r in rows if r.source == "a"]
    assert sum(x < y for x, y in zip(ids, ids[1:])) < 0.6 * len(ids)


def test_mixing_without_broadcast_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7}", None) for i in range(500)], "doc_id long, source string, text string")
    want = sorted(map(str, mixing.poisson_mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.poisson_mix(df).collect())) == want
    assert mixing.poisson_mix(df.limit(0)).count() == 0
