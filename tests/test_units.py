import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.errors import SemanticError
from lucidframe.functions.columns import chunks, cosine, fnv1a64, fnv1a64_bytes, fnv1a64_many, hex16
from lucidframe.model import http as H
from lucidframe.model.base import Failure, Mock, Request, json_object, score_of, yes_or_no
from lucidframe.operators.semantic import greedy_groups, threshold_for
from lucidframe.operators.types import FieldType
from lucidframe.sql.ddl import semantic_ddl
from lucidframe.sql.desugar import desugar, trailing
from lucidframe.operators.types import TypeRegistry
from lucidframe.sql.tokens import split_statements


def test_hash_goldens(spark):
    want = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "hello world": 0x779A65E7023CD2E7}
    for t, h in want.items():
        assert fnv1a64_bytes(t.encode()) == h
    texts = ["", "a", "hello world", "é" * 1000, "b" * 17, ""]
    assert fnv1a64_many(texts).view(np.uint64).tolist() == [fnv1a64_bytes(t.encode()) for t in texts]
    rows = spark.createDataFrame([(t,) for t in ["hello world", None, "a"]], "t string").select("t", hex16(fnv1a64(F.col("t"))).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {"hello world": "779a65e7023cd2e7", None: None, "a": "af63dc4c8601ec8c"}


def test_chunks_of_800_words(spark):
    text = " ".join(f"w{i}" for i in range(800))
    df = spark.createDataFrame([(text,), ("  ",), ("one",), (None,), (" ".join(["x"] * 384),), (" ".join(["x"] * 385),)], "t string")
    got = [r[0] for r in df.select(chunks(F.col("t"))).collect()]
    assert [len(c.split()) for c in got[0]] == [384, 384, 128] and got[0][1].split()[0] == "w336"
    assert got[1] == [] and got[2] == ["one"] and got[3] == [] and [len(c.split()) for c in got[5]] == [384, 49] and len(got[4]) == 1


def test_cosine_of_zero_vectors(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == 0.0 and abs(r[1][0] - 0.5**0.5) < 1e-12


def test_answers():
    assert [yes_or_no(x) for x in ("Yes.", " **no** ", "maybe", "", "YES", "yes it is")] == [True, False, None, None, True, None]
    assert json_object('```json\n{"a": 1}\n```') == {"a": 1} and json_object("[1]") is None and json_object("x") is None
    assert [score_of(x) for x in ('{"score": 2}', '{"score": -1}', '{"score": "a"}', '{"score": 0.25}', '{"score": true}', "x")] == [1.0, 0.0, None, 0.25, None, None]


@pytest.mark.parametrize(
    "target,scored,unindexed,lost,want,recall",
    [(0.9, [], 0, 0, 0.35, 1.0), (0.5, [0.9, 0.8, 0.7, 0.6], 0, 0, 0.8, 0.5), (1.0, [0.9, 0.8], 0, 0, 0.8, 1.0), (0.9, [0.9, 0.2], 0, 1, 0.2, 2 / 3), (0.5, [0.9], 3, 0, 0.35, 1.0), (0.75, [0.9, 0.8, 0.1], 1, 0, 0.8, 0.75), (0.5, [0.7, 0.7, 0.7], 0, 0, 0.7, 1.0)],
)
def test_calibration(target, scored, unindexed, lost, want, recall):
    threshold, got = threshold_for(target, scored, unindexed, lost)
    assert threshold == want and abs(got - recall) < 1e-9


def test_greedy_groups_join_the_most_similar():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [0.7, 0.7], [0, 0]], float)
    assert greedy_groups(v, 0.9).tolist() == [0, 0, 2, 2, 4, 5]


def test_field_types_check_values():
    cases = [
        (FieldType("int"), 3, 3), (FieldType("int"), 3.0, None), (FieldType("int"), True, None), (FieldType("real"), 3, 3.0), (FieldType("real", low=0, high=1), 1, 1.0), (FieldType("real", low=0, high=1), 1.1, None),
        (FieldType("bool"), 1, None), (FieldType("text"), 1, None), (FieldType("oneof", ("Ab", "c")), "aB", "Ab"), (FieldType("oneof", ("Ab",)), "x", None), (FieldType("int", array=True), [1, "x", 2], [1, 2]), (FieldType("int", array=True), 1, None),
    ]
    for kind, value, want in cases:
        assert kind.check(value) == want


def test_ddl_round_trip_and_errors():
    t = semantic_ddl("CREATE SEMANTIC TYPE T AS (a TEXT[] 'it''s', TOGETHER(b ONEOF(x, y) 'b', c REAL CHECK (-1..2.5) 'c'), d LEVEL(lo, hi) 'd', e BOOL 'e');")
    assert [f.render() for f in t.fields] == ["a TEXT[] 'it''s'", "b ONEOF(x, y) 'b'", "c REAL CHECK (-1..2.5) 'c'", "d LEVEL(lo, hi) 'd'", "e BOOL 'e'"]
    assert [[f.name for f in u] for u in t.units(["c"])] == [["b", "c"]] and len(t.units()) == 4
    assert semantic_ddl('create semantic index on "T x"(body)') == ("T x", "body")
    assert semantic_ddl("SELECT 1") is None
    for bad, text in [
        ("CREATE SEMANTIC TYPE T AS (a TEXT)", "single quotes"), ("CREATE SEMANTIC TYPE T AS (a TEXT 'x', a INT 'y')", "twice"), ("CREATE SEMANTIC TYPE T AS (a ONEOF(x, X) 'd')", "twice"), ("CREATE SEMANTIC TYPE T AS (TOGETHER(a INT 'x'))", "two fields"),
        ("CREATE SEMANTIC TYPE T AS (a INT[][] 'x')", "one"), ("CREATE SEMANTIC TYPE T AS (a Other 'x')", "nested"), ("CREATE SEMANTIC TYPE T AS (a REAL CHECK (x) 'd')", "low..high"), ("CREATE SEMANTIC INDEX t(c)", "expected"), ("CREATE SEMANTIC PREDICATE p", "not supported"),
    ]:
        with pytest.raises(SemanticError, match=text):
            semantic_ddl(bad)


def test_statement_splitting():
    sql = "SELECT ';'; SELECT \"a;b\" -- c;\n; /* x; /* y; */ z; */ SELECT $t$;$t$; ;"
    assert split_statements(sql) == ["SELECT ';'", 'SELECT "a;b" -- c;', "/* x; /* y; */ z; */ SELECT $t$;$t$"]


def test_desugaring():
    types = TypeRegistry()
    types.add(semantic_ddl("CREATE SEMANTIC TYPE T AS (f TEXT 'x')"))
    cases = {
        "SELECT a || b MEANS 'x' AND c": "SELECT means(a || b, 'x') AND c",
        "SELECT 1 FROM t WHERE x = 1 AND lower(b) MEANS 'it''s'": "SELECT 1 FROM t WHERE x = 1 AND means(lower(b), 'it''s')",
        "SELECT b RELEVANCE TO 'q' AS s FROM t": "SELECT relevance(b, 'q') AS s FROM t",
        "SELECT n FROM t GROUP BY MEANING OF b INTO 3 AS topic": "SELECT n FROM t GROUP BY meaning_of(b, 3, 'topic')",
        "SELECT MEANING OF b AS m FROM t": "SELECT meaning_of(b) AS m FROM t",
        "SELECT SEMANTIC DISTINCT ON (a, b) c FROM t": "SELECT DISTINCT ON (semantic_key(a), semantic_key(b)) c FROM t",
        "SELECT CAST(x AS T).f, CAST(x AS t), CAST(x AS INT) FROM t": "SELECT sem_extract_field(x, 'T', 'f'), sem_extract(x, 't'), CAST(x AS INT) FROM t",
        "SELECT EXTRACT(who TEXT 'who' FROM b), EXTRACT(YEAR FROM d)": "SELECT sem_extract_inline(b, 'who', 'TEXT', 'who'), EXTRACT(YEAR FROM d)",
        'SELECT "means", relevance, semantic FROM t': 'SELECT "means", relevance, semantic FROM t',
        "SELECT 'a MEANS b' FROM t": "SELECT 'a MEANS b' FROM t",
    }
    for sql, want in cases.items():
        assert desugar(sql, types) == want
    assert trailing("SELECT 1 WITH SIMILARITY 0.5 WITH RECALL 1;") == ("SELECT 1", {"SIMILARITY": 0.5, "RECALL": 1.0})
    assert trailing("WITH x AS (SELECT 1) SELECT * FROM x") == ("WITH x AS (SELECT 1) SELECT * FROM x", {})
    for bad, text in (("SELECT 1 WITH RECALL 0", "in \\(0, 1\\]"), ("SELECT 1 WITH RECALL 1.5", "in \\(0, 1\\]"), ("SELECT 1 WITH RECALL x", "expects a number"), ("SELECT 1 WITH SPEED 1", "expected RECALL or SIMILARITY"), ("SELECT 1 WITH RECALL 1 WITH RECALL 1", "twice"), ("SELECT 1 WITH RECALL 1 x", "trailing")):
        with pytest.raises(SemanticError, match=text):
            trailing(bad)
    for bad, text in (("SELECT a MEANS b", "string literal"), ("SELECT SEMANTIC DISTINCT a", "no column"), ("SELECT 1 GROUP BY MEANING OF a INTO 0", "positive number"), ("SELECT CAST(x AS T).f.g", "single field")):
        with pytest.raises(SemanticError, match=text):
            desugar(bad, types)


def test_http_retries_and_failures(monkeypatch):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append(self.path)
            if len(seen) == 1:
                self.send_response(429)
                self.send_header("retry-after", "0")
                self.end_headers()
                return
            out = {"message": {"content": "yes"}} if "chat" in self.path else {"embeddings": [[1.0]] * len(body["input"])}
            if body.get("messages", [{}])[-1].get("content") == "bad":
                self.send_response(400)
                self.end_headers()
                return
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = H.Ollama(url=f"http://127.0.0.1:{server.server_port}")
    assert model.embed(["a", "b"]) == [[1.0], [1.0]] and len(seen) == 2
    good, bad = model.complete([Request("i", "fine", 8), Request("i", "bad", 8)])
    assert good == "yes" and isinstance(bad, Failure) and "400" in bad.reason
    server.shutdown()
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    with pytest.raises(H.ProviderError, match="VOYAGE_API_KEY"):
        H.Voyage().embed(["a"])


def test_mock_embeddings():
    assert Mock().embed(["\x01" * 17])[0][:2] == pytest.approx([2 / 255, 1 / 255])
    assert Mock(themes=["a", "b"]).embed(["b", "x"]) == [[0.0, 1.0] + [0.0] * 14, [0.0] * 15 + [1.0]]


def test_greedy_representatives_in_rounds_equal_one_pass(spark, monkeypatch):
    from lucidframe.model.base import Mock
    from lucidframe.operators import semantic as S
    from lucidframe.operators.context import Semantic

    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 6))
    v = np.concatenate([base[rng.integers(0, 25, 300)] + rng.normal(size=(300, 6)) * rng.choice([0, 0.05, 0.2, 0.5], (300, 1)), np.zeros((2, 6))])
    h = sorted(rng.choice(2**40, len(v), replace=False).tolist())
    df = spark.createDataFrame([(int(x), i, [float(y) for y in row]) for i, (x, row) in enumerate(zip(h, v))], "h long, f long, v array<double>").repartition(5)
    for similarity in (0.8, 0.95):
        want = S.greedy_groups(v, similarity)
        for prefix in (4096, 40, 7):
            monkeypatch.setattr(S, "PREFIX", prefix)
            got = dict(tuple(r) for r in S.greedy_representatives(Semantic(spark, Mock()), df, similarity).collect())
            assert [got.get(x, i) for i, x in enumerate(h)] == want.tolist()
    assert S.greedy_representatives(Semantic(spark, Mock()), df.limit(0), 0.9).count() == 0


def test_chunks_of_a_long_text_cost_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from lucidframe.functions.columns import chunks

    def seconds(n):
        df = spark.createDataFrame([("word " * n,)], "t string")
        begun = time.perf_counter()
        assert len(df.select(chunks(F.col("t")).alias("c")).first().c) == -(-(n - 384) // 336) + 1
        return time.perf_counter() - begun

    seconds(10_000)
    assert seconds(160_000) < 8 * max(0.5, seconds(20_000))
    odd = spark.createDataFrame([(None,), ("",), ("  \n",), ("a",)], "t string").select(chunks(F.col("t")).alias("c")).collect()
    assert [r.c for r in odd] == [[], [], [], ["a"]]


def test_information_schema(spark):
    from lucidframe.model.base import Mock
    from lucidframe.operators.context import Semantic
    from lucidframe.sql.engine import Engine

    spark.createDataFrame([(1, "x")], "id long, body string").createOrReplaceTempView("listed")
    e = Engine(Semantic(spark, Mock()))
    assert [tuple(r) for r in e.sql("SELECT table_type FROM information_schema.tables WHERE table_name = 'listed'").collect()] == [("VIEW",)]
    assert [tuple(r) for r in e.sql("SELECT column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'listed' ORDER BY 2").collect()] == [("id", 1, "bigint"), ("body", 2, "string")]
