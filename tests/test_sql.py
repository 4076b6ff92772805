import json

import pytest
from pyspark.sql import functions as F

from lucidframe import sources
from lucidframe.errors import SemanticError
from lucidframe.model.base import Failure, Mock
from lucidframe.operators.context import Semantic
from lucidframe.operators.index import create_index, open_index, refresh_index
from lucidframe.sql.engine import Engine
from lucidframe.streaming import classify_stream, filter_stream

ROWS = [(1, "open", "so furious about the price"), (2, "open", "the price is fine"), (3, "closed", "dull text"), (4, "closed", None), (5, "open", "dull text")]


@pytest.fixture
def e(spark):
    spark.createDataFrame(ROWS, "id long, status string, body string").createOrReplaceTempView("tickets")
    return Engine(Semantic(spark, Mock(needles={"angry": ["furious"], "pricing": ["price"]}, themes=["price", "ship"])))


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


def calls(e):
    n = e.ctx.counters["model_calls"] + e.ctx.counters["extract_model_calls"]
    e.ctx.counters.clear()
    return n


def test_filter_asks_distinct_survivors_once(e):
    assert rows(e, "SELECT id FROM tickets WHERE status = 'open' AND body MEANS 'angry'") == [(1,)]
    assert calls(e) == 3
    assert sorted(rows(e, "SELECT id FROM tickets WHERE NOT status = 'x' AND body MEANS 'pricing' AND body MEANS 'angry'")) == [(1,)]
    assert calls(e) == 3  # pricing: 3 texts; angry: known
    assert rows(e, "SELECT count(*) FROM tickets WHERE body MEANS 'angry'") == [(1,)] and calls(e) == 0


def test_between_and_negation_are_free_conjuncts(e):
    assert rows(e, "SELECT id FROM tickets WHERE id BETWEEN 1 AND 2 AND body MEANS 'pricing' AND status IN ('open') ORDER BY id") == [(1,), (2,)]
    assert calls(e) == 2


def test_labels_share_a_call_and_guards_spare_them(e):
    sql = "SELECT id, CASE WHEN status = 'closed' THEN 'c' WHEN body MEANS 'angry' THEN 'a' WHEN body MEANS 'pricing' THEN 'p' ELSE 'o' END AS l FROM tickets ORDER BY id"
    assert rows(e, sql) == [(1, "a"), (2, "p"), (3, "c"), (4, "c"), (5, "o")]
    assert e.ctx.counters["rows_gated"] == 1 and calls(e) == 3
    assert rows(e, sql)[0] == (1, "a") and calls(e) == 0
    df = e.sql("SELECT id, body MEANS 'angry' FROM tickets ORDER BY id")
    assert df.columns == ["id", "means(body, 'angry')"] and [r[1] for r in df.collect()] == [True, False, False, False, False]


def test_failures_are_the_rows_own(spark, e):
    e.ctx.model = Mock(responder=lambda r: Failure("x"))
    assert rows(e, "SELECT body MEANS 'm' AS a, body MEANS 'n' AS b FROM tickets WHERE id = 1") == [(None, None)]
    assert e.ctx.counters["rows_failed"] == 1

    class Silent(Mock):
        def answer(self, r):
            return "perhaps"

    e.ctx.model = Silent()
    assert rows(e, "SELECT id FROM tickets WHERE body MEANS 'm'") == [] and e.ctx.counters["rows_dropped"] == 3
    e.ctx.model = Mock(needles={"m": ["price"]})
    assert len(rows(e, "SELECT id FROM tickets WHERE body MEANS 'm'")) == 2  # unusable answers were not kept


@pytest.mark.parametrize(
    "sql,text",
    [
        ("SELECT id FROM tickets WHERE body MEANS 'a' OR id = 1", "legal"), ("SELECT id FROM tickets WHERE NOT body MEANS 'a'", "legal"), ("SELECT status FROM tickets GROUP BY body MEANS 'a', status", "legal"), ("SELECT a.id FROM tickets a JOIN tickets b ON a.body MEANS 'x'", "legal"),
        ("SELECT status FROM tickets GROUP BY status HAVING bool_or(body MEANS 'a')", "legal"), ("SELECT id FROM tickets WHERE body MEANS status", "string literal"), ("SELECT means(body, 'a', 0.5) FROM tickets", "calibrate"), ("SELECT id FROM tickets WITH RECALL 0.9", "requires a MEANS"),
        ("SELECT id FROM tickets WITH SIMILARITY 0.9", "requires SEMANTIC DISTINCT"), ("SELECT id FROM tickets ORDER BY body RELEVANCE TO 'x'", "requires a LIMIT"), ("SELECT id FROM tickets WHERE relevance(body, 'x') > 1 LIMIT 2", "legal"), ("SELECT id FROM tickets ORDER BY body RELEVANCE TO 'x' LIMIT 2", "CREATE SEMANTIC INDEX ON tickets\\(body\\)"),
        ("SELECT id FROM tickets ORDER BY upper(body) RELEVANCE TO 'x' LIMIT 2", "plain indexed column"), ("SELECT count(*) FROM tickets GROUP BY MEANING OF body", "needs a semantic index"), ("SELECT count(*) FROM tickets WHERE meaning_of(body) = 'x'", "legal"), ("SELECT SEMANTIC DISTINCT ON (body) id FROM tickets", "needs a semantic index"),
        ("SELECT meaning_of(body, 0) FROM tickets", "positive number"), ("SELECT id FROM tickets WHERE sem_extract_field(body, 'T', 'f') = 'x'", "SELECT list only"), ("SELECT sem_extract_field(body, 'T', 'f') FROM tickets", "define it first"), ("SELECT id FROM tickets WHERE means(body, 'a', 2)", "in \\(0, 1\\]"),
        ("SELECT max(body) RELEVANCE TO 'x' FROM tickets a JOIN tickets b ON a.id = b.id LIMIT 1", "plain indexed"), ("SELECT 'a", "not closed"),
    ],
)
def test_errors(e, sql, text):
    with pytest.raises(SemanticError, match=text):
        e.sql(sql)


def test_index_prefilter_and_refresh(spark, e):
    long = " ".join(["filler"] * 4000) + " price"
    spark.createDataFrame([(1, "price a"), (2, "ship b"), (3, None), (4, long)], "id long, body string").createOrReplaceTempView("notes")
    e.sql("CREATE SEMANTIC INDEX ON notes(body)")
    assert rows(e, "SELECT id FROM notes WHERE body MEANS 'price' ORDER BY id") == [(1,), (4,)]
    assert (e.ctx.counters["index_hits"], e.ctx.counters["rows_pruned"], e.ctx.counters["embed_calls"]) == (2, 1, 1) and calls(e) == 2
    grown = spark.createDataFrame([(1, "price a"), (2, "ship b"), (3, None), (4, long), (5, "price late"), (6, "other")], "id long, body string")
    grown.createOrReplaceTempView("notes")
    assert rows(e, "SELECT id FROM notes WHERE body MEANS 'price' ORDER BY id") == [(1,), (4,), (5,)]
    assert e.ctx.counters["passthrough_rows"] == 2 and calls(e) == 2
    assert {r[0] for r in rows(e, "SELECT id FROM notes ORDER BY body RELEVANCE TO 'price' LIMIT 9")} == {1, 2, 4}
    assert rows(e, "SELECT id, meaning_of(body, 2) IS NULL AS unknown FROM notes ORDER BY id") == [(1, False), (2, False), (3, True), (4, False), (5, True), (6, True)]
    assert refresh_index(e.ctx, grown, "notes", "body") == 2
    assert rows(e, "SELECT count(*) FROM (SELECT meaning_of(body, 2) AS m FROM notes) q WHERE m IS NULL") == [(1,)]
    again = open_index(e.ctx, "notes", "body")
    assert again.dim == 16 and again.embed_id == "mock-embed"
    e.ctx.model = Mock(embed_id="other")
    with pytest.raises(SemanticError, match="mock-embed.*other"):
        open_index(e.ctx, "notes", "body")
    with pytest.raises(SemanticError, match="metadata"):
        open_index(e.ctx, "nowhere", "body")
    with pytest.raises(SemanticError, match="no semantic index"):
        refresh_index(e.ctx, grown, "tickets", "body")


def test_rank_bounds_calls_and_drops_unindexed(spark, e):
    create_index(e.ctx, spark.table("tickets").where("id < 3"), "tickets", "body")
    got = rows(e, "SELECT id, body RELEVANCE TO 'furious price' AS s FROM tickets ORDER BY body RELEVANCE TO 'furious price' LIMIT 5")
    assert got == [(1, 1.0), (2, 0.5)] and e.ctx.counters["unindexed_rows"] == 1 and calls(e) == 2
    assert rows(e, "SELECT t.id FROM tickets t ORDER BY relevance(t.body, 'furious price') ASC LIMIT 1") == [(2,)] and calls(e) == 0


def test_group_by_meaning(e):
    e.sql("CREATE SEMANTIC INDEX ON tickets(body)")
    assert rows(e, "SELECT topic, count(*) AS n FROM tickets GROUP BY MEANING OF body INTO 2 AS topic HAVING count(*) > 1 ORDER BY topic") == [("dull", 2), ("price", 2)]
    assert calls(e) == 2
    assert rows(e, "SELECT count(DISTINCT meaning_of(body, 2)) AS n FROM tickets") == [(2,)] and calls(e) == 0


def test_semantic_distinct(spark, e):
    e.sql("CREATE SEMANTIC INDEX ON tickets(body)")
    assert rows(e, "SELECT SEMANTIC DISTINCT ON (body) id FROM tickets ORDER BY id DESC") == [(5,), (4,), (2,)]
    assert calls(e) == 0
    assert rows(e, "SELECT count(DISTINCT semantic_key(body)) AS k FROM tickets") == [(2,)]


def test_extraction(e):
    e.sql("CREATE SEMANTIC TYPE fact AS (name TEXT 'n', nums INT[] 'i', TOGETHER(stage ONEOF(Early, Late) 's', quote TEXT 'q'))")
    answer = {"name": "x", "nums": [1, "b", 2], "stage": "late", "quote": None}
    e.ctx.model = Mock(responder=lambda r: json.dumps({k: answer[k] for k in r.schema["properties"]}))
    assert rows(e, "SELECT id, CAST(body AS fact).stage AS s FROM tickets ORDER BY id") == [(1, "Late"), (2, "Late"), (3, "Late"), (4, None), (5, "Late")]
    assert calls(e) == 3
    r = e.sql("SELECT CAST(body AS FACT) AS f FROM tickets WHERE id = 1").first().f
    assert (r.name, r.nums, r.stage, r.quote) == ("x", [1, 2], "Late", None) and calls(e) == 1
    assert rows(e, "SELECT CAST(body AS fact).quote FROM tickets WHERE id = 1") == [(None,)] and calls(e) == 0
    with pytest.raises(SemanticError, match="has no field zip"):
        e.sql("SELECT CAST(body AS fact).zip FROM tickets")
    with pytest.raises(SemanticError, match="already defined"):
        e.sql("CREATE SEMANTIC TYPE FACT AS (a INT 'x')")


def test_plain_sql_dialect(spark, e, tmp_path):
    assert rows(e, "SELECT DISTINCT ON (status) status, id FROM tickets ORDER BY status, id DESC") == [("closed", 4), ("open", 5)]
    assert rows(e, "SELECT id FROM tickets QUALIFY row_number() OVER (PARTITION BY status ORDER BY id) = 1 ORDER BY id") == [(1,), (3,)]
    assert rows(e, "SELECT 'it''s' AS \"a b\", CAST(1 AS TEXT) AS t") == [("it's", "1")]
    assert rows(e, f"COPY (SELECT id, status FROM tickets WHERE id < 3) TO '{tmp_path}/o.parquet'") == [(2,)]
    assert rows(e, f"SELECT sum(id) FROM '{tmp_path}/o.parquet'") == [(3,)]
    (tmp_path / "in.csv").write_text("1;yes\n2;no\n")
    e.sql(f"CREATE EXTERNAL TABLE ext (k BIGINT, v TEXT) STORED AS CSV LOCATION '{tmp_path}/in.csv' OPTIONS ('format.has_header' 'false', 'format.delimiter' ';')")
    assert rows(e, "SELECT v FROM ext WHERE v MEANS 'ye'") == [("yes",)]
    assert rows(e, f"SELECT count(*) FROM '{tmp_path}/in.csv'") == [(1,)]
    spark.sql("DROP TABLE IF EXISTS kept")
    e.sql("CREATE TABLE kept AS SELECT id FROM tickets WHERE body MEANS 'angry'")
    e.sql("INSERT INTO kept VALUES (77)")
    assert sorted(rows(e, "SELECT id FROM kept")) == [(1,), (77,)]
    sources.write(spark.table("kept"), f"{tmp_path}/k.csv")
    assert sources.read(spark, f"{tmp_path}/k.csv").count() == 2 and sources.format_of("a/b.jsonl") == "json"


def test_explain_calls_no_model(e):
    text = "\n".join(r[0] for r in rows(e, "EXPLAIN SELECT id FROM tickets WHERE body MEANS 'new' AND id > 1 WITH RECALL 0.9"))
    assert "SemanticFilter [new]" in text and "Physical Plan" in text and calls(e) == 0


def test_scopes(e):
    assert rows(e, "SELECT t.*, u.status AS s2 FROM tickets t JOIN tickets u ON t.id = u.id + 1 WHERE t.body MEANS 'pricing' ORDER BY t.id") == [(2, "open", "the price is fine", "open")]
    assert rows(e, "WITH a AS (SELECT id, body FROM tickets WHERE body MEANS 'pricing'), b AS (SELECT max(id) AS m FROM a) SELECT m FROM b") == [(2,)]
    assert rows(e, "SELECT (SELECT count(*) FROM tickets WHERE body MEANS 'pricing') AS n") == [(2,)]
    assert sorted(rows(e, "SELECT id FROM tickets WHERE body MEANS 'angry' UNION ALL SELECT id FROM tickets WHERE id = 3")) == [(1,), (3,)]


def test_stream(spark, e, tmp_path):
    spark.table("tickets").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, status string, body string").parquet(f"{tmp_path}/in")
    q = filter_stream(e.ctx, stream, F.col("body"), "angry", f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
    q = classify_stream(e.ctx, stream, F.col("body"), ["angry", "pricing"], ["a", "p"], f"{tmp_path}/labels", f"{tmp_path}/state2")
    q.awaitTermination(120)
    got = {r.id: (r.a, r.p) for r in spark.read.parquet(f"{tmp_path}/labels").collect()}
    assert got == {r[0]: (bool(r[2]) and "furious" in r[2], bool(r[2]) and "price" in r[2]) for r in ROWS}


def test_index_prefilter_has_no_cap_and_calibration_grows(spark, e):
    # 300 texts of the condition's own vector, 100 farther ones (two themes) that hold it too, 200 without it
    texts = [f"price {i}" for i in range(300)] + [f"price ship {i}" for i in range(100)] + [f"dull {i}" for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "id long, body string").createOrReplaceTempView("many")
    e.sql("CREATE SEMANTIC INDEX ON many(body)")
    assert {r[0] for r in rows(e, "SELECT id FROM many WHERE body MEANS 'price'")} == set(range(400))
    assert calls(e) == 400
    # a rare condition, with the same vector as most texts
    e.ctx.model = Mock(needles={"far": ["ship 7"]}, themes=["price", "ship"])
    want = {i for i, x in enumerate(texts) if "ship 7" in x}
    assert {r[0] for r in rows(e, "SELECT id FROM many WHERE body MEANS 'far' WITH RECALL 1.0")} == want
    assert e.ctx.counters["estimated_recall"] == 1.0


def test_rank_scores_all_rows_that_pass_where(spark, e):
    # 60 texts of one vector, the best by the model's score are farther from the query than they
    texts = [f"price {i}" for i in range(60)] + ["price ship last"] * 2 + [f"dull {i}" for i in range(9)]
    spark.createDataFrame(list(enumerate(texts)), "id long, body string").createOrReplaceTempView("ranked")
    e.sql("CREATE SEMANTIC INDEX ON ranked(body)")
    assert rows(e, "SELECT id FROM ranked ORDER BY body RELEVANCE TO 'price' DESC, id LIMIT 3") == [(0,), (1,), (2,)]
    assert rows(e, "SELECT id FROM ranked ORDER BY body RELEVANCE TO 'price last' DESC, id LIMIT 2") == [(60,), (61,)]
    calls(e)
    assert rows(e, "SELECT id FROM ranked WHERE body LIKE 'dull%' ORDER BY body RELEVANCE TO 'price' DESC, id LIMIT 4") == [(62,), (63,), (64,), (65,)]
    assert calls(e) == 0


def test_stages_send_workers_small_batches(spark, e):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    texts = spark.range(3000).selectExpr("repeat('x', 5000) AS t").coalesce(1)  # 15 MB, fewer rows than Spark puts into a batch
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    got = [r.n for r in e.ctx.stored(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert max(got) < 2 << 20 and sum(got) > 3000 * 5000 and spark.conf.get(name) == before
