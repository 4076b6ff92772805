"""Semantic queries on the driver's tables, with a mock model that SQL can repeat."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.functions.columns import chunks, cosine, fnv1a64, hex16
from lucidframe.model.base import Mock, Request
from lucidframe.operators.context import Semantic
from lucidframe.operators.index import Index, create_index, mean_vectors, search
from lucidframe.operators.semantic import sem_filter
from lucidframe.sql.engine import Engine

THEMES = ["license", "token", "password", "@"]


def respond(r: Request):
    """What the mock extracts: facts that a regular expression finds."""
    first = lambda p: (m := re.search(p, r.text)) and m[1]
    found = {
        "mail": first(r"([a-z.0-9]+@[a-z0-9.]+com)"),
        "octets": [int(x) for x in re.findall(r"[0-9]+", first(r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)") or "")],
        "size": len(r.text),
        "share": min(1.5, len(r.text) / 1000),
        "kind": "LONG" if len(r.text) > 2000 else "short",
        "secret": "token" in r.text,
    }
    keys = r.schema["properties"]
    if set(keys) <= set(found):
        return {k: found[k] for k in keys}
    return None


def mock(**more) -> Mock:
    def answer(r: Request):
        out = respond(r)
        return Mock(needles=model.needles, themes=model.themes).answer(r) if out is None else out

    model = Mock(needles={"mentions a licence": ["license", "License"], "has a token": ["token"], "has a mail address": ["@"]}, themes=THEMES, responder=answer)
    for k, v in more.items():
        setattr(model, k, v)
    return model


def engine(spark: SparkSession, sf_dir: str, index: bool = False, words: int = 384) -> Engine:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.createOrReplaceTempView("documents")
    for t in ("labels", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    ctx = Semantic(spark, mock())
    if index:
        create_index(ctx, docs, "documents", "text", words, words // 8)
    return Engine(ctx)


def by_sql(sql: str, index: bool = False, setup: str | None = None, words: int = 384):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, index, words)
        if setup:
            e.sql(setup)
        return e.sql(sql)

    return run


LICENCE = "(contains(text, 'license') OR contains(text, 'License'))"
FACTS = """CREATE SEMANTIC TYPE facts AS (mail TEXT 'the first mail address', octets INT[] 'parts of the first network address',
 share REAL CHECK (0..1) 'length in thousands', TOGETHER(kind ONEOF(short, long) 'how long it is', size INT 'characters'))"""
THEME = "CASE WHEN contains(text, 'license') THEN 'l' ELSE '' END || CASE WHEN contains(text, 'token') THEN 't' ELSE '' END || CASE WHEN contains(text, 'password') THEN 'p' ELSE '' END || CASE WHEN contains(text, '@') THEN 'a' ELSE '' END"
MAIL = "nullif(regexp_extract(text, '([a-z.0-9]+@[a-z0-9.]+com)', 1), '')"
IP = "regexp_extract(text, '([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)', 1)"


def chunk_windows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk", "words")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "words")


def doc_hash(spark, d):
    return spark.createDataFrame([("",), ("a",), ("hello world",), (None,)], "t string").select("t", hex16(fnv1a64(F.col("t"))).alias("h"))


def vector_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = e.crossJoin(F.broadcast(query))  # one row
    return near.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def doc_vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = mean_vectors(e.select(F.col("label").cast("long").alias("h"), "embedding"), "h", "embedding")
    return v.select(F.col("h").alias("label"), F.posexplode("v").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("p"), F.round(F.col("x").cast("double"), 5).alias("x"))


def prefilter_keep(spark, d):
    """Texts with a chunk near the query's theme, by exact search over all chunks of the index."""
    e = engine(spark, d, index=True)
    hits = search(e.ctx, e.ctx.indexes["documents", "text"], "token", fetch=None, floor=0.35)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.join(hits.select("h").distinct(), F.xxhash64("text") == F.col("h"), "left_semi").select("doc_id")


def unindexed_passthrough(spark, d):
    """The index holds German documents only; the others are asked on their full text."""
    e = engine(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    index = create_index(e.ctx, docs.where("lang = 'de'"), "documents", "text", 200_000, 0)
    return sem_filter(e.ctx, docs.where("lang <> 'de'"), F.col("text"), "has a token", index).select("doc_id")


def index_refresh(spark, d):
    from lucidframe.operators.index import refresh_index

    e = engine(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    index: Index = create_index(e.ctx, docs.where("lang = 'de'"), "documents", "text")
    refresh_index(e.ctx, docs, "documents", "text")
    return index.members(e.ctx).agg(F.count(F.lit(1)).alias("docs"))


GROUPED = "SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY {}"


def meaning_auto_k(spark, d):
    """The number of groups by silhouette: the texts lie on one point a theme."""
    return engine(spark, d, True, 200_000).sql(GROUPED.format("MEANING OF text AS topic"))


def means_multi_chunk(spark, d):
    """Long texts of several chunks: the index finds those with a chunk near the condition, the model reads their nearest three."""
    return engine(spark, d, True, 32).sql("SELECT doc_id FROM documents WHERE n_chars > 2000 AND text MEANS 'token'")


def recall_threshold(spark, d):
    """Threshold and estimated recall by target, for the positives' scores of a labelled sample: some lost, some not indexed."""
    from lucidframe.operators.semantic import threshold_for

    rows = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select(F.col("doc_id") % 50).collect()  # a labelled sample is read by the driver
    lost, unindexed = (sum(r[0] == k for r in rows) for k in (7, 11))
    scored = [0.35 + r[0] / 100 for r in rows if r[0] not in (7, 11)]
    found = [(t, *threshold_for(t, scored, unindexed, lost)) for t in (0.5, 0.8, 0.9, 0.97, 1.0)]
    return spark.createDataFrame([(t, round(x, 6), round(r, 6)) for t, x, r in found], "target double, threshold double, recall double")


def semantic_key_groups(spark, d):
    e = engine(spark, d, True, 200_000)
    keys = e.sql("SELECT doc_id, semantic_key(text) AS k FROM documents")
    return keys.groupBy("k").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n")


def recall_calibrated(spark, d):
    return engine(spark, d, True).sql("SELECT doc_id FROM documents WHERE text MEANS 'token' WITH RECALL 1.0")


def means_cached_repeat(spark, d):
    """Model calls of two equal statements: the second asks nothing."""
    e = engine(spark, d)
    e.sql("SELECT doc_id FROM documents WHERE text MEANS 'has a token'").count()
    first = e.ctx.counters["model_calls"]
    e.sql("SELECT doc_id FROM documents WHERE text MEANS 'has a token'").count()
    return spark.createDataFrame([(first, e.ctx.counters["model_calls"] - first)], "first long, again long")


def classify_one_call(spark, d):
    """Model calls of three conditions: one a distinct text."""
    e = engine(spark, d)
    e.sql("SELECT doc_id, text MEANS 'has a token' AS a, text MEANS 'has a mail address' AS b, text MEANS 'mentions a licence' AS c FROM documents").count()
    return spark.createDataFrame([(e.ctx.counters["model_calls"],)], "calls long")


ALL: dict[str, tuple] = {
    "means_filter": (by_sql("SELECT doc_id FROM documents WHERE text MEANS 'mentions a licence'"), f"SELECT doc_id FROM documents WHERE {LICENCE}"),
    "means_with_free_pred": (by_sql("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND text MEANS 'has a mail address' AND n_chars > 500"), "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND contains(text, '@') AND n_chars > 500"),
    "means_two_conjuncts": (by_sql("SELECT doc_id FROM documents WHERE text MEANS 'has a token' AND text MEANS 'has a mail address'"), "SELECT doc_id FROM documents WHERE contains(text, 'token') AND contains(text, '@')"),
    "means_after_join": (by_sql("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text MEANS 'has a mail address' AND l.quality = 1"), "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE contains(d.text, '@') AND l.quality = 1"),
    "means_bool_column": (by_sql("SELECT doc_id, text MEANS 'has a token' AS tok, text MEANS 'has a mail address' AS mail FROM documents"), "SELECT doc_id, contains(text, 'token') AS tok, contains(text, '@') AS mail FROM documents"),
    "means_case_guard": (
        by_sql("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'french' WHEN text MEANS 'mentions a licence' THEN 'licence' WHEN text MEANS 'has a token' THEN 'token' ELSE 'other' END AS label FROM documents"),
        f"SELECT doc_id, CASE WHEN lang = 'fr' THEN 'french' WHEN {LICENCE} THEN 'licence' WHEN contains(text, 'token') THEN 'token' ELSE 'other' END AS label FROM documents",
    ),
    "means_null_text": (by_sql("SELECT id, t MEANS 'x' AS x FROM (VALUES (1, 'ax'), (2, NULL), (3, 'b'), (4, '  ')) AS v(id, t)"), "SELECT id, coalesce(contains(t, 'x'), false) AS x FROM (VALUES (1, 'ax'), (2, NULL), (3, 'b'), (4, '  ')) AS v(id, t)"),
    "means_in_subquery": (by_sql("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE text MEANS 'has a mail address') s GROUP BY lang HAVING count(*) > 1"), "SELECT lang, count(*) AS n FROM documents WHERE contains(text, '@') GROUP BY lang HAVING count(*) > 1"),
    "means_in_cte": (by_sql("WITH m AS (SELECT doc_id, source FROM documents WHERE text MEANS 'has a token') SELECT source, count(*) AS n FROM m GROUP BY source"), "SELECT source, count(*) AS n FROM documents WHERE contains(text, 'token') GROUP BY source"),
    "means_union": (by_sql("SELECT doc_id FROM documents WHERE text MEANS 'has a token' UNION SELECT doc_id FROM documents WHERE text MEANS 'has a mail address'"), "SELECT doc_id FROM documents WHERE contains(text, 'token') OR contains(text, '@')"),
    "means_count_by_label": (by_sql("SELECT tok, count(*) AS n FROM (SELECT text MEANS 'has a token' AS tok FROM documents) s GROUP BY tok"), "SELECT contains(text, 'token') AS tok, count(*) AS n FROM documents GROUP BY 1"),
    "means_cached_repeat": (means_cached_repeat, "SELECT count(DISTINCT text) AS first, 0::BIGINT AS again FROM documents"),
    "classify_one_call": (classify_one_call, "SELECT count(DISTINCT text) AS calls FROM documents"),
    "chunk_windows": (
        chunk_windows,
        r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 384) / 336.0)::BIGINT, 0) + 1)) AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, chunk, array_to_string(w[chunk * 336 + 1 : chunk * 336 + 384], ' ') AS words FROM k",
    ),
    "doc_hash": (doc_hash, "SELECT t, h FROM (VALUES ('', 'cbf29ce484222325'), ('a', 'af63dc4c8601ec8c'), ('hello world', '779a65e7023cd2e7'), (NULL, NULL)) AS v(t, h)"),
    "vector_topk": (vector_topk, "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10"),
    "doc_vectors": (
        doc_vectors,
        "WITH e AS (SELECT label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT label, p, round((x / norm)::FLOAT::DOUBLE, 5) AS x FROM m JOIN n USING (label)",
    ),
    "prefilter_keep": (prefilter_keep, "SELECT doc_id FROM documents WHERE contains(text, 'token')"),
    "unindexed_passthrough": (unindexed_passthrough, "SELECT doc_id FROM documents WHERE lang <> 'de' AND contains(text, 'token') AND text NOT IN (SELECT text FROM documents WHERE lang = 'de')"),
    "index_refresh": (index_refresh, "SELECT count(DISTINCT text) AS docs FROM documents"),
    "recall_threshold": (
        recall_threshold,
        "WITH l AS (SELECT doc_id % 50 AS m FROM labels WHERE quality = 1), s AS (SELECT 0.35::DOUBLE + m / 100.0::DOUBLE AS x, row_number() OVER (ORDER BY m DESC) AS place FROM l WHERE m NOT IN (7, 11)), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE m = 11) AS unindexed FROM l), t AS (SELECT unnest([0.5, 0.8, 0.9, 0.97, 1.0])::DOUBLE AS target), n AS (SELECT target, total, unindexed, least(greatest(0, ceil(target * total - 1e-9)::BIGINT - unindexed), (SELECT count(*) FROM s)) AS needed FROM t, c), h AS (SELECT n.*, CASE WHEN needed = 0 THEN 0.35::DOUBLE ELSE x END AS threshold FROM n LEFT JOIN s ON place = needed) SELECT target, round(threshold, 6) AS threshold, round(((SELECT count(*) FROM s WHERE x >= threshold) + unindexed) / total::DOUBLE, 6) AS recall FROM h",
    ),
    "means_multi_chunk": (means_multi_chunk, "SELECT doc_id FROM documents WHERE n_chars > 2000 AND contains(text, 'token')"),
    "recall_calibrated": (recall_calibrated, "SELECT doc_id FROM documents WHERE contains(text, 'token')"),
    "relevance_topk": (
        by_sql("SELECT doc_id, text RELEVANCE TO 'token' AS score FROM documents WHERE text LIKE '%token%' ORDER BY text RELEVANCE TO 'token', doc_id LIMIT 5", True),
        "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'token') ORDER BY doc_id LIMIT 5",
    ),
    "relevance_score_column": (
        by_sql("SELECT doc_id, relevance(text, 'token') AS score FROM documents ORDER BY relevance(text, 'token') DESC, doc_id LIMIT 3", True, words=200_000),
        "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'token') ORDER BY doc_id LIMIT 3",
    ),
    "meaning_group_by": (by_sql(GROUPED.format("MEANING OF text INTO 16 AS topic"), True, words=200_000), GROUPED.format(THEME)),
    "meaning_auto_k": (meaning_auto_k, GROUPED.format(THEME)),
    "semantic_distinct": (by_sql("SELECT SEMANTIC DISTINCT ON (text) doc_id FROM documents ORDER BY doc_id WITH SIMILARITY 0.95", True, words=200_000), f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {THEME}"),
    "semantic_key_column": (semantic_key_groups, f"SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY {THEME}"),
    "unindexed_distinct": (by_sql("SELECT DISTINCT ON (text) doc_id FROM documents ORDER BY text, doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "extract_field": (by_sql("SELECT doc_id, CAST(text AS facts).mail AS mail FROM documents WHERE lang = 'en'", setup=FACTS), f"SELECT doc_id, {MAIL} AS mail FROM documents WHERE lang = 'en'"),
    "extract_struct": (by_sql("SELECT doc_id, f.size AS size, f.kind AS kind FROM (SELECT doc_id, CAST(text AS facts) AS f FROM documents) s", setup=FACTS), "SELECT doc_id, length(text)::BIGINT AS size, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS kind FROM documents"),
    "extract_list": (by_sql("SELECT doc_id, size(o) AS n, coalesce(element_at(o, 1), -1) AS first FROM (SELECT doc_id, CAST(text AS facts).octets AS o FROM documents) s WHERE size(o) > 0", setup=FACTS), f"SELECT doc_id, 4::INTEGER AS n, split_part({IP}, '.', 1)::BIGINT AS first FROM documents WHERE {IP} <> ''"),
    "extract_oneof": (by_sql("SELECT CAST(text AS facts).kind AS kind, doc_id FROM documents", setup=FACTS), "SELECT CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS kind, doc_id FROM documents"),
    "extract_real_check": (by_sql("SELECT doc_id, round(CAST(text AS facts).share, 6) AS share FROM documents", setup=FACTS), "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN round(length(text) / 1000.0::DOUBLE, 6) END AS share FROM documents"),
    "extract_inline": (by_sql("SELECT doc_id, EXTRACT(secret BOOL 'does it hold a token' FROM text) AS secret FROM documents"), "SELECT doc_id, contains(text, 'token') AS secret FROM documents"),
    "extract_group_by": (by_sql("SELECT kind, count(*) AS n FROM (SELECT CAST(text AS facts).kind AS kind FROM documents) s GROUP BY kind", setup=FACTS), "SELECT CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS kind, count(*) AS n FROM documents GROUP BY 1"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ALL.items() if s}
