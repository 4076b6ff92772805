"""Relational queries: the inherited operators, each with SQL that Spark and the oracle share unless dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def shared(sql: str):
    """A query whose SQL both engines run."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    used = [t for t in TABLES if t in words]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *used)
        return spark.sql(sql)

    return run


SQL: dict[str, str] = {
    "scan_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "values_inline": "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)",
    "free_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05",
    "like_in_between": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' AND c_nationkey IN (1, 2, 3, 5, 8) AND c_acctbal BETWEEN 0 AND 5000",
    "is_not_true_guard": "SELECT c_custkey FROM customer WHERE (CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal > 100 END) IS NOT TRUE",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS state FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "subquery_scalar": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "subquery_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "subquery_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big WHERE n * 2 >= (SELECT m FROM top)",
    "derived_table": "SELECT d.status, d.n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) d WHERE d.n > 1",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_nationkey = s.s_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_range": "SELECT e.event_id, b.lo FROM events e JOIN (VALUES (0, 10), (10, 50), (50, 1000)) AS b(lo, hi) ON e.value >= b.lo AND e.value < b.hi",
    "join_using": "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi": "SELECT r_name, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS qty, CAST(round(avg(l_extendedprice), 4) AS DOUBLE) AS price, CAST(min(l_discount) AS DOUBLE) AS lo, CAST(max(l_discount) AS DOUBLE) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "group_by_expr": "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_custkey % 10",
    "rollup": "SELECT event_type, user_id % 4 AS u, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 4)",
    "cube": "SELECT o_orderstatus, o_custkey % 3 AS c, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_custkey % 3)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "bool_or": "SELECT user_id, bool_or(value > 95) AS any_big, bool_and(value > 1) AS all_pos FROM events GROUP BY user_id",
    "stddev": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp FROM events GROUP BY event_type",
    "corr": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem",
    "row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "rank_dense": "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS d FROM lineitem",
    "ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer",
    "lag_lead": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "running_sum_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM events",
    "moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM events",
    "range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM lineitem",
    "first_last": "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "percent_rank": "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS d FROM customer",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "nulls_last": "SELECT a FROM (VALUES (3), (NULL), (1), (2)) AS t(a) ORDER BY a DESC NULLS LAST LIMIT 3",
    "distinct": "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    "except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "str_funcs": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 1, 4) AS s, replace(c_name, 'Customer', 'C') AS r, trim(concat('  ', c_name, ' ')) AS t, reverse(c_name) AS v, repeat('ab', 2) AS p, lpad(CAST(c_nationkey AS STRING), 4, '0') AS z, c_name || '!' AS x, concat_ws('-', c_name, 'q') AS w, left(c_name, 3) AS f, CAST(instr(c_name, '0') AS BIGINT) AS i FROM customer",
    "regex": "SELECT doc_id, regexp_replace(source, '[0-9]+', '#') AS s, regexp_extract(source, '([0-9]+)', 1) AS n FROM documents",
    "math": "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(power(l_quantity, 2), 4) AS p, round(ln(l_quantity), 8) AS n, round(sqrt(l_quantity), 8) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(sign(l_discount - 0.05) AS DOUBLE) AS s, greatest(l_quantity, 10) AS g, least(l_quantity, 10) AS m FROM lineitem",
    "null_funcs": "SELECT coalesce(a, b, 0) AS c, nullif(a, 1) AS n, a IS DISTINCT FROM b AS d FROM (VALUES (1, 2), (NULL, 3), (4, NULL), (5, 5)) AS t(a, b)",
    "cast": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 1)) AS d, CAST(o_orderkey AS STRING) AS s, CAST('2024-02-29' AS DATE) AS day, TRY_CAST(o_orderstatus AS INT) AS bad FROM orders",
    "date_trunc_extract": "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(MONTH FROM ts) AS BIGINT) AS m, CAST(extract(HOUR FROM ts) AS BIGINT) AS hh FROM events",
    "interval_arith": "SELECT event_id, ts + INTERVAL '1' DAY AS later, CAST(ts AS DATE) + INTERVAL '1' MONTH AS next FROM events WHERE event_id < 0 OR event_id >= 0",
    "struct_build": "SELECT n_nationkey, t.a AS a, t.b AS b FROM (SELECT n_nationkey, {s} AS t FROM nation) q",
}
ORACLE_OF: dict[str, str] = {"struct_build": "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation"}
SQL["struct_build"] = SQL["struct_build"].replace("{s}", "named_struct('a', n_name, 'b', n_regionkey)")
SQL["interval_arith"] = "SELECT event_id, ts + INTERVAL '1' DAY AS later, CAST(CAST(ts AS DATE) + INTERVAL '1' MONTH AS DATE) AS next FROM events"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def percentile(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


def array_agg_sorted(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


def approx_distinct(spark, d):
    """Whether the estimate is within five of its standard errors of the count.

    Both are made of the different keys, which leaves them the same: beside a distinct count, Spark would keep a sketch of 13 kB for every key.
    """
    n, m = F.approx_count_distinct("o_custkey", 0.01), F.count("o_custkey")
    return _t(spark, d, "orders").select("o_custkey").distinct().agg((F.abs(n - m) <= 0.05 * m).alias("close"), m.alias("customers"))


def join_broadcast(spark, d):
    """Nation is a fixed 25 rows."""
    return _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def distinct_on(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


def array_funcs(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"), F.array_position(F.transform("embedding", lambda x: x > 0), True).alias("place"))


def explode(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.split("source", "c")).alias("part"))


def map_funcs(spark, d):
    m = F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey").cast("long"))
    return _t(spark, d, "nation").select("n_nationkey", F.element_at(m, "r").alias("r"), F.size(F.map_keys(m)).cast("long").alias("n"))


def json_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.length("props").cast("long").alias("n"), F.size(F.json_object_keys("props")).cast("long").alias("keys"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def qualify(spark, d):
    """By the engine, which rewrites QUALIFY."""
    from lucidframe.model.base import Mock
    from lucidframe.operators.context import Semantic
    from lucidframe.sql.engine import Engine

    _t(spark, d, "nation").createOrReplaceTempView("nation")
    return Engine(Semantic(spark, Mock())).sql("SELECT n_regionkey, n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 2")


def pivot(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def unpivot(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), F.length("c_name").cast("long").alias("size")).unpivot("c_custkey", ["nation", "size"], "what", "value")


PYTHON = {
    "percentile": (percentile, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type"),
    "array_agg_sorted": (array_agg_sorted, "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "approx_distinct": (approx_distinct, "SELECT true AS close, count(DISTINCT o_custkey) AS customers FROM orders"),
    "join_broadcast": (join_broadcast, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "distinct_on": (distinct_on, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "array_funcs": (array_funcs, "SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding)::DOUBLE, 6) AS top, coalesce(list_position(list_transform(embedding, lambda x: x > 0), true), 0)::BIGINT AS place FROM embeddings"),
    "explode": (explode, "SELECT doc_id, unnest(string_split(source, 'c')) AS part FROM documents"),
    "map_funcs": (map_funcs, "SELECT n_nationkey, n_regionkey::BIGINT AS r, 2::BIGINT AS n FROM nation"),
    "json_extract": (json_extract, "SELECT event_id, length(props)::BIGINT AS n, len(json_keys(props))::BIGINT AS keys, (props ->> '$.k')::BIGINT AS k FROM events"),
    "qualify": (qualify, "SELECT n_regionkey, n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 2"),
    "pivot": (pivot, "SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey"),
    "unpivot": (unpivot, "SELECT c_custkey, 'nation' AS what, c_nationkey::BIGINT AS value FROM customer UNION ALL SELECT c_custkey, 'size', length(c_name)::BIGINT FROM customer"),
}


def queries() -> dict:
    return {k: shared(s) for k, s in SQL.items()} | {k: f for k, (f, _) in PYTHON.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | ORACLE_OF | {k: s for k, (_, s) in PYTHON.items() if s}
