"""Sources, sinks, DDL and jobs: each query writes below the session's shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lucidframe import sources
from lucidframe.jobs.registry import JobEngine, Jobs
from lucidframe.operators.context import Semantic, shared_folder
from lucidframe.plans.semantic import engine, mock
from lucidframe.sql.engine import Engine


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scan_csv_roundtrip(spark, d):
    path = _folder(spark) + "/nation.csv"
    sources.write(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return sources.read(spark, path, "n_nationkey long, n_name string, n_regionkey long")


def scan_json_roundtrip(spark, d):
    path = _folder(spark) + "/region.json"
    sources.write(_t(spark, d, "region").select("r_regionkey", "r_name"), path)
    return sources.read(spark, path, "r_regionkey long, r_name string")


def scan_orc_roundtrip(spark, d):
    path = _folder(spark) + "/region.orc"
    sources.write(_t(spark, d, "region").select("r_regionkey", "r_name"), path)
    return sources.read(spark, path)


def glob_parts(spark, d):
    root = _folder(spark)
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for s in ("F", "O", "P"):
        orders.where(f"o_orderstatus = '{s}'").write.parquet(f"{root}/part-{s}.parquet")
    return Engine(Semantic(spark, mock())).sql(f"SELECT o_orderstatus, count(*) AS n FROM '{root}/part-*.parquet' GROUP BY o_orderstatus")


def path_literal(spark, d):
    return Engine(Semantic(spark, mock())).sql(f"SELECT n_regionkey, count(*) AS n FROM '{d}/nation.parquet' GROUP BY n_regionkey")


def ctas(spark, d):
    e, name = engine(spark, d), f"made_{uuid.uuid4().hex}"
    e.sql(f"CREATE TABLE {name} AS SELECT doc_id, lang FROM documents WHERE text MEANS 'has a mail address'")
    return e.sql(f"SELECT lang, count(*) AS n FROM {name} GROUP BY lang")


def insert_into(spark, d):
    e, name = engine(spark, d), f"made_{uuid.uuid4().hex}"
    e.sql(f"CREATE TABLE {name} AS SELECT doc_id FROM documents WHERE lang = 'de'")
    e.sql(f"INSERT INTO {name} SELECT doc_id FROM documents WHERE lang = 'fr'")
    return spark.table(name)


def copy_to_parquet(spark, d):
    e, path = engine(spark, d), _folder(spark) + "/out.parquet"
    e.sql(f"COPY (SELECT doc_id FROM documents WHERE text MEANS 'has a token') TO '{path}' STORED AS PARQUET")
    return e.sql(f"SELECT doc_id FROM '{path}'")


def external_table_csv(spark, d):
    e, path = engine(spark, d), _folder(spark) + "/c.csv"
    _t(spark, d, "customer").select("c_custkey", "c_name").write.option("sep", ";").csv(path)
    e.sql(f"CREATE EXTERNAL TABLE ext_customer (k BIGINT, name TEXT) STORED AS CSV LOCATION '{path}' OPTIONS ('format.has_header' 'false', 'format.delimiter' ';')")
    return e.sql("SELECT k, name FROM ext_customer")


def _jobs(spark, d) -> JobEngine:
    e = engine(spark, d)

    def make() -> Engine:
        return Engine(Semantic(spark, e.ctx.model, e.ctx.root, types=e.ctx.types, indexes=e.ctx.indexes))

    return JobEngine(e, Jobs(spark, make, _folder(spark)))


def job_result(spark, d):
    jobs = _jobs(spark, d)
    (job,) = jobs.sql("SUBMIT SELECT doc_id, lang FROM documents WHERE text MEANS 'has a mail address'").first()
    done = jobs.jobs.wait(job)
    if done.status != "succeeded":
        raise RuntimeError(f"{done.status}: {done.error}")
    return jobs.sql(f"SELECT doc_id, lang FROM job_result('{job}')")


def jobs_table(spark, d):
    jobs = _jobs(spark, d)
    (job,) = jobs.sql("SUBMIT SELECT count(*) AS n FROM documents").first()
    jobs.jobs.wait(job)
    return jobs.sql("SELECT status, rows, command_tag FROM jobs")


ALL = {
    "scan_csv_roundtrip": (scan_csv_roundtrip, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "scan_json_roundtrip": (scan_json_roundtrip, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "scan_orc_roundtrip": (scan_orc_roundtrip, "SELECT r_regionkey, r_name FROM region"),
    "glob_parts": (glob_parts, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "path_literal": (path_literal, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "ctas": (ctas, "SELECT lang, count(*) AS n FROM documents WHERE contains(text, '@') GROUP BY lang"),
    "insert_into": (insert_into, "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')"),
    "copy_to_parquet": (copy_to_parquet, "SELECT doc_id FROM documents WHERE contains(text, 'token')"),
    "external_table_csv": (external_table_csv, "SELECT c_custkey::BIGINT AS k, c_name AS name FROM customer"),
    "job_result": (job_result, "SELECT doc_id, lang FROM documents WHERE contains(text, '@')"),
    "jobs_table": (jobs_table, "SELECT 'succeeded' AS status, 1::BIGINT AS rows, 'SELECT 1' AS command_tag"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ALL.items() if s}
