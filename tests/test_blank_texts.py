"""Texts without a word are indexed and grouped like others: queries against their SQL on such rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"
BLANK = ["", "  ", "", "\n \t"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("blank")
    for name in os.listdir(SOURCE):
        if name != "documents.parquet":
            os.symlink(f"{SOURCE}/{name}", folder / name)
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{SOURCE}/documents.parquet'")
    con.executemany("INSERT INTO documents (doc_id, text, lang, source, n_chars) VALUES (?, ?, ?, 'web', ?)", [(100_000 + i, t, "de" if i else "en", len(t)) for i, t in enumerate(BLANK)])
    con.sql(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["index_refresh", "semantic_key_column", "meaning_group_by", "semantic_distinct", "meaning_auto_k"])
def test_blank_texts(spark, tables, name):
    got = [tuple(r) for r in entry.queries()[name](spark, tables).collect()]
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    assert sorted(got) == sorted(sql.sql(entry.oracle_sql()[name]).fetchall())
