"""Plans that should hold at any size."""

import re

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, D)
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "free_filter")
    assert "GreaterThan(l_quantity,30" in text and "LessThan(l_discount,0.05" in text
    (schema,) = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert len(schema.split(",")) <= 4


def test_top_k_is_no_full_sort(spark):
    for name in ("topk", "vector_topk"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_aggregates_combine_before_the_exchange(spark):
    assert plan(spark, "agg_basic").count("HashAggregate") >= 2


def test_row_wise_operators_do_not_shuffle(spark):
    for name in ("chunk_windows", "case_searched", "op5_bpe", "op4_license_scan", "op6_html_density", "op7_media_tiles"):
        if name in entry.queries():
            assert "Exchange" not in plan(spark, name)


def test_the_estimate_keeps_no_sketch_for_each_key(spark):
    by_key = re.findall(r"Keys \[1\]: \[o_custkey.*\nFunctions.*", plan(spark, "approx_distinct"))
    assert by_key and all("approx_count_distinct" not in x for x in by_key)


def test_the_estimate_and_the_count_are_of_rows_with_repeats_and_nulls(spark, tmp_path):
    for name, keys in {"some": [1, 2, 2, None, 3, 3, 3], "none": []}.items():
        spark.createDataFrame([(k,) for k in keys], "o_custkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert entry.queries()["approx_distinct"](spark, f"{tmp_path}/{name}").collect() == [(True, len(set(keys) - {None}))]
