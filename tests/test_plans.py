"""What reaches the scans, and where rows are shuffled."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filtered_scan")
    assert "EqualTo(service,checkout" in text and "PushedFilters" in text
    assert "ReadSchema: struct<row_id:bigint,id:string,service:string,environment:string>" in text
    assert "GreaterThanOrEqual(ts" in plan(spark, "time_window_filter")


@pytest.mark.parametrize("name", ["p1_found", "chunk_documents", "excerpts", "tag_lookup", "dynamic_topk", "payload_json", "recency_decay"])
def test_row_wise_queries_neither_shuffle_nor_call_python(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "InArrow" not in text and "Python" not in text


def test_top_rows_come_from_heaps(spark):
    assert "TakeOrderedAndProject" in plan(spark, "error_log_topn")
    assert "TakeOrderedAndProject" in plan(spark, "knn_cosine")
    assert "WindowGroupLimit" in plan(spark, "parent_best_chunk")


def test_ranking_has_no_python(spark):
    text = plan(spark, "mmr_rerank")
    assert "Python" not in text and "InArrow" not in text and "CartesianProduct" not in text


def test_batched_search_has_a_grid_of_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "knn_batch")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    keys = [line for line in text.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert keys and all("qp#" in line and "sp#" in line for line in keys)
