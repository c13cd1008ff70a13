"""Every registered query against its SQL at the smallest scale, and the shape of the plans."""

import pytest
from oracle import compare, database

import __spark_entry__ as driver
from citadex.plans import queries as registered
from citadex.plans.oracles import assembled

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.QUERIES, assembled()
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, name):
    n, m, problems = compare(spark, con, name, FOLDER, QUERIES, ORACLES)
    assert not problems and n > 0
    assert (m is None) == (name in ROWS_ONLY)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["query_id", "query", "answer", "reasoning", "confidence"] and df.count() == 40


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "hybrid_fuse", "answer_extract", "attach_artefacts", "route", "health", "intent_dist"])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bm25_cuts_to_k_before_the_last_shuffle(spark):
    text = plan(spark, "bm25_topk")
    assert "WindowGroupLimit" in text and text.index("row_number(), 10, Final") < text.index("Exchange hashpartitioning(query_id")
    after = text[text.index("Exchange hashpartitioning(query_id"):]
    assert after.index("row_number(), 10, Partial") < after.index("HashAggregate(keys=[query_id")
    # pairs are summed where they arise: nothing is shuffled between the join and the sum
    pairs = after[after.index("HashAggregate(keys=[query_id"):after.index("BroadcastHashJoin [term")]
    assert "Exchange hashpartitioning(query_id" not in pairs


def test_dense_search_does_not_shuffle_vectors(spark):
    text = plan(spark, "dense_topk")
    assert text.count("Exchange") == 1 and "Partial" in text[text.index("Exchange"):]


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "avg_metrics")
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double,props:string>" in text
    assert "PushedFilters: [IsNotNull(ts)" in text


def test_history_is_cut_before_the_shuffle(spark):
    text = plan(spark, "user_history")
    assert text.index("Exchange") < text.index("Partial")
