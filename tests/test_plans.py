"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest

from tablework import queries as Q
from tablework.operators import search as S
from tablework.operators.skew import salted_join


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_pairwise_products(spark, folder, name):
    text = plan(Q.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_search_keeps_k_rows_per_task(spark, folder):
    text = plan(S.search(Q.vectors(spark, folder), Q.query_vector(spark, folder), "vec_id"))
    assert "TakeOrderedAndProject" in text
    assert text.count("ArrowEvalPython") <= 2  # once in the tree, once in the details


def test_search_by_group_limits_before_the_shuffle(spark, folder):
    vector = Q.query_vector(spark, folder)
    text = plan(S.search_by_group(Q.vectors(spark, folder), vector, "vec_id", "label"))
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(Q.order_states(spark, folder)[1].filter("state = 'R'"))
    assert "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in text


def test_frequent_keys_are_salted(spark):
    rows = spark.range(50_000).selectExpr("id", "if(id % 2 = 0, 7, id) AS key")
    side = spark.range(10).selectExpr("id AS k", "id AS v")
    assert "_salt" in plan(salted_join(rows, side, "key", "k", "left"))
    assert "_salt" not in plan(salted_join(rows, side, "id", "k", "left"))
