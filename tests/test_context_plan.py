"""Contexts of questions come from products of blocks: no pair of a question and a vector is a row."""

from lossgrid.plans import text_queries


def test_contexts_make_no_pair(spark):
    plan = text_queries.rag_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "FlatMapGroupsInArrow" in plan
