"""Nearest vectors by products of blocks against a plain scan, over several Arrow batches, with copies and odd vectors."""

import math

import numpy as np
import pytest

from lossgrid.operators import nearest, retrieval

INDEX = "namespace string, chunk_id string, embedding array<double>"
SHOWN = ("question_id", "place", "namespace", "chunk_id", "score")


def scan(spark, questions, index, k):
    return retrieval.placed(index.crossJoin(questions), k)


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select(*SHOWN).collect())  # as text, so that nan equals itself


@pytest.fixture()
def odd(spark):
    rng = np.random.default_rng(5)
    draw = lambda: [float(x) for x in rng.integers(-2, 3, 4)]
    rows = [("ab"[i % 2], f"c{i:03d}", draw()) for i in range(120)] + [("a", f"copy{i}", [1.0, 2.0, 0.0, 1.0]) for i in range(30)]
    rows += [("a", "null", None), ("b", "nan", [math.nan, 1.0, 0.0, 0.0]), ("b", "huge", [1e200, 1.0, 0.0, 0.0]), ("b", "short", [1.0, 1.0]), (None, "none", [1.0, 0.0, 0.0, 1.0]), ("c", "only", [1.0, 0.0, 0.0, 0.0])]
    asked = [(i, draw()) for i in range(25)] + [(90, [0.0] * 4), (91, None), (92, [1.0, 2.0, 0.0, 1.0]), (93, [1.0, 1.0]), (94, [math.nan, 0.0, 0.0, 1.0])]
    return spark.createDataFrame(asked, "question_id int, vector array<double>"), spark.createDataFrame(rows, INDEX)


def test_blocks_find_what_a_scan_finds(spark, odd, monkeypatch):
    questions, index = odd
    want = shown(scan(spark, questions, index, 3))
    assert shown(retrieval.retrieve(questions, index, 3)) == want
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 4)
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    assert shown(retrieval.retrieve(questions, index, 3)) == want


def test_no_pair_is_a_row(spark, odd):
    plan = retrieval.retrieve(*odd)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "FlatMapGroupsInArrow" in plan


def test_cells_over_several_batches(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 8)).tolist() + [[1.0] * 8] * 20 + [[math.nan] + [1.0] * 7]
    index = spark.createDataFrame([(f"n{i % 2}", f"c{i:05d}", v) for i, v in enumerate(vectors)], INDEX)
    questions = spark.createDataFrame([(i, vectors[7 * i]) for i in range(60)], "question_id int, vector array<double>")
    want = shown(scan(spark, questions, index, 3))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert shown(nearest.retrieve(questions, nearest.build(index, 8, 4), 3)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
