"""What moves and what comes out of blocks grows with questions and vectors, not with the number of shuffle partitions or with pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgrid.operators import blocks, retrieval


def test_questions_move_as_often_whatever_the_partitions(spark, monkeypatch):
    index = spark.range(40_000).select(F.lit("a").alias("namespace"), F.format_string("c%06d", "id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    questions = index.limit(50).select(F.monotonically_increasing_id().alias("question_id"), F.col("embedding").alias("vector"))
    sides, met = [], blocks.met
    monkeypatch.setattr(blocks, "met", lambda left, right, *a: sides.append((left.count(), right.count())) or met(left, right, *a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 400)
    try:
        retrieval.retrieve(questions, index, 3)
        monkeypatch.setattr(retrieval, "NUMBERS", 2 * 1000)  # long vectors make smaller blocks
        retrieval.retrieve(questions, index, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sides == [(50 * retrieval.TASKS, 40_000), (50 * 40, 40_000)]


def test_a_question_of_another_length_meets_few(spark):
    """Its cosine with all is 0, so all tie; before, each pair was a candidate."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(0, "ab"[i % 2], f"c{i:04d}", rng.normal(size=4).tolist()) for i in range(500)], "g int, namespace string, chunk_id string, embedding array<double>")
    asks = spark.createDataFrame([(0, 7, [1.0, 2.0], -2.0)], "g int, question_id int, vector array<double>, least double")
    got = blocks.met(asks, vectors, ["g"], 3).collect()
    assert sorted((r.namespace, r.chunk_id, r.raw) for r in got) == [("a", "c0000", 0.0), ("a", "c0002", 0.0), ("a", "c0004", 0.0), ("b", "c0001", 0.0), ("b", "c0003", 0.0), ("b", "c0005", 0.0)]


@pytest.mark.parametrize("width", (1, 7, 64, 1000))
def test_widths_find_what_one_product_finds(monkeypatch, width):
    monkeypatch.setattr(blocks, "WIDTH", width)
    rng, k = np.random.default_rng(width), 3
    rows = rng.integers(-2, 3, (300, 3)).astype(float)
    rows[::50] = 0
    rows[::70] = np.nan
    n = np.where(np.arange(300) % 9 == 0, 2, 3)
    rows[n == 2, 2] = 0
    (unit, odd), asked = blocks._units(rows), np.r_[0:40, 290:300]
    least = np.where(np.arange(50) % 4 == 0, 0.5, -2.0)
    r, c, raw = blocks._nearest((unit[asked], n[asked], odd[asked]), (unit, n, odd), least, k)
    got = {(int(i), int(j)) for i, j in zip(r, c)}
    assert len(got) == len(r)
    for i, q in enumerate(asked):
        mine = {j for a, j in got if a == i}
        if odd[q]:
            assert mine == set(range(300))
            continue
        cos = np.where(n == n[q], unit @ unit[q], 0.0)
        known = np.flatnonzero(~odd)
        first = sorted(known, key=lambda j: (-round(cos[j], 9), j))[:k]
        assert mine >= {j for j in first if cos[j] >= least[i]} | set(np.flatnonzero(odd))
        kth = cos[first[-1]]
        assert all(odd[j] or cos[j] >= max(kth, least[i]) - 2e-9 for j in mine)
    assert np.isnan(raw).sum() == sum(300 if odd[q] else odd.sum() for q in asked)
