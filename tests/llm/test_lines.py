"""The line model on long texts: blocks change nothing, and no line is left out."""

import resource
import subprocess
import sys

import numpy as np
import pytest

from lossgrid.llm import crf

RNG = np.random.default_rng(12)


def text(n):
    words = ["the", "of", "river.", "&&&", "42", "Stone", "été"]
    return "\n".join(" ".join(RNG.choice(words, int(RNG.integers(0, 12)))) for _ in range(n))


def model():
    k = 3 * len(crf.OWN) + 1
    return crf.Model(RNG.normal(size=k) * 0.2, RNG.normal(size=(2, 2)), RNG.normal(size=k) * 0.1, RNG.uniform(0.5, 2, k))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_change_no_score(monkeypatch, block):
    m, texts = model(), [None, "", "\n", "one", text(2), text(40)]
    whole = [((crf.line_features(t)[0].astype(float) - m.mean) / m.width) @ m.weights for t in texts]
    monkeypatch.setattr(crf, "BLOCK_LINES", block)
    for t, want in zip(texts, whole):
        got, weight = m.unary(t)
        assert np.allclose(got, want, atol=1e-4) and weight.tolist() == [len(x) + 1 for x in (t or "").split("\n")]


@pytest.mark.parametrize("cells", [1, 7, 10_000])
def test_marginals_are_those_of_forward_backward(monkeypatch, cells):
    lengths = np.array([3, 1, 40, 2, 40, 7, 1, 1, 5, 6])
    unary, moves = RNG.normal(size=int(lengths.sum())) * 3, RNG.normal(size=(2, 2))
    want, pairs = crf.forward_backward(unary, lengths, moves)
    monkeypatch.setattr(crf, "CELLS", cells)
    assert np.allclose(crf.marginals(unary, lengths, moves), want)
    again, more = crf.forward_backward(unary, lengths, moves)
    assert np.allclose(again, want) and np.allclose(more, pairs)


def test_a_million_lines_in_little_memory():
    code = """
import resource, sys
import numpy as np, pandas as pd
from lossgrid.llm import crf
k = 3 * len(crf.OWN) + 1
m = crf.Model(np.full(k, 0.1), np.eye(2), np.zeros(k), np.ones(k))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
t = "ab\\n" * 999_999 + "x"
u, w = m.unary(t)
p = crf.marginals(u, np.array([len(w)]), m.moves)
assert len(p) == 1_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert used < 300 * 1024 and resource.RUSAGE_SELF == 0


def test_sample_takes_documents_whole(spark):
    from pyspark.sql import functions as F

    rows = [(i, text(30) if i % 2 else "\n".join("&&& zq" for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    keep, crf.fit = crf.fit, lambda chains, y, **k: seen.append((chains, y))
    try:
        crf.train(docs, labels, lines=200)
        crf.train(docs, labels)
    finally:
        crf.fit = keep
    (few, y_few), (whole, _) = seen
    assert {len(c) for c in few} == {30} and y_few.count(0) == y_few.count(1) == 6 and len(whole) > 40
