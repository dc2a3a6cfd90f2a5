"""Training samples with one very long labelled document, and with many rows of one; the two classifiers by given weights."""

import math

import numpy as np
import pytest

from lossgrid.llm import crf, toxicity

GOOD = "The river runs past the old stone house and the garden.\nEvening came and a letter lay on the table."
BAD = "zq%% || vile 77 $$$\n%% ## zq zq zq"


def tables(spark, extra):
    rows = [(i, f"{GOOD} {i}" if i % 2 else f"{BAD} {i}") for i in range(120)] + extra
    labels = [(i, i % 2, 1 - i % 2) for i in range(120)] + [(d, int(t.startswith("The")), int(not t.startswith("The"))) for d, t in dict(extra).items()]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def first_in_hash_order():
    import hashlib
    import zlib

    return min((i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_one_long_document_does_not_switch_the_model_off(spark):
    long = (first_in_hash_order(), "\n".join([GOOD.split("\n")[0]] * 200_000))
    plain, with_long = crf.train(*tables(spark, [])), crf.train(*tables(spark, [long]))
    assert with_long is not None
    asked = spark.createDataFrame([(f"{GOOD} {i}",) for i in range(5)] + [(f"{BAD} {i}",) for i in range(5)], "text string")
    one, two = ([r[0] for r in asked.select(crf.scorer(m)(asked["text"])).collect()] for m in (plain, with_long))
    assert np.abs(np.array(one) - np.array(two)).max() < 0.05 and min(one[:5]) > 0.5 > max(one[5:])


@pytest.mark.parametrize("module", [crf, toxicity])
def test_many_rows_of_one_labelled_document_count_once(spark, module):
    docs, labels = tables(spark, [])
    more = docs.unionByName(docs.filter("doc_id < 4").crossJoin(spark.range(300)).select("doc_id", "text"))
    one, two = module.train(docs, labels), module.train(more, labels)
    asked = docs.select(module.scorer(one)(docs["text"]).alias("a"), module.scorer(two)(docs["text"]).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-9) for r in asked)


def test_line_scores_with_given_weights_by_enumeration():
    """A text's score is the length-weighted mean of the lines' marginals, here from all labellings of its lines."""
    rng = np.random.default_rng(3)
    k = 3 * len(crf.OWN) + 1
    model = crf.Model(rng.normal(0, 0.2, k), rng.normal(0, 1, (2, 2)), np.zeros(k), np.ones(k))
    for text in (GOOD, BAD, f"{GOOD}\n{BAD}\n\n{GOOD}", "", "one line"):
        unary, weight = model.unary(text)
        n, total, good = len(unary), 0.0, np.zeros(len(unary))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        want = float(((good / total) * weight).sum() / weight.sum())
        prob = crf.marginals(unary, np.array([n]), model.moves)
        assert float((prob * weight).sum() / weight.sum()) == pytest.approx(want, abs=1e-9)


def test_toxic_scores_with_given_weights():
    """A score is the logistic of what the model's features of the text weigh, its length and a constant."""
    words = toxicity.words_of(BAD)
    ids = np.array(sorted({f for w in words for f in toxicity.features_of(w)}), dtype=np.uint64)
    rng = np.random.default_rng(1)
    model = toxicity.Model(ids, rng.normal(0, 0.1, len(ids) + 2))
    score = model.scorer()
    for text in (BAD, GOOD, "", None, BAD + " " + GOOD):
        counted = toxicity._counted(toxicity.words_of(text))
        z = sum(w * float(np.log2(1 + counted[int(f)])) for f, w in zip(ids, model.weights)) + model.weights[-2] * math.log1p(len(toxicity.words_of(text))) + model.weights[-1]
        assert score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
