"""Class-based bigrams: gains against the likelihood, base score against a count, probabilities against one, held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lossgrid.llm import brown

RNG = random.Random(9)
FIRST, SECOND = [f"a{i}x" for i in range(30)], [f"b{i}y" for i in range(30)]


def sentence(n):
    """Words of two kinds by turns: a bigram of classes knows what comes, single words don't."""
    return " ".join(RNG.choice((FIRST, SECOND)[i % 2]) for i in range(n))


def words_of(text):
    low = (text or "").encode().lower().decode()
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [brown.END]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_gains_are_the_likelihood_s():
    rng = np.random.default_rng(1)
    units, classes = 14, 5
    pairs, at = rng.integers(0, 5, (units, units)).astype(float), rng.integers(0, classes, units)

    def matrix(at):
        m = np.zeros((classes, classes))
        np.add.at(m, (at[:, None], at[None, :]), pairs)
        return m

    out, into = (np.stack([np.bincount(at, np.where(np.arange(units) == u, 0, line[u]), classes) for u in range(units)]) for line in (pairs, pairs.T))
    gain = brown.gains(matrix(at), at, out, into, np.diag(pairs))
    for u in range(units):
        for c in range(classes):
            moved = at.copy()
            moved[u] = c
            assert gain[u, c] - gain[u, at[u]] == pytest.approx(brown.likelihood(matrix(moved)) - brown.likelihood(matrix(at)), abs=1e-6)


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("brown")
    docs = [(i, sentence(RNG.randrange(5, 60))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, " \t \n"), (None, "A1X a1x\vÉ é"), docs[5], docs[5], (403, sentence(20) + " " + "z" * 5000), (404, "neverseen " * 50)]
    spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, score double, n int").repartition(6).write.parquet(f"{top}/documents.parquet")
    return docs, brown.op12_brown(spark, str(top)).collect()


def test_base_score_is_the_contract_s(scored):
    docs, got = scored
    counts = Counter(w for d, t in docs if not held_out(d) for w in words_of(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(d), held_out(d), len(ws := words_of(t)), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for d, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_classes_tell_what_comes(scored):
    docs, got = scored
    kept = [r for r in got if r.held_out and r.n_tokens > 20 and r.doc_id < 400]
    assert len(kept) > 10
    gain = sum(r.score - r.base_score for r in kept) / sum(r.n_tokens for r in kept)
    assert gain > 0.2  # a class halves what may come: log10(2) is 0.3
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([(sentence(40),) for _ in range(50)] + [("rare one two two",)], "text string")
    model, vocabulary = brown.train(texts, share=60, classes=6)
    units = brown.units_of(model.leaders)
    counted = {r["word"].encode(): r["n"] for r in vocabulary.collect()}
    low = len(units)
    for c in range(6):
        total = 0.0
        for w, n in counted.items():
            u = units[w]
            own = 0 if u < low else model.known[u - low] + math.log10(n)
            total += 10 ** (model.trans[c, model.at[u]] + model.emit[u] + own)
        for g in range(brown.GROUPS):  # an unseen word of each group
            u = low + g
            total += 10 ** (model.trans[c, model.at[u]] + model.emit[u] + model.unknown[g])
        # classes that no unit is in keep a share that no word gets
        empty = sum(10 ** model.trans[c, d] for d in range(6) if d not in model.at)
        assert total + empty == pytest.approx(1, abs=1e-9)


def test_groups_of_words_in_both_engines(spark):
    words = ["a", "ab", "abc", "abcd", "é", "aé", "日本語", "x" * 99 + "ß", "\x85"]
    units, df = brown.units_of(["first"]), spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.g for r in df.select(brown.group_of(df["w"]).alias("g")).collect()] == [units[w.encode()] - 2 for w in words]


def test_pieces_of_long_texts(monkeypatch):
    text = (sentence(400) + "\n\x85 xé ") * 3
    whole = [w for p in brown.pieces(text.encode()) for w in p]
    monkeypatch.setattr(brown, "PIECE", 64)
    assert [w for p in brown.pieces(text.encode()) for w in p] == whole == [w.encode() for w in words_of(text)[:-1]]


def test_nothing_to_learn_from(spark, tmp_path):
    held = next(i for i in range(99) if held_out(i))
    spark.createDataFrame([(held, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = brown.op12_brown(spark, str(tmp_path)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
