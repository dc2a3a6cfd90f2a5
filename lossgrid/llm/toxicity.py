"""Toxicity: a logistic classifier of words and word beginnings, with a penalty on what swapped identity terms change."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .crf import held_out

#: Names of groups of people, two and two of a kind; each is swapped for the other.
IDENTITY = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "protestants"), ("hindu", "buddhist"), ("black", "white"), ("african", "european"),
    ("asian", "american"), ("mexican", "canadian"), ("arab", "nordic"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugees", "residents"), ("disabled", "abled"),
    ("deaf", "hearing"), ("blind", "sighted"), ("elderly", "young"), ("femmes", "hommes"), ("musulmans", "catholiques"), ("juifs", "protestants"), ("noirs", "blancs"),
    ("frauen", "männer"), ("muslime", "christen"), ("juden", "katholiken"), ("schwarze", "weiße"), ("mujeres", "hombres"), ("musulmanes", "cristianos"), ("judíos", "católicos"), ("negros", "blancos"),
]
#: Bounds of the training sample: documents with the label and without.
SAMPLE = {1: 1500, 0: 3000}
#: Features: those in so many documents of the sample at least, and the most telling of them.
LEAST_DOCS = 4
FEATURES = 2000
LEAST_Z = 3.5
SWAP_WEIGHT = 5.0
RIDGE = 2e-3
STEPS = 250
#: Lengths of the word beginnings.
STARTS = (4, 5, 6, 7)
#: Words whose features a worker keeps, and their length: they bound its memory.
KEEP = 100_000
KEEP_CHARS = 24

_WORD = re.compile(r"[^\W\d_]+")
_SWAP = {a: b for a, b in IDENTITY} | {b: a for a, b in IDENTITY}


def features_of(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    names = ["w" + word] + [f"{n}{word[:n]}" for n in STARTS if len(word) > n]
    return [xxhash.xxh64_intdigest(x) >> 1 for x in names]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    """ids: the features in order; weights: theirs, then of the log of the number of words, then the constant."""

    ids: np.ndarray
    weights: np.ndarray

    def scorer(self):
        place = {int(f): i for i, f in enumerate(self.ids)}
        known: dict[str, tuple] = {}
        weights = self.weights.tolist()
        log = np.log2(1 + np.arange(4096)).tolist()

        def one(text: str | None) -> float:
            words = words_of(text)
            count: Counter = Counter()
            for w in words:
                hit = known.get(w)
                if hit is None:
                    hit = tuple(place[f] for f in features_of(w) if f in place)
                    if len(known) < KEEP and len(w) <= KEEP_CHARS:
                        known[w] = hit
                if hit:
                    count.update(hit)
            z = weights[-1] + weights[-2] * np.log1p(len(words))
            for i, n in count.items():
                z += weights[i] * (log[n] if n < len(log) else math.log2(1 + n))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return one


def _swapped(words: set[str], pick: int) -> tuple[set[str], set[str]]:
    """A text's words and its counterpart: identity terms swapped; if it has none, one put in, and its partner."""
    own = {w for w in words if w in _SWAP}
    if own:
        return words, (words - own) | {_SWAP[w] for w in own}
    a, b = IDENTITY[pick % len(IDENTITY)]
    return words | {a}, words | {b}


def _counted(words: set[str]) -> Counter:
    return Counter(f for w in words for f in features_of(w))


def _row(words: set[str], place: dict[int, int], pick: int) -> tuple[dict[int, float], dict[int, float]]:
    """Values of the chosen features, and what swapping identity terms takes from them."""
    def values(w: set[str]) -> dict[int, float]:
        return {place[f]: float(np.log2(1 + n)) for f, n in _counted(w).items() if f in place}

    one, other = (values(w) for w in _swapped(words, pick))
    gap = {i: one.get(i, 0.0) - other.get(i, 0.0) for i in one.keys() | other.keys()}
    return values(words), {i: g for i, g in gap.items() if g}


def fit(ids: np.ndarray, rows: list[tuple[dict, dict, int]], labels: list[int], steps: int = STEPS) -> Model:
    """rows: values, swap differences and number of words of each text. Logistic loss with each label as heavy as the
    other, a ridge, and SWAP_WEIGHT times the mean square of what swapping identity terms changes in the log odds."""
    y = np.array(labels, dtype=np.float32)
    x = np.zeros((len(rows), len(ids) + 2), np.float32)
    swap = np.zeros((len(rows), len(ids)), np.float32)
    for r, (values, gaps, n) in enumerate(rows):
        for i, v in values.items():
            x[r, i] = v
        for i, v in gaps.items():
            swap[r, i] = v
        x[r, -2:] = np.log1p(n), 1
    cols = np.flatnonzero(np.abs(swap).sum(axis=0) > 0)
    swap = swap[:, cols].copy()
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    theta, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        grad = x.T @ (weight * (p - y)) + RIDGE * np.append(theta[:-2], [0, 0])
        grad[cols] += 2 * SWAP_WEIGHT / len(rows) * (swap.T @ (swap @ theta[cols]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = (theta - 0.04 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)).astype(np.float32)
    return Model(ids, theta.astype(float))


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model | None:
    """Fit on so many documents of each label at most, the first by a hash of doc_id; rows held out and null labels
    are left out; a doc_id with several rows counts once, with its least text. None if one label is missing. Only the chosen
    features' values reach the driver."""
    common.ready(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    by = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = known.filter("y = 1").orderBy(*by).limit(sample[1]).unionByName(known.filter("y = 0").orderBy(*by).limit(sample[0]))
    # as many ids as the sample is large are broadcast
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    chosen = common.save(chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxic-sample")
    n = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["text"]):
                seen[int(y)].update(_counted(words_of(t)).keys())
        for y, c in seen.items():
            yield pd.DataFrame({"f": np.fromiter(c.keys(), np.int64, len(c)), "k1": [k * y for k in c.values()], "k0": [k * (1 - y) for k in c.values()]})

    each = chosen.mapInPandas(count, "f long, k1 long, k0 long").groupBy("f").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).filter(F.col("k1") + F.col("k0") >= LEAST_DOCS)
    p = (F.col("k1") + F.col("k0") + 1) / (n[1] + n[0] + 2)
    z = F.abs(F.col("k1") / n[1] - F.col("k0") / n[0]) / F.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))
    named = sorted({f for pair in IDENTITY for w in pair for f in features_of(w)})
    told = each.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()
    ids = np.array(sorted({*(r["f"] for r in told), *named}), dtype=np.uint64)
    place = {int(f): i for i, f in enumerate(ids)}

    def rows(batches):
        for pdf in batches:
            out = []
            for d, y, t in zip(pdf["doc_id"], pdf["y"], pdf["text"]):
                words = words_of(t)
                x, gap = _row(words, place, int(d))
                out.append((int(d), int(y), len(words), list(x), list(x.values()), list(gap), list(gap.values())))
            yield pd.DataFrame(out, columns=["doc_id", "y", "n", "xi", "xv", "gi", "gv"])

    got = chosen.mapInPandas(rows, "doc_id long, y int, n long, xi array<int>, xv array<float>, gi array<int>, gv array<float>").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["n"], r["xi"]))
    return fit(ids, [(dict(zip(r["xi"], r["xv"])), dict(zip(r["gi"], r["gv"])), r["n"]) for r in got], [r["y"] for r in got])


def scorer(model: Model | None):
    """A column function: text to toxicity in [0, 1]. Without a model all are 0. Null text is empty."""
    if model is None:
        return lambda text: F.lit(0.0)
    made = []

    def score(text: pd.Series) -> pd.Series:
        if not made:
            made.append(model.scorer())
        return pd.Series([made[0](t) for t in text], dtype=float)

    return F.pandas_udf(score, "double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents: doc_id, held_out, score, predicted. A null doc_id is not held out; null and empty texts are texts without
    words; repeated rows score alike; a score of just 0.5 is predicted 1; other columns take no part, whatever their
    names; without labels of both kinds all scores are 0; an empty table gives no rows."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(train(docs, common.read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
