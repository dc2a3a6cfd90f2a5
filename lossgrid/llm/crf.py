"""Quality classifier: a linear-chain conditional random field labels the lines of a text good or bad.

A line's features are its own and those of the lines next to it. Forward-backward gives each line's
probability of good; their mean, weighted by length, is the text's quality.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import _LANGS, _MULTIPLIERS, _TABLE, _WHERE, CLASSES, WINDOW

#: Bounds of the training sample, for each label: documents, and the lines of them all. Documents come whole or not at all.
SAMPLE_DOCS = 2000
SAMPLE_LINES = 100_000
KEEP_FROM = 0.3
STEPS = 250
RIDGE = 1e-3
#: Lines of a text, and lines of chains side by side, that are held in full at a time; they bound memory, not the work.
BLOCK_LINES = 32_768
CELLS = 262_144
#: Fewer chains than this advance one by one, without arrays.
FEW = 4

OWN = ("length", "short", "words", "space", "lower", "upper", "other", "digit", "stop", "mark", "symbol", "rest", "word length", "same words", "frequent", "twice in text", "line twice", "ends in stop", "symbol ends", "empty")


def _covered(ids: np.ndarray) -> np.ndarray:
    """For each word of a text, whether it stands in a window that the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key += ids[j : j + n].astype(np.uint64) * _MULTIPLIERS[j]
    in_order = np.sort(key)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return np.zeros(len(ids), bool)
    start = np.isin(key, twice).astype(np.int64)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += start
    edge[WINDOW : WINDOW + n] -= start
    return np.cumsum(edge)[:-1] > 0


def own_features(text: str | None) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Features of each line by itself, in blocks of BLOCK_LINES lines, and the lines' lengths + 1. Null text is one empty line."""
    lines = (text or "").split("\n")
    n, k = len(lines), len(CLASSES)
    number: dict[str, int] = {}
    ids: list[np.ndarray] = []
    n_words, distinct = np.zeros(n), np.zeros(n)
    often: dict[str, int] = {}
    for low in range(0, n, BLOCK_LINES):
        part: list[int] = []
        for i in range(low, min(n, low + BLOCK_LINES)):
            words = lines[i].split()
            n_words[i] = len(words)
            distinct[i] = len(set(words))
            part += [number.setdefault(w, len(number)) for w in words]
            often[lines[i]] = often.get(lines[i], 0) + 1
        ids.append(np.array(part, dtype=np.int64))
    which = np.concatenate(ids)
    hits = np.zeros((len(_LANGS), max(1, len(number))), np.float32)
    symbol = np.zeros(max(1, len(number)), np.float32)
    for w, j in number.items():
        for lang, _ in _WHERE.get(w.strip(".,;:!?").lower(), ()):
            hits[lang, j] = 1
        symbol[j] = w[-1] in "#*$%&|<>!" and len(w) > 1 and w[-2] in "#*$%&|<>!"
    if len(which):
        hit = hits[int((hits @ np.bincount(which, minlength=hits.shape[1])).argmax())]
    else:
        hit = hits[0]
    twice = _covered(which)

    def blocks() -> Iterator[np.ndarray]:
        at = 0
        for low, mine in zip(range(0, n, BLOCK_LINES), ids):
            part = lines[low : low + BLOCK_LINES]
            m = len(part)
            codes = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
            place = np.cumsum(codes == 10)
            count = np.bincount(place * k + kind, minlength=m * k).reshape(m, k).astype(np.float32) if len(codes) else np.zeros((m, k), np.float32)
            count[:, 1] = 0
            chars = np.maximum(1, count.sum(axis=1))
            words = n_words[low : low + m]
            total = np.maximum(1, words)
            line_of = np.repeat(np.arange(m), words.astype(np.int64))
            per = lambda values: np.bincount(line_of, weights=values, minlength=m) / total
            share = count / chars[:, None]
            ends = [x.rstrip()[-1:] in (".", ":", ";", "?", "!") if x else 0 for x in part]
            yield np.stack([
                np.log1p(chars) / 8, words <= 3, np.log1p(words) / 6, share[:, 0] + share[:, 2], share[:, 3] + share[:, 5], share[:, 4] + share[:, 6], share[:, 5],
                share[:, 7], share[:, 8], share[:, 9], share[:, 10], share[:, 11] + share[:, 12], np.minimum(chars / total, 30) / 10, 1 - distinct[low : low + m] / total,
                per(hit[mine]), per(twice[at : at + len(mine)]), [often[x] > 1 and len(x) > 0 for x in part], ends, per(symbol[mine]), words == 0,
            ], axis=1).astype(np.float32)
            at += len(mine)

    return blocks(), np.array([len(x) + 1 for x in lines], dtype=np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line: its own, those of the line before and of the line after (zeros at the ends), and 1."""
    edge = np.zeros((1, own.shape[1]), np.float32)
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge]), np.ones((len(own), 1), np.float32)], axis=1)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (own, of the line before, of the line after, 1), and its length + 1."""
    blocks, weight = own_features(text)
    return with_neighbours(np.concatenate(list(blocks))), weight


@dataclass(frozen=True)
class Model:
    """weights of good against bad, and scores of the four steps from label to label; mean and width of the features."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    width: np.ndarray

    def unary(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The score of good of each line, and the lines' lengths + 1; no more than a block's features are held."""
        blocks, weight = own_features(text)
        scaled = self.weights / self.width
        k = len(OWN)
        here, before, after = scaled[:k], scaled[k : 2 * k], scaled[2 * k : 3 * k]
        out = np.full(len(weight), scaled[3 * k] - self.mean @ scaled)
        at = 0
        for own in blocks:
            upto = at + len(own)
            out[at:upto] += own @ here
            told = own @ before
            out[at + 1 : upto + 1] += told[: len(out) - at - 1]
            told = own @ after
            first = max(0, at - 1)
            out[first : upto - 1] += told[first + 1 - at :]
            at = upto
        return out, weight


def _grid(lengths: np.ndarray) -> np.ndarray:
    """For chains that stand one after another: the place of line t of chain c at [t, c], -1 beyond its end."""
    t = np.arange(int(lengths.max()) if len(lengths) else 0)[:, None]
    first = (np.cumsum(lengths) - lengths)[None, :]
    return np.where(t < lengths[None, :], first + t, -1)


def side_by_side(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The chains in groups of like length, longest first, so that the longest of a group times its size is at most CELLS, or it is one."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def _places(group: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = (np.cumsum(lengths) - lengths)[group]
    inner = np.arange(int(lengths[group].sum())) - np.repeat(np.cumsum(lengths[group]) - lengths[group], lengths[group])
    return np.repeat(first, lengths[group]) + inner


def forward_backward(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains that stand one after another: each line's probability of good, and the sums of the pair
    probabilities of neighbours."""
    prob, pairs = np.zeros(len(unary)), np.zeros((2, 2))
    for group in side_by_side(lengths):
        at = _places(group, lengths)
        prob[at], more = _together(unary[at], lengths[group], moves)
        pairs += more
    return prob, pairs


def _together(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forward_backward of chains that advance together, longest first."""
    grid = _grid(lengths)
    live = (grid >= 0).sum(axis=1)
    prob = np.zeros(len(unary))
    n = len(lengths)
    alpha = np.zeros((len(grid), n, 2))
    score = lambda t, m: np.stack([np.zeros(m), unary[grid[t, :m]]], axis=1)
    for t, m in enumerate(live):
        a = score(t, m)
        if t:
            before = alpha[t - 1, :m]
            a += np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
        alpha[t, :m] = a
    beta = np.zeros((n, 2))
    pairs = np.zeros((2, 2))
    for t in range(len(grid) - 1, -1, -1):
        m = live[t]
        if t + 1 < len(grid) and (m2 := live[t + 1]):
            after = beta[:m2] + score(t + 1, m2)
            joint = alpha[t, :m2, :, None] + moves[None] + after[:, None, :]
            top = joint.max(axis=(1, 2), keepdims=True)
            e = np.exp(joint - top)
            pairs += (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            fresh = np.logaddexp(moves[:, 0][None] + after[:, :1], moves[:, 1][None] + after[:, 1:])
            beta[:m2] = fresh
        gap = np.clip(alpha[t, :m, 0] + beta[:m, 0] - alpha[t, :m, 1] - beta[:m, 1], -700, 700)
        prob[grid[t, :m]] = 1 / (1 + np.exp(gap))
    return prob, pairs


def marginals(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probabilities of forward_backward alone. With two labels each pass carries one number, the log odds of good."""
    prob = np.zeros(len(unary))
    for group in side_by_side(lengths):
        if len(group) < FEW:
            for c in group:
                at = int(lengths[:c].sum())
                prob[at : at + lengths[c]] = _alone(unary[at : at + lengths[c]], moves)
        else:
            at = _places(group, lengths)
            grid = _grid(lengths[group])
            live = (grid >= 0).sum(axis=1)
            u, odds = unary[at], np.zeros(len(at))
            for t, m in enumerate(live):
                odds[grid[t, :m]] = u[grid[t, :m]]
                if t:
                    r = odds[grid[t - 1, :m]]
                    odds[grid[t, :m]] += np.logaddexp(moves[0, 1], moves[1, 1] + r) - np.logaddexp(moves[0, 0], moves[1, 0] + r)
            back = np.zeros(len(group))
            for t in range(len(grid) - 2, -1, -1):
                m = live[t + 1]
                r = u[grid[t + 1, :m]] + back[:m]
                back[:m] = np.logaddexp(moves[1, 0], moves[1, 1] + r) - np.logaddexp(moves[0, 0], moves[0, 1] + r)
                odds[grid[t, :m]] += back[:m]
            prob[at] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return prob


def _alone(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The marginals of one chain."""
    (m00, m01), (m10, m11) = moves.tolist()

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    odds = array("d", unary.tobytes())
    for t in range(1, len(odds)):
        r = odds[t - 1]
        odds[t] += add(m01, m11 + r) - add(m00, m10 + r)
    back = 0.0
    for t in range(len(odds) - 2, -1, -1):
        r = float(unary[t + 1]) + back
        back = add(m10, m11 + r) - add(m00, m01 + r)
        odds[t] += back
    return 1 / (1 + np.exp(-np.clip(np.frombuffer(odds), -700, 700)))


def fit(chains: list[np.ndarray], labels: list[int], steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam; every line of a text has the text's label, each label as much weight."""
    x = np.concatenate(chains).astype(np.float64)
    lengths = np.array([len(c) for c in chains])
    y = np.repeat(np.array(labels, float), lengths)
    mean, width = x.mean(axis=0), x.std(axis=0)
    mean, width = np.where(width > 1e-6, mean, 0), np.where(width > 1e-6, width, 1)
    z = (x - mean) / width
    theta = np.zeros(z.shape[1] + 4)
    seen = np.zeros((2, 2))
    for label, n in zip(labels, lengths):
        seen[label, label] += n - 1
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        prob, pairs = forward_backward(z @ w, lengths, moves)
        grad = np.concatenate([z.T @ (y - prob), (seen - pairs).ravel()]) / len(z) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), mean, width)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Model | None:
    """Fit on at most per_label documents of each label, taken by a hash of doc_id while there is room for all their lines: of a label
    they have at most so many lines together, and a document that doesn't fit is passed over, not those after it.

    Rows held out (crc32 of doc_id mod 5 is 0) and null labels are left out; of labels that contradict the smaller counts; a doc_id with
    several rows counts once, with its least text. None if of one label there is no document that fits.
    """
    common.ready(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    by = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = known.filter("y = 0").orderBy(*by).limit(per_label).unionByName(known.filter("y = 1").orderBy(*by).limit(per_label))
    # at most twice per_label ids are broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = common.save(rows.withColumn("m", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1), "crf-sample")
    room, fits = {0: lines, 1: lines}, []
    # a few numbers of each of at most twice per_label documents
    for r in rows.select("doc_id", "y", "m").orderBy(*by).collect():
        if r["m"] <= room[r["y"]]:
            room[r["y"]] -= r["m"]
            fits.append((r["doc_id"],))
    chosen = rows.join(F.broadcast(rows.sparkSession.createDataFrame(fits, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for pdf in batches:
            own = [np.concatenate(list(own_features(t)[0])) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [x.tobytes() for x in own], "n": [len(x) for x in own]})

    # at most twice so many lines' own features reach the driver
    got = chosen.mapInPandas(run, "doc_id long, y int, x binary, n long").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], bytes(r["x"])))
    if len({r["y"] for r in got}) < 2:
        return None
    return fit([with_neighbours(np.frombuffer(r["x"], np.float32).reshape(r["n"], -1)) for r in got], [r["y"] for r in got])


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def scorer(model: Model | None):
    """A column function: text to quality in [0, 1]. Without a model all are 0.5. Null text is empty: one empty line."""
    if model is None:
        return lambda text: F.lit(0.5)

    def score(text: pd.Series) -> pd.Series:
        out, part, held = [], [], 0

        def flush():
            lengths = np.array([len(w) for _, w in part])
            prob = marginals(np.concatenate([u for u, _ in part]), lengths, model.moves)
            weight = np.concatenate([w for _, w in part])
            first = np.cumsum(lengths) - lengths
            out.append(np.add.reduceat(prob * weight, first) / np.add.reduceat(weight, first))
            part.clear()

        for t in text:
            part.append(model.unary(t))
            held += len(part[-1][1])
            if held >= CELLS or len(part) >= 512:
                flush()
                held = 0
        if part:
            flush()
        return pd.Series(np.clip(np.concatenate(out), 0, 1) if out else [], dtype=float)

    return F.pandas_udf(score, "double")


def op10_crf(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents: doc_id, held_out, score, predicted. A null doc_id is not held out; null and empty texts are one empty
    line; repeated rows score alike; other columns take no part; an empty table gives no rows."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(train(docs, common.read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model fitted on labels predicts good, with all their columns. Null and empty texts are scored as one
    empty line, repeated rows alike; without labels of both kinds all rows stay; an empty table stays empty."""
    score = scorer(train(docs, labels))
    return docs.filter(score(F.col("text")) >= KEEP_FROM)
