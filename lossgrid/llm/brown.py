"""Class-based bigrams: exchange clustering assigns words to classes; class transitions and word emissions score a text.

What is moved between classes is a unit: a word that occurs LEAST_COUNT times and makes at least one of LEAST_SHARE training tokens, or all
rarer words that end alike, which have too few occurrences each to be placed by themselves. There are at most LEAST_SHARE + GROUPS units whatever the corpus, so
their classes fit any worker, while counts of words and of neighbouring units are tables that grow with it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: No word, as it is white space: the end of each text, and what stands before its first word.
END = " "
#: A word stands for itself if it occurs so often at least, too few occurrences say nothing of its neighbours, and makes at least one of so
#: many training tokens, so no more than so many words do; longer ones don't.
LEAST_COUNT, LEAST_SHARE, LEADER_BYTES = 10, 500_000, 64
GROUPS, CLASSES = 512, 48
#: In a sweep each unit may move once, in one of so many parts: those of a part move together.
SWEEPS, PARTS = 2, 2
#: Weight of class frequencies in transitions and of equal shares in emissions.
TRANSITION_PRIOR, EMISSION_PRIOR = 20.0, 0.5
#: Bytes of a text that are cut into words at a time; pairs that a task holds before it counts them; words it holds.
PIECE, HELD_PAIRS, HELD_WORDS = 1 << 20, 1 << 22, 500_000

_SPACE = re.compile(rb"[ \t-\r]")


def pieces(text: bytes | None):
    """The words of a text, A to Z lowered, in lists of bounded size. bytes.split cuts at just the six ASCII characters of white space."""
    at, n = 0, len(text or b"")
    while at < n:
        found = _SPACE.search(text, at + PIECE) if at + PIECE < n else None
        end = found.start() if found else n
        yield text[at:end].lower().split()
        at = end


def learnt_from(doc_id: F.Column) -> F.Column:
    """Rows to learn from; a null doc_id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(True))


class Units(dict):
    """From word to unit: END is 0, then the words that stand for themselves, then the groups by the last three bytes."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + zlib.crc32(word[-3:]) % GROUPS


def group_of(word: F.Column) -> F.Column:
    """The group of a word that is no unit of its own, as Units has it."""
    return (F.crc32(F.substring(F.encode(word, "UTF-8"), -3, 3)) % GROUPS).cast("int")


def units_of(leaders: list[str]) -> Units:
    return Units({w.encode(): i for i, w in enumerate([END, *leaders])})


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text) to (word, n), END among them once a row."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            held[END.encode()] += batch.num_rows
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for words in pieces(text):
                    held.update(words)
                    if len(held) >= HELD_WORDS:
                        yield out()
        if held:
            yield out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, units: Units) -> DataFrame:
    """texts (text) to (u, v, n): how often unit v follows unit u. At most the square of the number of units, in practice as many as there are
    different neighbours; each task sends the pairs it has counted."""
    known = dict(units)

    def count(batches):
        units, held, n = Units(known), [], 0

        def out():
            code, k = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(k.astype(np.int64))], ["u", "v", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                last = 0
                for words in pieces(text):
                    ids = np.array([last, *map(units.__getitem__, words)], np.int64)
                    held.append(ids[:-1] << 32 | ids[1:])
                    last, n = int(ids[-1]), n + len(words)
                    if n >= HELD_PAIRS:
                        yield out()
                        n = 0
                held.append(np.array([last << 32], np.int64))
        if held:
            yield out()

    return texts.select("text").mapInArrow(count, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """What classes contribute to the log likelihood: m counts their transitions."""
    return float(_phi(m).sum() - _phi(m.sum(axis=0)).sum() - _phi(m.sum(axis=1)).sum())


def gains(m: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A row a unit, a column a class: what the likelihood gains if the unit alone moves there, less a constant of the unit.

    own: the units' classes; out, into: how often units of each class follow and precede the unit, itself left out; same: how often the
    unit follows itself. m counts all transitions, the units' own included.
    """
    k, n = np.arange(len(own)), np.repeat(m[None], len(own), axis=0).astype(float)
    n[k, own, :] -= out
    n[k, :, own] -= into
    n[k, own, own] -= same
    # what precedes and follows the unit counts in the other classes' sums wherever the unit is
    rows, cols = n.sum(axis=2) + into, n.sum(axis=1) + out
    row = _phi(n + out[:, None, :]) - _phi(n)
    col = _phi(n + into[:, :, None]) - _phi(n)
    at = np.arange(m.shape[0])
    gain = row.sum(axis=2) - row[:, at, at] + col.sum(axis=1) - col[:, at, at]
    mid = n[:, at, at]
    gain += _phi(mid + out + into + same[:, None]) - _phi(mid)
    follows, precedes = out.sum(axis=1) + same, into.sum(axis=1) + same
    return gain - _phi(rows + follows[:, None]) + _phi(rows) - _phi(cols + precedes[:, None]) + _phi(cols)


def neighbours(pairs: DataFrame) -> DataFrame:
    """pairs (u, v, n) to a row a unit: w, other, n. other: twice a unit, and one more if it follows w, else it stands before. A unit has at
    most two entries for each other one, so a row is bounded."""

    def gather(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def made(cols: list[np.ndarray]) -> pa.RecordBatch:
            w, other, n = cols
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
            cuts = pa.array(np.append(first, len(w)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(w[first].astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(other.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n))], ["w", "other", "n"])

        for b in batches:
            cols = [np.append(h, b.column(i).to_numpy()) for i, h in enumerate(held)]
            done = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if done:
                yield made([c[:done] for c in cols])
            held = [c[done:] for c in cols]
        if len(held[0]):
            yield made(held)

    sides = pairs.select(F.col("u").alias("w"), (F.col("v") * 2 + 1).alias("other"), "n").unionByName(pairs.select(F.col("v").alias("w"), (F.col("u") * 2).alias("other"), "n"))
    return sides.repartition("w").sortWithinPartitions("w").mapInArrow(gather, "w int, other array<int>, n array<long>")


def exchange(pairs: DataFrame, n_units: int, classes: int = CLASSES, sweeps: int = SWEEPS, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and the counts of their transitions, by pairs (u, v, n).

    END is class 0 alone. The first units, the commonest, begin with a class each, all others in the last. In each round the units
    of one part go where the likelihood gains most with all others in place; then the transitions are counted anew, as moves made by
    counts of before the last ones undo each other. The best of all rounds' classes is returned. The driver gets moves, at most one a
    unit, and one matrix.
    """
    around = common.save(neighbours(pairs).filter("w > 0"), "brown-around")

    def matrix(at: np.ndarray) -> np.ndarray:
        def add(batches):
            total = np.zeros(classes * classes)
            for b in batches:
                u, v, n = (b.column(i).to_numpy() for i in range(3))
                total += np.bincount(at[u] * classes + at[v], n, classes * classes)
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i].astype(np.int64))], ["i", "n"])

        got = pairs.select("u", "v", "n").mapInArrow(add, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        m = np.zeros(classes * classes)
        for r in got:
            m[r["i"]] = r["n"]
        return m.reshape(classes, classes)

    def moves(at: np.ndarray, m: np.ndarray, part: int) -> list:
        def look(batches):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    some = b.slice(i, 256)
                    w, other, n = some.column(0).to_numpy(), some.column(1).flatten().to_numpy(), some.column(2).flatten().to_numpy().astype(float)
                    of = np.repeat(np.arange(len(w)), np.diff(some.column(1).offsets.to_numpy()))
                    self = other >> 1 == w[of]
                    same = np.bincount(of, np.where(self & (other & 1 == 1), n, 0), len(w))
                    n[self] = 0
                    side = np.bincount(((other & 1) * len(w) + of) * classes + at[other >> 1], n, 2 * len(w) * classes).reshape(2, len(w), classes)
                    gain = gains(m, at[w], side[1], side[0], same)
                    gain[:, 0] = -np.inf
                    best, k = gain.argmax(axis=1), np.arange(len(w))
                    go = gain[k, best] > gain[k, at[w]] + 1e-6
                    yield pa.RecordBatch.from_arrays([pa.array(w[go].astype(np.int32)), pa.array(best[go].astype(np.int32))], ["w", "to"])

        return around.filter(F.col("w") % parts == part).mapInArrow(look, "w int, to int").collect()

    at = np.minimum(np.arange(n_units), classes - 1).astype(np.int64)
    m = matrix(at)
    best = (likelihood(m), at, m)
    for turn in range(sweeps * parts):
        if moved := moves(at, m, turn % parts):
            at = at.copy()
            at[[r["w"] for r in moved]] = [r["to"] for r in moved]
            m = matrix(at)
            best = max(best, (likelihood(m), at, m), key=lambda x: x[0])
    return best[1], best[2]


@dataclass
class Model:
    """log10 of everything. trans: class to class; emit: a unit, given its class; base: a unit's word by itself, 0 for groups; known
    and unknown: what a word of a group adds, if it was counted (and log10 of its count more) or not."""

    leaders: list[str]
    at: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    base: np.ndarray
    known: np.ndarray
    unknown: np.ndarray
    tokens: int
    words: int


def model_of(leaders: list[str], counts: np.ndarray, once: np.ndarray, kinds: np.ndarray, at: np.ndarray, m: np.ndarray, words: int) -> Model:
    """counts: occurrences of each unit; once, kinds: of each group, words that occur once and all words; m: transitions of classes.

    A transition is P(d|c) = (m[c,d] + a q(d)) / (m[c] + a), q the classes' shares plus one; a unit of class d has (n + b) / (n(d) + b units
    of d). In a group an unseen word has the share of those seen once, all of them one kind, and a seen word its share of the rest; a group
    without words has unseen ones only. All sum to one.
    """
    total, classes = int(counts.sum()), len(m)
    of_class, units_in = np.bincount(at, counts, classes), np.bincount(at, minlength=classes)
    share = (of_class + 1) / (total + classes)
    trans = (m + TRANSITION_PRIOR * share) / (m.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    emit = (counts + EMISSION_PRIOR) / (of_class[at] + EMISSION_PRIOR * units_in[at])
    n = counts[len(leaders) + 1 :]
    unseen = np.where(kinds > 0, (once + 0.5) / (n + 1.0), 1.0)
    known = np.log10(np.maximum(1 - unseen, 1e-300)) - np.log10(np.maximum(n, 1))
    base = np.log10(counts + 1.0) - np.log10(total + words + 1.0)
    base[len(leaders) + 1 :] = 0
    return Model(leaders, at, np.log10(trans), np.log10(emit), base, known, np.log10(unseen), total, words)


def train(texts: DataFrame, share: int = LEAST_SHARE, classes: int = CLASSES, least: int = LEAST_COUNT) -> tuple[Model, DataFrame]:
    """The model of all texts (text), and the table (word, n) of their words."""
    texts = texts.select("text")
    vocabulary = common.save(word_counts(texts), "brown-words")
    tokens, words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # at most so many words, of so many bytes, reach the driver
    first = vocabulary.filter((F.col("n") >= least) & (F.col("n") * share >= tokens) & (F.octet_length("word") <= LEADER_BYTES) & (F.col("word") != END)).orderBy(F.desc("n"), "word").collect()
    leaders = [r["word"] for r in first]
    units = units_of(leaders)
    known = dict(units)

    def group(batches):
        units, total = Units(known), np.zeros((GROUPS, 3), np.int64)
        for b in batches:
            n = b.column(1).to_numpy()
            ids = np.fromiter(map(units.__getitem__, b.column(0).cast(pa.binary()).to_pylist()), np.int64, b.num_rows) - len(units)
            rare = ids >= 0
            for i, x in enumerate((n, n == 1, n > 0)):
                total[:, i] += np.bincount(ids[rare], x[rare], GROUPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS, dtype=np.int32)), *map(pa.array, total.T)], ["g", "n", "once", "kinds"])

    groups = np.zeros((GROUPS, 3))
    sums = [F.sum(c).alias(c) for c in ("n", "once", "kinds")]
    for r in vocabulary.mapInArrow(group, "g int, n long, once long, kinds long").groupBy("g").agg(*sums).collect():
        groups[r["g"]] = r["n"], r["once"], r["kinds"]
    ends = vocabulary.filter(F.col("word") == END).first()
    counts = np.concatenate([[ends["n"] if ends else 0], [r["n"] for r in first], groups[:, 0]]).astype(float)
    pairs = common.save(pair_counts(texts, units), "brown-pairs")
    at, m = exchange(pairs, len(counts), classes)
    return model_of(leaders, counts, groups[:, 1], groups[:, 2], at, m, words), vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_tokens, n_known, base_score and score, a row a row. Common words are scored where the text is; the
    rarer ones of each text meet the table of words, and one sum a text comes back."""

    def run(batches):
        units, low = units_of(model.leaders), len(model.leaders) + 1
        for batch in batches:
            heads, words_at, rare, times = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                last, n, seen, base, total, before_it = 0, 0, 0, 0.0, 0.0, len(rare)
                for words in itertools.chain(pieces(text), [[END.encode()]]):
                    ids = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
                    to = model.at[ids]
                    before = np.append(model.at[last], to[:-1])
                    total += float(model.trans[before, to].sum() + model.emit[ids].sum())
                    base += float(model.base[ids].sum())
                    last = int(ids[-1]) if len(ids) else last
                    n += len(words)
                    spots = np.flatnonzero(ids >= low).tolist()
                    seen += len(words) - len(spots)
                    counted = Counter(map(words.__getitem__, spots))
                    rare += counted
                    times += counted.values()
                words_at.append(len(rare) - before_it)
                heads.append((n, seen - (model.tokens == 0), base, total))
            cols = list(zip(*heads)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds), pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.int32())], names)
            rid = np.repeat(batch.column(0).to_numpy(), words_at)
            for i in range(0, len(rare), 1 << 16):
                part = slice(i, i + (1 << 16))
                k = len(rare[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[part]), pa.nulls(k, batch.column(1).type), *[pa.nulls(k, t) for t in kinds], pa.array(rare[part], pa.binary()).cast(pa.string()), pa.array(times[part], pa.int32())], names)

    names = ["rid", "doc_id", "n_tokens", "n_known", "base", "score", "word", "k"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    got = common.save(rows.mapInArrow(run, f"rid long, doc_id {id_type}, n_tokens long, n_known long, base double, score double, word string, k int"), "brown-scored")
    rare = got.filter("word IS NOT NULL").select("rid", "word", "k").join(vocabulary.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    groups = docs.sparkSession.createDataFrame([(g, float(x), float(y)) for g, (x, y) in enumerate(zip(model.known, model.unknown))], "g int, known double, unknown double")
    rare = rare.withColumn("g", group_of(F.col("word"))).join(F.broadcast(groups), "g")  # GROUPS rows
    seen = F.col("c") > 0
    rare = rare.select(
        "rid", F.when(seen, F.col("k")).otherwise(0).cast("long").alias("n_known"),
        (F.col("k") * (F.log10(F.col("c") + 1) - F.lit(float(np.log10(model.tokens + model.words + 1.0))))).alias("base"),
        (F.col("k") * F.when(seen, F.col("known") + F.log10("c")).otherwise(F.col("unknown"))).alias("score"),
    )
    rare = rare.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    all_of = got.filter("word IS NULL").select("rid", "doc_id", "n_tokens", "n_known", "base", "score").unionByName(rare, allowMissingColumns=True)
    out = all_of.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    return out.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def op12_brown(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts are their end alone; a null doc_id is not held out; repeated rows count again and score alike; a text of any
    length is cut into words piece by piece; without a text to learn from all words are unseen; an empty table gives no rows; other
    columns take no part.
    """
    with common.passing(spark):
        docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
        model, vocabulary = train(docs.filter(learnt_from(F.col("doc_id"))))
        out = score(docs, model, vocabulary).withColumns({"held_out": ~learnt_from(F.col("doc_id")), "train_tokens": F.lit(model.tokens).cast("long")})
        out = out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
        return common.save(out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"), "brown", stays=True)
