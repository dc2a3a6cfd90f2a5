"""Near-duplicate documents: ProbMinHash of word shingles of one weight, banding, exact verification, components.

Rows with one text are one node from the start. Nodes that share a band's bucket are candidates. First every node is
verified against the centres of its buckets only (a star, never all pairs of a group); what that joins
is one component. Buckets that still hold several components are worked through in tasks of bounded blocks: the shingles
that any two nodes of a task share are counted exactly, and of the links between components only
as many as connect them leave the task. Nodes travel as their exact difference from one root of all that buckets
connect, so a group of near copies is shipped as its edits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import words_of

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, about 5e-6, were registers independent.
BANDS, ROWS = 40, 6
#: Registers: the least prime that holds all bands, so that steps through them are permutations.
REGISTERS = 241
#: Nodes of a block of a bucket, and shingles of a block, on average: they bound the memory of a task, not the work.
BLOCK = 256
BLOCK_SHINGLES = 500_000
#: Shingles that are counted at a time.
COLUMNS = 4096
CHUNK_DOCS = 512
CHUNK_SHINGLES = 400_000
#: Words whose hashes a worker keeps, and their length: they bound its memory.
KEEP_WORDS = 50_000
KEEP_CHARS = 24

_U = np.uint64
_MULTIPLY = np.random.default_rng(11).integers(1, 2**63, max(WORDS, ROWS) + 1, dtype=np.uint64) * _U(2) + _U(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEEP_WORDS and len(word) <= KEEP_CHARS:
            self[word] = h
        return h


_word_hash = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """A 64-bit hash of each run of five words of the lower-cased text, in order; of fewer words, one of them all; of none, none."""
    words = words_of((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return (h * _MULTIPLY[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _U(len(h))
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for j in range(WORDS):
        out += h[j : j + n] * _MULTIPLY[j]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prob_min_hash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The signatures of n_docs weighted sets that stand one after another; a register agrees with the probability Jaccard similarity.

    Each element is a Poisson process of its weight's rate. Its points go to the registers in an order of its
    own, each once, with the gaps stretched to match; each register keeps the element of its first point. A round takes
    one point of every element still live; an element ends when its next point lies beyond all registers of its set.
    """
    best = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint64)
    seed = _mix(element)
    first = (_mix(seed ^ _U(0x1234567)) % _U(registers)).astype(np.int64)
    step = (_mix(seed ^ _U(0x89ABCDE)) % _U(registers - 1)).astype(np.int64) + 1
    time = np.zeros(len(element))
    base = doc * registers
    live = np.arange(len(element))
    for i in range(registers):
        h, d = seed[live], doc[live]
        u = ((_mix(h + _U(((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = time[live] - np.log(u) / weight[live] * (registers / (registers - i))
        top = best.reshape(n_docs, registers).max(axis=1)
        on = t < top[d]
        live, t = live[on], t[on]
        if not len(live):
            break
        time[live] = t
        at = base[live] + (first[live] + i * step[live]) % registers
        np.minimum.at(best, at, t)
        won = t == best[at]
        held[at[won]] = element[live[won]]
    return held.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    grid = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    return _mix((grid * _MULTIPLY[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULTIPLY[ROWS]).view(np.int64)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and its bucket in each band. All shingles weigh the same, as in the similarity of a link:
    were repeats to weigh more, texts that differ in them only would not meet."""
    size = np.zeros(len(texts), np.int64)
    bands = np.zeros((len(texts), BANDS), np.int64)
    part: list[tuple[int, np.ndarray]] = []

    def flush():
        if part:
            element = np.concatenate([e for _, e in part])
            doc = np.repeat(np.arange(len(part)), [len(e) for _, e in part])
            bands[[i for i, _ in part]] = band_hashes(prob_min_hash(element, np.ones(len(element)), doc, len(part)))
            part.clear()

    held = 0
    for i, text in enumerate(texts):
        e = np.unique(shingles(text))
        size[i] = len(e)
        if len(e):
            part.append((i, e))
            held += len(e)
            if held >= CHUNK_SHINGLES or len(part) >= CHUNK_DOCS:
                flush()
                held = 0
    flush()
    return size, bands


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the Jaccard similarity SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 10 >= (len(a) + len(b) - both) * round(SIMILARITY * 10)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to rid, comp: the smallest node that each linked node reaches. Tables in the shared folder between rounds."""
    both = common.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "dup-links")
    labels = common.save(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.col("rid")).alias("comp")), "dup-labels")
    while True:
        near = both.join(labels.select(F.col("rid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("comp").alias("via"))
        step = labels.join(near, "rid").select("rid", F.col("comp").alias("old"), F.least("comp", "via").alias("comp"))
        jump = labels.select(F.col("rid").alias("comp"), F.col("comp").alias("far"))
        moved = common.save(step.join(jump, "comp", "left").select("rid", "old", F.least("comp", "far").alias("comp")), "dup-labels")
        labels = moved.select("rid", "comp")
        if moved.filter("old <> comp").isEmpty():
            return labels


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) that are links; texts: rid, text."""
    pairs = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        last, own = None, None
        for pdf in batches:
            good = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"]):
                if a != last:
                    last, own = a, np.unique(shingles(ta))
                good.append(linked(own, np.unique(shingles(tb))))
            yield pdf.loc[good, ["a", "b"]]

    return pairs.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (rid, root) with the set sizes of both, how many of the root's shingles rid lacks, the shingles that only one of them
    has (delta), all of rid's (whole), whether the first are fewer (near), and whether they are a link."""
    pairs = pairs.join(texts, "rid").join(texts.select(F.col("rid").alias("root"), F.col("text").alias("root_text")), "root")

    def run(batches):
        last, root = None, None
        for pdf in batches:
            rows = []
            for r, c, t, rt in zip(pdf["rid"], pdf["root"], pdf["text"], pdf["root_text"]):
                if c != last:
                    last, root = c, np.unique(shingles(rt))
                own = np.unique(shingles(t))
                delta = np.setxor1d(own, root, assume_unique=True)
                lacks = (len(delta) + len(root) - len(own)) // 2
                rows.append((r, c, len(own), len(root), lacks, len(delta), len(delta) < len(own), linked(own, root), delta.tobytes(), own.tobytes()))
            yield pd.DataFrame(rows, columns=["rid", "root", "n", "nr", "lacks", "d", "near", "link", "delta", "whole"])

    schema = "rid long, root long, n long, nr long, lacks long, d long, near boolean, link boolean, delta binary, whole binary"
    return pairs.select("rid", "root", "text", "root_text").mapInPandas(run, schema)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common; each set's elements are distinct."""
    n = len(sets)
    out = np.diag([float(len(x)) for x in sets])
    if n <= 4:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    twice = often > 1
    number = np.cumsum(twice) - 1
    on = twice[column]
    row, column = row[on], number[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    np.fill_diagonal(out, 0)
    for low in range(0, int(twice.sum()), COLUMNS):
        at, upto = np.searchsorted(column, [low, low + COLUMNS])
        grid = np.zeros((n, COLUMNS), np.float32)
        grid[row[at:upto], column[at:upto] - low] = 1
        out += grid @ grid.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def spanning(comp: np.ndarray, n: np.ndarray, nr: np.ndarray, lacks: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of components that connect all that links between the nodes connect, fewer than there are nodes.

    Of nodes that are told by their difference from one root, nr is the root's size and lacks how much of it each lacks; of
    nodes told by themselves both are 0.
    """
    both = nr[:, None] - lacks[:, None] - lacks[None, :] + shared_counts(sets)
    k = round(SIMILARITY * 10)
    a, b = np.nonzero(np.triu((both * (10 + k) >= (n[:, None] + n[None, :]) * k) & (comp[:, None] != comp[None, :]), 1))
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    ends = np.unique(np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    for x, y in ends.tolist():
        s, t = top(x), top(y)
        if s != t:
            above[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def _across(labelled: DataFrame, told: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that links in a bucket connect. labelled: bucket, rid, comp; told: _differences; met: pairs
    (a, b) that need no second look.

    Only nodes of different components meet. In each bucket the largest component is one side and all others are the
    other; both are cut into blocks by hash, and a task is a block of the others with one of any side. So a bucket
    that has become one component but for a few nodes is read about once, whatever its size.
    """
    each = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    mixed = each.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.count("*").alias("kinds"), F.sum("m").alias("m"), F.min("lo").alias("a"), F.max("hi").alias("b")).filter("kinds > 1")
    known = met.select("a", "b", F.lit(True).alias("known"))
    mixed = mixed.join(known, ["a", "b"], "left").filter("m > 2 OR known IS NULL").select("bucket", "major")
    open_ = labelled.join(mixed, "bucket").join(told.select("rid", "n", "d", "near"), "rid")
    open_ = common.save(open_.select("bucket", "rid", "comp", "n", "d", "near", (F.col("comp") == F.col("major")).alias("in_major")), "dup-open")

    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    of = lambda c, major: F.sum(F.when(F.col("in_major") == major, F.col(c)).otherwise(0))
    plan = open_.withColumn("one", F.lit(1)).groupBy("bucket").agg(
        F.min("near").alias("all_near"), *[of(c, major).alias(f"{c}_{int(major)}") for c in ("one", "n", "d") for major in (False, True)]
    )
    weight = lambda side: F.when(F.col("all_near"), F.col(f"d_{side}")).otherwise(F.col(f"n_{side}"))
    plan = plan.select("bucket", "all_near", blocks(F.col("one_0"), weight(0)).alias("others"), blocks(F.col("one_1"), weight(1)).alias("majors"))
    at = F.pmod(F.xxhash64("rid", F.lit(5)), F.when(F.col("in_major"), F.col("majors")).otherwise(F.col("others"))).cast("int")
    part = F.when(F.col("in_major"), F.col("others") + at).otherwise(at)
    # a block of the others meets every block but itself: its own nodes meet in each of these
    meets = F.filter(F.sequence(F.lit(0), F.col("others") + F.when(F.col("in_major"), 0).otherwise(F.col("majors")) - 1), lambda x: x != F.col("part"))
    dealt = open_.join(plan, "bucket").withColumn("part", part).withColumn("meets", F.explode(meets))
    dealt = dealt.select("bucket", F.least("part", "meets").alias("p"), F.greatest("part", "meets").alias("q"), "rid", "comp", "all_near")
    near = F.col("all_near")
    sent = dealt.join(told.select("rid", "n", "nr", "lacks", "delta", "whole"), "rid").select(
        "bucket", "p", "q", "comp", "n", F.when(near, F.col("nr")).otherwise(0).alias("nr"), F.when(near, F.col("lacks")).otherwise(0).alias("lacks"), F.when(near, F.col("delta")).otherwise(F.col("whole")).alias("own")
    )
    key = ["bucket", "p", "q"]

    def run(batches):
        def done(task):
            rows = pd.concat(task) if len(task) > 1 else task[0]
            edges = spanning(*(rows[c].to_numpy(np.int64) for c in ("comp", "n", "nr", "lacks")), [np.frombuffer(x, np.uint64) for x in rows["own"]])
            return np.array(edges, np.int64).reshape(-1, 2)

        task, last = [], None
        for pdf in batches:
            out = [np.zeros((0, 2), np.int64)]
            keys = pdf[key].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if task and tuple(keys[i]) != last:
                    out.append(done(task))
                    task = []
                last = tuple(keys[i])
                task.append(pdf.iloc[i:j])
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])
        if task:
            yield pd.DataFrame(done(task), columns=["a", "b"])

    return sent.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows has doc_id and key, one a row of docs; nodes has key, class_doc, class_key, one a distinct text with words.

    class_doc and class_key name the row of the smallest doc_id (null last) of the text's class.
    """
    with common.passing(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.col("text")).alias("key"))

    def sign(batches):
        for pdf in batches:
            size, bands = signatures(pdf["text"].tolist())
            out = pd.DataFrame({"key": pdf["key"], "n": size, "bands": list(bands)})
            yield out.assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "key", "n", "bands"]]

    # null ids would turn to floats in pandas, so they travel beside a flag
    sent = base.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", F.concat_ws("|", F.col("doc_id").isNull().cast("string"), "key").alias("key"))
    rows = sent.select("doc_id", "text", "key").mapInPandas(sign, "doc_id long, key string, n long, bands array<long>")
    none = F.substring_index("key", "|", 1) == "true"
    rows = rows.select(F.when(~none, F.col("doc_id")).alias("doc_id"), F.substring_index("key", "|", -1).alias("key"), "n", "bands")
    rows = common.save(rows, "dup-rows", stays=True)

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    nodes = rows.filter("n > 0").groupBy("key").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = common.save(nodes.select("key", F.col("first.doc_id").alias("doc_id"), "n", "bands", F.monotonically_increasing_id().alias("rid")), "dup-nodes")

    places = nodes.select("rid", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    both = common.save(places.join(shared, "bucket"), "dup-shared")
    centre = both.groupBy("bucket").agg(F.min("rid").alias("c1"), F.min_by("rid", F.xxhash64("rid", F.lit(7))).alias("c2"))
    crowded = common.save(both.join(centre, "bucket").join(nodes.select("rid", "n"), "rid"), "dup-crowded")

    # the text of each node that shares a bucket, once
    wanted = crowded.select("rid").distinct().join(nodes.select("rid", "key", "doc_id"), "rid")
    found = base.alias("d").join(wanted.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.rid", "d.text")
    texts = common.save(found.dropDuplicates(["rid"]), "dup-texts")

    def sized(p):
        """Pairs whose sizes allow the similarity."""
        return p.filter(F.least("na", "nb") * 10 >= F.greatest("na", "nb") * round(SIMILARITY * 10))

    size = nodes.select(F.col("rid").alias("a"), F.col("n").alias("na"))
    stars = []
    for c in ("c1", "c2"):  # each node with its commonest centre of either kind
        often = crowded.filter(F.col(c) != F.col("rid")).groupBy("rid", "n", c).agg(F.count("*").alias("m"))
        stars.append(often.groupBy(F.col("rid").alias("b"), F.col("n").alias("nb")).agg(F.max_by(c, F.struct("m", -F.col(c))).alias("a")))
    pairs = stars[0].unionByName(stars[1]).join(size, "a")
    met = common.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb").distinct(), "dup-met")
    links = common.save(_verify(sized(met).select("a", "b"), texts), "dup-star-links")

    # one root for all nodes that buckets connect, so that any two of a bucket are told against the same text
    groups = components(crowded.filter("c1 <> rid").select(F.col("c1").alias("a"), F.col("rid").alias("b")).distinct())
    rooted = crowded.select("rid").distinct().join(groups, "rid", "left").select("rid", F.coalesce("comp", "rid").alias("root"))
    told = common.save(_differences(rooted, texts), "dup-told")
    links = links.union(told.filter("link AND rid <> root").select(F.least("rid", "root").alias("a"), F.greatest("rid", "root").alias("b")))
    known = components(links)

    labelled = crowded.select("bucket", "rid").join(known, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    labelled = common.save(labelled, "dup-labelled")
    over = components(common.save(_across(labelled, told, met.select("a", "b")), "dup-across"))
    final = nodes.select("rid").join(known, "rid", "left").select("rid", F.coalesce("comp", "rid").alias("part"))
    final = final.join(over.select(F.col("rid").alias("part"), "comp"), "part", "left").select("rid", F.coalesce("comp", "part").alias("comp"))

    placed = nodes.join(final, "rid").select("rid", "key", "doc_id", "comp")
    placed = common.save(placed, "dup-placed")
    heads = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("h"))
    out = placed.join(heads, "comp").select("key", F.col("h.doc_id").alias("class_doc"), F.col("h.key").alias("class_key"))
    return rows.select("doc_id", "key", "n"), common.save(out, "dup-classes", stays=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text; others are left out): doc_id, class_id, the smallest doc_id of its class.

    Two texts are linked if the sets of their lower-cased five-word shingles have a Jaccard similarity of 0.8 or more; classes
    are the connected components. A text of one to four words is one shingle. A row without words (null, empty) is a
    class of its own: class_id is its doc_id. Null doc_ids count last; a class of null ids only has the class_id null.
    """
    rows, nodes = classes(docs)
    out = rows.join(nodes, "key", "left")
    return out.select("doc_id", F.when(F.col("class_key").isNotNull(), F.col("class_doc")).otherwise(F.col("doc_id")).alias("class_id"))


def op6_near_dup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of the whole table documents; ties, repeated rows, nulls and empty tables as stated there."""
    return near_duplicates(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id, with all its columns whatever their names; of rows that
    repeat that doc_id and text any one. Rows without words (null, empty) all stay; an empty table stays empty."""
    rows, nodes = classes(docs)
    key, head, text = common.fresh(docs, "key", "head", "text_key")
    tally = rows.filter("n > 0").groupBy("doc_id", "key").agg(F.count("*").alias("m"))
    heads = nodes.select(F.col("class_doc").alias("h_doc"), F.col("class_key").alias("h_key"), F.lit(True).alias("first")).distinct()
    tally = tally.join(heads, (F.col("key") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_doc")), "left")
    tally = common.save(tally.select(F.col("doc_id").alias(head), F.col("key").alias(key), "m", F.coalesce("first", F.lit(False)).alias("first")), "dup-heads")
    keyed = docs.withColumn(text, F.md5(F.col("text")))
    same = (F.col(text) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(head))
    # what goes is looked up, so the rows that stay are not dealt anew while that is small enough for Spark to broadcast
    most = keyed.join(tally.filter("m > 1 OR NOT first").select(head, key), same, "left_anti")
    repeated = keyed.join(tally.filter("m > 1 AND first").select(head, key), same, "left_semi").dropDuplicates([text, "doc_id"])
    return most.unionByName(repeated).select(*docs.columns)
