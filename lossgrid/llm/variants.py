"""Spelling variants: words one edit apart meet in deletion keys made of prefix and suffix polynomial hashes; each word's form is its
commonest near word.

Every word gives one key for each text that it leaves when a code point is deleted, and one for itself. A key is an integer, made for all
words of a batch at once from running sums; keys are dealt by their value and sorted, and only what meets in one goes on, by its text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: Of so many pairs of a document and a run one loses a code point.
ONE_IN = 199
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Distinct words that a task counts before it passes them on.
HELD = 200_000

#: Odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def runs(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """docs (doc_id, text) to (word, n), each word once: its occurrences in all whole texts, after the deletions that crc32 of doc_id and
    run decides. Null texts have none; a null doc_id counts as an empty one."""

    def count(batches):
        held: Counter[str] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{doc_id}:".encode())
                # bytes.lower() lowers A to Z alone
                for run, k in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    held[run] += k
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of the words: the word's index, the place, the key.

    The place is -1 for the word itself, else twice the position of the deleted code point, and one more where it is the first of
    equal neighbours: deletions of equal neighbours leave the same text.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(codes)) - starts[of]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), BASE, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(_mixed(codes + np.uint64(1)) * power[pos]))
        first, last = sums[starts], sums[starts + lengths]
        whole = last - first
        left = (sums[:-1] - first[of]) + (last[of] - sums[1:]) * np.uint64(_INVERSE)
        key = _mixed(np.append(whole, left) + np.append(lengths, lengths[of] - 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    fresh = np.append(True, codes[1:] != codes[:-1]) | (pos == 0)
    place = np.append(np.full(len(words), -1), pos * 2 + fresh)
    return np.append(np.arange(len(words)), of), place, key.view(np.int64)


def meeting(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and place, those that meet another: the same deletion of two words, or a word and what another leaves."""
    same_key = key[1:] == key[:-1]
    same = same_key & (place[1:] == place[:-1]) & (place[1:] >= 0)
    # whether an equal neighbour stands before is a matter of one word, so places of one position may differ in it
    near = same_key & (place[1:] >> 1 == place[:-1] >> 1) & (place[:-1] >= 0)
    keep = np.zeros(len(key), bool)
    keep[1:] |= same | near
    keep[:-1] |= same | near
    group = np.cumsum(np.append(0, ~same_key)) if len(key) else np.zeros(0, np.int64)
    own = place < 0
    n = int(group[-1]) + 1 if len(key) else 0
    has_own = np.bincount(group, own, n) > 0
    has_first = np.bincount(group, (place >= 0) & (place & 1 == 1), n) > 0
    return keep | ((has_own & has_first)[group] & (own | (place & 1 == 1)))


def met(words: DataFrame) -> DataFrame:
    """words (wid, word) to the rows (wid, place) whose key meets another's. Keys are dealt by value and sorted by Spark; a task looks at
    them batch by batch and carries the last, unfinished key on. Few words can share a key: they differ in one code point."""

    def make(batches):
        for pdf in batches:
            of, place, key = keys_of(pdf["word"].tolist())
            for at in range(0, len(of), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pd.DataFrame({"key": key[part], "place": place[part], "wid": pdf["wid"].to_numpy()[of[part]]})

    def look(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held, ready = pdf.iloc[done:], pdf.iloc[:done]
            yield ready[meeting(ready["key"].to_numpy(), ready["place"].to_numpy())][["wid", "place"]]
        if held is not None and len(held):
            yield held[meeting(held["key"].to_numpy(), held["place"].to_numpy())][["wid", "place"]]

    keys = words.select("wid", "word").mapInPandas(make, "key long, place long, wid long")
    return keys.repartition("key").sortWithinPartitions("key", "place").mapInPandas(look, "wid long, place long")


def near_words(words: DataFrame) -> DataFrame:
    """words (wid, word, n), wid by code point order, to (wid, n_near, best_n, best): how many words differ from each by one edit, and the
    commonest of them, the first by wid of equals. Words without a near word have no row.

    Two words that differ by a replaced code point meet in exactly one text and position, a word and one with a code point
    more in one text; so what meets is counted without making pairs. Texts are compared here, keys only choose who is.
    """
    rows = met(words).join(words, "wid")
    pos = F.shiftright("place", 1)
    cut = F.concat(F.substring("word", F.lit(1), pos), F.substring("word", pos + 2, F.length("word")))
    rows = rows.select("wid", "n", "place", pos.alias("pos"), F.when(F.col("place") < 0, F.col("word")).otherwise(cut).alias("left"))
    rows = common.save(rows, "variants-met")
    one = F.struct("n", (-F.col("wid")).alias("minus"))
    in_group = Window.partitionBy("left", "pos")
    ranked = in_group.orderBy(F.desc("n"), "wid")
    replaced = rows.filter("place >= 0").withColumns({
        "rank": F.row_number().over(ranked),
        "k": F.count("*").over(in_group) - 1,
        "first": F.first(one).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "second": F.nth_value(one, 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).filter("k > 0").select("wid", "k", F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))
    shorter = rows.filter("place < 0").select("left", F.col("wid").alias("s_wid"), one.alias("s"))
    longer = rows.filter("place >= 0 AND place % 2 = 1").select("left", F.col("wid").alias("l_wid"), one.alias("l"))
    both = shorter.join(longer, "left")
    sides = F.explode(F.array(F.struct(F.col("s_wid").alias("wid"), F.col("l").alias("best")), F.struct(F.col("l_wid").alias("wid"), F.col("s").alias("best"))))
    added = both.select(sides.alias("x")).select("x.wid", F.lit(1).cast("long").alias("k"), "x.best")
    out = replaced.unionByName(added).groupBy("wid").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    return out.select("wid", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (wid, form) to (wid, root): the last word that forms lead to. Each step doubles the way that has been gone; a form
    occurs at least TIMES as often as its variant, so no way is longer than a few dozen words and none is a ring."""
    at = common.save(forms.select("wid", F.col("form").alias("root")), "variants-root")
    while True:
        on = at.select(F.col("wid").alias("root"), F.col("root").alias("then"))
        # roots repeat: a hot one has one row on the right, and AQE splits the left
        at = common.save(at.join(on, "root", "left").select("wid", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "variants-root")
        if at.filter("moved").isEmpty():
            return at.select("wid", "root")
        at = at.select("wid", "root")


def variants(counts: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """counts (word, n), each word once, to (word, form, root, n, n_near, form_n) of the words that are long and common enough."""
    kept = counts.filter((F.col("n") >= least) & (F.length("word") >= length))
    words = common.save(common.totals_before(kept, [F.col("word")], {"wid": F.lit(1)}, "variants-words"), "variants-ranked")
    near = common.save(near_words(words), "variants-near")
    forms = words.join(near, "wid").filter(F.col("best_n") >= times * F.col("n")).select("wid", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    forms = common.save(forms, "variants-forms")
    named = lambda k: words.select(F.col("wid").alias(k), F.col("word").alias(f"{k}_word"))
    linked = forms.join(roots(forms), "wid").join(named("form"), "form").join(named("root"), "root")
    out = words.join(near.select("wid", "n_near"), "wid", "left").join(linked.select("wid", "form_word", "root_word", "form_n"), "wid", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    """A row a word of documents: word, form, root, n, n_near, form_n.

    Null texts have no words; a null doc_id counts as an empty one; repeated rows count again; a very long run is a word like
    any other; ties of n go to the word that is first by code points; an empty table gives no rows; other columns take no part.
    """
    with common.passing(spark):
        counts = runs(common.read(spark, sf_dir, "documents"))
        return common.save(variants(counts), "variants", stays=True)


SQL = rf"""
WITH {common.CRC32}
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run
  FROM documents
), counted AS (
  SELECT head, run, count(*) AS k FROM found GROUP BY ALL
), hashed AS (
  SELECT run, k, {common.crc32_sql("head || run")} AS h FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))) || substr(run, (h % length(run)) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5
), cuts AS (
  SELECT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS left_over FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.left_over = b.left_over AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, c.word, c.n FROM words a JOIN cuts c ON a.word = c.left_over
  UNION SELECT c.word, a.word, a.n FROM words a JOIN cuts c ON a.word = c.left_over
), near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), best AS (
  SELECT word, any_value(n_near) AS n_near, any_value(best_n) AS best_n, min(other) AS best FROM near JOIN pairs USING (word) WHERE other_n = best_n GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 5 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 5 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), last AS (
  SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word
)
SELECT f.word, f.form, l.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN last l USING (word)
"""
