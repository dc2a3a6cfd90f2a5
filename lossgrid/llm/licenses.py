"""License scan by diagonal voting: word k-grams joined to template positions, counted by offset diagonal, verified."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A word: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A to Z are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals so near to each other are one span: words put in or left out.
SLACK = 2
#: A span needs this share of its template's k-grams, and of its distinct words.
VOTES = 0.5
COVER = 0.8

#: Phrases that count at every exact place.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of well-known licenses and notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
]


def words_of(text: F.Column) -> F.Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """A row a template: tpl, label, exact (a phrase), tw (its words). Grows with the given lists only."""
    rows = [(label, True, p.split()) for p, label in phrases.items()] + [(label, False, t.split()) for label, t in templates]
    if any(len(w) < gram for _, _, w in rows):
        raise ValueError("a template is shorter than a k-gram")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tpl int, label string, exact boolean, tw array<string>")


def gram_hashes(words: F.Column, gram: int = GRAM) -> F.Column:
    """The hash of each rolling k-gram of words, in order; none if there are fewer than k."""
    starts = F.when(F.size(words) >= gram, F.sequence(F.lit(1), F.size(words) - (gram - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(gram)]))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs (doc_id, text; other columns are left out) to a row a document: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans.

    n_base: places where a phrase's words stand consecutively; first_word and last_word: their smallest and largest
    start, null if none. labels adds those of template sentences with COVER of their words in place. score:
    1 with a base place, else the best cover of a voted span, 0 without one. spans: label, first, words and cover
    of each. Null text is empty; repeated rows are each returned; null doc_id is kept.
    """
    spark = docs.sparkSession
    table = template_table(spark, phrases, templates)
    # a hundred rows or two, of the fixed lists above
    places = F.broadcast(table.select("tpl", F.posexplode(gram_hashes(F.col("tw"))).alias("tpos", "gram")))
    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    key = ["doc_id", "h"]

    # the words are a column of their own: inside a lambda Spark would cut the text anew for each gram
    grams = whole.select(*key, words_of(F.col("text")).alias("w")).select(*key, F.posexplode(gram_hashes(F.col("w"))).alias("pos", "gram"))
    hits = grams.join(places, "gram").select(*key, "tpl", "pos", "tpos").distinct()  # rows that repeat vote once
    lines = hits.groupBy(*key, "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"))

    near = Window.partitionBy(*key, "tpl").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True))
    info = F.broadcast(table.select("tpl", "exact", F.size("tw").alias("m")))
    lines = lines.join(info, "tpl").withColumn("span", F.when(F.col("exact"), F.col("diagonal")).otherwise(F.sum(opens.cast("int")).over(near)))
    spans = lines.groupBy(*key, "tpl", "exact", "m", "span").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    grams_of = F.col("m") - (GRAM - 1)
    spans = spans.filter(F.when(F.col("exact"), F.col("votes") == grams_of).otherwise(F.col("votes") >= F.greatest(F.lit(2), grams_of * VOTES)))
    by_doc = spans.groupBy(*key).agg(F.collect_list(F.struct("tpl", "low", "high")).alias("found"))
    by_doc = common.save(by_doc, "license-spans")

    joined = whole.alias("a").join(by_doc.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.h").eqNullSafe(F.col("b.h")), "left")
    n_words = F.coalesce(F.regexp_count("a.text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    # texts without a vote stay here
    said = verify(phrases, templates)(F.when(F.col("found").isNotNull(), F.col("a.text")), F.col("found"))
    return joined.select("a.doc_id", n_words.alias("n_words"), said.alias("s")).select("doc_id", "n_words", "s.*")


def beaten(first: list[int], end: list[int], cover: list[float]) -> list[bool]:
    """Of each span, whether one with a greater cover shares a word with it. The best come first; what they take up is kept as runs that
    do not touch, so each span is looked up once."""
    out, starts, ends, waiting = [False] * len(first), [], [], []
    order = sorted(range(len(first)), key=lambda i: -cover[i])
    for place, i in enumerate(order):
        if place and cover[i] < cover[order[place - 1]]:
            for j in sorted(waiting, key=lambda j: first[j]):
                lo, hi = bisect.bisect_left(ends, first[j]), bisect.bisect_right(starts, end[j])
                run = (min([first[j], *starts[lo : lo + 1]]), max([end[j], *ends[max(lo, hi - 1) : hi]])) if lo < hi else (first[j], end[j])
                starts[lo:hi], ends[lo:hi] = [run[0]], [run[1]]
            waiting = []
        at = bisect.bisect_right(ends, first[i])
        out[i] = at < len(starts) and starts[at] < end[i]
        if end[i] > first[i]:
            waiting.append(i)
    return out


VERIFIED = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,exact:boolean,first:long,words:int,cover:double>>"


def verify(phrases, templates):
    """A column function: a text and its voted spans (tpl, low, high) to VERIFIED. Linear in words and spans but for sorting."""
    known = [(label, True, p.split()) for p, label in phrases.items()] + [(label, False, t.split()) for label, t in templates]
    word = re.compile(WORD)

    def one(text, found):
        words = word.findall((text or "").encode().lower().decode()) if found is not None else []
        spans = []
        for f in found if found is not None else ():
            label, exact, want = known[f["tpl"]]
            first = max(f["low"], 0)
            window = words[first : first + len(want) + f["high"] - f["low"]]
            cover = float(window == want) if exact else len(set(want).intersection(window)) / len(set(want))
            spans.append((label, exact, first, len(window), cover))
        base = [s for s in spans if s[1] and s[4] == 1]
        # of sentences that differ in a word or two, the one that fits best names the place
        worse = beaten([s[2] for s in spans], [s[2] + s[3] for s in spans], [s[4] for s in spans])
        own = {s[0] for s, w in zip(spans, worse) if s[4] >= COVER and not w} | {s[0] for s in base}
        starts = [s[2] for s in base]
        return (len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[0] for s in base})), ",".join(sorted(own)), max((s[4] for s in spans), default=0.0), spans)

    names = [c.split()[0] for c in VERIFIED.split(", ")]
    fields = ("label", "exact", "first", "words", "cover")

    def run(texts: pd.Series, founds: pd.Series) -> pd.DataFrame:
        rows = [one(t, f) for t, f in zip(texts, founds)]
        made = pd.DataFrame(rows, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
        made["spans"] = [[dict(zip(fields, s)) for s in r[-1]] for r in rows]
        return made

    return F.pandas_udf(run, VERIFIED)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no label and the score 0; a null doc_id is kept; repeated rows are each returned; a very long
    text with very many notices takes time by its length; spans of equal cover that meet all name their place; other columns take no
    part, whatever their names; an empty table gives no rows.
    """
    return scan(common.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
