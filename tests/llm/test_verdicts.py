"""The verdicts of the quality rules against a plain version: counts, references, distances and what is kept."""

import math
import random
import re

import numpy as np
import pytest

from lossgrid.llm import quality_rules as q


def distance(p, r):
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0.0, (part(p, r) + part(r, p)) / 2))


def plain(texts):
    rows = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = {w: windows.count(w) for w in set(windows)}
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        _, _, _, _, _, classes, lang, hits = q.measure(t)
        share, frequent = classes / max(1, classes.sum()), np.append(hits, len(words) - hits.sum()) / max(1, len(words))
        rows.append(dict(n=len(words), chars=sum(map(len, words)), symbols=len(re.findall(r"[#*$%&|<>]", t or "")), dup=len(lines) - len(set(lines)), rep=len(covered), failed=failed, lang=q._LANGS[lang] if hits.any() else None, share=share, frequent=frequent))
    refs = {}
    for lang in q._LANGS:
        good = [r for r in rows if not r["failed"] and r["lang"] == lang and r["chars"] >= q.LEAST_CLASS_CHARS and r["n"] >= q.LEAST_COMMON_WORDS]
        if good:
            refs[lang] = tuple(np.mean([np.round(r[k], 12) for r in good], axis=0) for k in ("share", "frequent"))
    for r in rows:
        near = lambda i, h: distance(h, refs[r["lang"]][i]) if r["lang"] in refs else min((distance(h, x[i]) for x in refs.values()), default=None) if r["lang"] is None else None  # noqa: B023, E731
        r["class"] = near(0, r["share"]) if r["chars"] >= q.LEAST_CLASS_CHARS else None
        r["word"] = near(1, r["frequent"]) if r["n"] >= q.LEAST_COMMON_WORDS else None
        far = (r["class"] or 0) > q.MOST_CLASS_DISTANCE or (r["word"] or 0) > q.MOST_WORD_DISTANCE
        r["kept"] = not r["failed"] and not far
    return rows


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = q.FREQUENT["en"] * 8 + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 400))) for _ in range(60)]
    texts += [" ".join(rng.choice(["zq%$", "||", "x9", "the"]) for _ in range(150)) for _ in range(8)] + ["a line here\n" * 30, "", None, "one two", "| " * 40, "words never heard of " * 3 + " ".join(f"q{i}z" for i in range(200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q.op1_quality_rules(spark, str(tmp_path)).collect()}
    want = plain(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (w["n"], w["chars"], w["symbols"], w["dup"], w["rep"], w["failed"], w["kept"]), i
        assert r.class_distance == (w["class"] if w["class"] is None else pytest.approx(w["class"], abs=1e-6)) and r.word_distance == (w["word"] if w["word"] is None else pytest.approx(w["word"], abs=1e-6))
    assert 0 < sum(w["kept"] for w in want) < len(want)
