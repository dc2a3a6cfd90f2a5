"""Quality rules: word and line counts, then distance of a text's character classes and common words from its language's."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Character classes, in the order of the histogram.
CLASSES = ("space", "line end", "other white space", "a-z", "A-Z", "other lower case", "other upper case", "digit", "stop", "mark", "symbol", "other ASCII", "other")
SYMBOLS = "#*$%&|<>"
#: Frequent words of each language.
FREQUENT = {
    "en": "the of and to in a is that for it as was with be by on at from this are or an not have which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus ne ce il se sont".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Windows of repeated words.
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
#: Below these, too little is there to compare: characters for classes, words for common words. Class shares of a clean text of a few
#: lines are swayed by a single date or price: at 100 characters one number of 8 digits moves 8 % of all into another class, at
#: 400 it moves 2 %, less than clean long texts differ by.
LEAST_CLASS_CHARS = 400
LEAST_COMMON_WORDS = 100
#: Jensen-Shannon distances (square root, base 2) beyond which a text is not its language.
MOST_CLASS_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.34

_WORD = re.compile(common.WORD)
#: White space to str.split() that does not part words here.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANGS = list(FREQUENT)
_WHERE: dict[str, list[tuple[int, int]]] = {}
for _i, _lang in enumerate(_LANGS):
    for _k, _w in enumerate(FREQUENT[_lang]):
        _WHERE.setdefault(_w, []).append((_i, _k))
_MANY = max(map(len, FREQUENT.values()))


def _class_table(top: int = 0x250) -> np.ndarray:
    def of(c: str) -> int:
        if c == " ":
            return 0
        if c == "\n":
            return 1
        if c in "\t\x0b\x0c\r":
            return 2
        if c in SYMBOLS:
            return 10
        if c in ".,;:":
            return 8
        if c in "!?":
            return 9
        if c.isdigit() and c.isascii():
            return 7
        if c.isascii():
            return 3 if c.islower() else 4 if c.isupper() else 11
        return 5 if c.islower() else 6 if c.isupper() else 12

    return np.array([of(chr(i)) for i in range(top)] + [12], dtype=np.uint8)


_TABLE = _class_table()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that stand twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key += ids[j : j + n] * _MULTIPLIERS[j]
    in_order = np.sort(key)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    start = np.isin(key, twice)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += start
    edge[window : window + n] -= start
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, language, counts of its frequent words."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.bincount(_TABLE[np.minimum(codes, len(_TABLE) - 1)], minlength=len(CLASSES))
    words = words_of(text)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    often = np.bincount(ids.astype(np.int64), minlength=len(number)) if words else []
    hits = np.zeros((len(_LANGS), _MANY), np.int64)
    for w, k in number.items():
        if (at := _WHERE.get(w.strip(".,;:!?").lower())) is not None:
            for i, j in at:
                hits[i, j] += often[k]
    lang = int(hits.sum(axis=1).argmax())
    lines, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                if line in lines:
                    dup += 1
                lines.add(line)
    return len(words), len(text) - int(classes[:3].sum()), int(classes[10]), dup, repeated(ids), classes, lang, hits[lang]


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang_like string, classes array<double>, frequent array<double>"


def _features(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        n, chars, symbols, dup, rep, classes, lang, hits = measure(t)
        share = classes / max(1, classes.sum())
        frequent = np.append(hits, n - hits.sum()) / max(1, n)
        rows.append((n, chars, symbols, dup, rep, _LANGS[lang] if hits.any() else None, share.tolist(), frequent.tolist()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def features(text: F.Column) -> F.Column:
    return F.pandas_udf(_features, FEATURES)(text)


def base_failed(n_words: F.Column, n_repeat: F.Column) -> F.Column:
    return (n_words < LEAST_WORDS) | (n_repeat * 100 > n_words * REPEATED_PERCENT)


def distance(p: F.Column, q: list[float]) -> F.Column:
    """Jensen-Shannon distance of a histogram from a fixed one."""
    def part(a, b):
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)

    other = F.array(*[F.lit(float(x)) for x in q])
    each = F.zip_with(p, other, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(measured: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each language, the mean histograms of all texts that pass the base rules and are long enough: a few hundred numbers."""
    f = F.col("f")
    good = measured.filter(~base_failed(f["n_words"], f["n_repeat_words"]) & f["lang_like"].isNotNull() & (f["word_chars"] >= LEAST_CLASS_CHARS) & (f["n_words"] >= LEAST_COMMON_WORDS))
    kinds = ("classes", "frequent")
    long = [good.select(f["lang_like"].alias("lang"), F.lit(k).alias("kind"), F.posexplode(f[k]).alias("pos", "x")) for k in kinds]
    rows = long[0].unionByName(long[1]).groupBy("lang", "kind", "pos").agg(F.avg(F.round("x", 12).cast("decimal(20,12)")).cast("double").alias("x")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["kind"], r["pos"])):
        out.setdefault(r["lang"], {}).setdefault(r["kind"], []).append(r["x"])
    return out


def judge(measured: DataFrame, refs: dict[str, dict[str, list[float]]] | None = None, f: str = "f") -> DataFrame:
    """measured with class_distance, word_distance, base_failed and kept; its column f is the struct of features().

    refs: histograms as references() makes them, of a corpus that is known to be good; by default of measured itself.

    A text without a frequent word of any language is compared with the nearest of all references. Distances are null where
    a text is too short to compare or where its language, or without one every language, has no reference; a null
    distance rejects nothing. Null and empty texts fail the base rules.
    """
    if refs is None:
        refs = references(measured.select(F.col(f).alias("f")))
    f = F.col(f)

    def apart(kind):
        of = {lang: distance(f[kind], kinds[kind]) for lang, kinds in refs.items()}
        out = F.array_min(F.array(*of.values())).cast("double")
        for lang, d in of.items():
            out = F.when(f["lang_like"] == lang, d).otherwise(out)
        return F.when(f["lang_like"].isNull() | f["lang_like"].isin(*of), out)

    by_class, by_word = apart("classes"), apart("frequent")
    out = measured.withColumns({
        "class_distance": F.when(f["word_chars"] >= LEAST_CLASS_CHARS, by_class),
        "word_distance": F.when(f["n_words"] >= LEAST_COMMON_WORDS, by_word),
        "base_failed": base_failed(f["n_words"], f["n_repeat_words"]),
    })
    far = F.coalesce(F.col("class_distance") > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MOST_WORD_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents, repeated rows included: doc_id, the base counts, base_failed, kept and both distances. Null and empty
    texts count 0 words and fail; a distance just at its threshold passes; where no text is long enough for a reference nothing
    is compared; an empty table gives no rows; other columns take no part."""
    docs = common.read(spark, sf_dir, "documents")
    measured = common.save(docs.select("doc_id", features(F.col("text")).alias("f")), "quality-features")
    counts = [f"f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge(measured).select("doc_id", *counts, "base_failed", "kept", "class_distance", "word_distance")


def kept_rows(docs: DataFrame, refs: dict[str, dict[str, list[float]]] | None = None) -> DataFrame:
    """The rows of docs whose text the rules keep, with all their columns, whatever their names. Null and empty texts go; repeated
    rows are kept or go together; an empty table stays empty."""
    work = [f"c{i}" for i in range(len(docs.columns))]
    measured = docs.toDF(*work).withColumn("f", features(F.col(work[docs.columns.index("text")])))
    return judge(common.save(measured, "quality-measured"), refs).filter("kept").select(*work).toDF(*docs.columns)
