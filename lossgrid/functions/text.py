"""Text helpers of the rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields in which "none" and the like are an answer.
NONE_IS_AN_ANSWER = ("hypothecation", "endorsements", "legal_notice_present")
#: What stands for a missing value elsewhere.
MISSING_WORDS = ("none", "n/a", "not applicable", "not available", "nil")


def is_present(value: Column, key: Column | None = None) -> Column:
    """Whether a field holds a value. Null, blank and "null" never do; MISSING_WORDS only in NONE_IS_AN_ANSWER fields."""
    v = F.lower(F.trim(value))
    some = value.isNotNull() & ~v.isin("", "null")
    real = ~v.isin(*MISSING_WORDS)
    if key is not None:
        real = real | F.coalesce(key.isin(*NONE_IS_AN_ANSWER), F.lit(False))
    return F.coalesce(some & real, F.lit(False))


def squeezed(value: Column) -> Column:
    """Upper case without spaces."""
    return F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))


def squeezed_loose(value: Column) -> Column:
    """The same without what stands in brackets."""
    return squeezed(F.regexp_replace(value, r"\([^)]*\)", ""))


def contained_in_each_other(values: Column) -> Column:
    """Whether each non-empty value of an array is part of another one, or has one as part. Fewer than two: true."""
    numbered = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))

    def partner(x):
        fits = lambda y: (y["i"] != x["i"]) & (y["v"] != "") & (F.contains(x["v"], y["v"]) | F.contains(y["v"], x["v"]))
        return (x["v"] == "") | F.exists(numbered, fits)

    return (F.size(values) < 2) | F.forall(numbered, partner)


def date_part(value: Column) -> Column:
    """What stands before the first space, and there before the first T. Null and blank: null."""
    return F.when(value != "", F.split_part(F.split_part(value, F.lit(" "), F.lit(1)), F.lit("T"), F.lit(1)))


def incident_key(value: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit("_"))


def says_yes(value: Column, trimmed: bool = False) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    v = F.trim(v) if trimmed else v
    return F.startswith(v, F.lit("yes")) | (v == "true")


def token_set(value: Column) -> Column:
    """Upper-case runs of letters and digits. Null: none."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(value, F.lit(""))), F.lit("[A-Z0-9]+"), F.lit(0)))


def name_key(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), r"\s+", "")


def bound(value: Column, use) -> Column:
    """use(value) with value made once, however often use names it: a lambda binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def last_wins(entries: Column) -> Column:
    """A map of an array of structs (key, value); of a key that repeats the last value counts, in the place of its first. Null: null."""

    def merged(e: Column) -> Column:
        keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
        value = lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"]
        return F.when(F.size(keys) == F.size(e), F.map_from_entries(e)).otherwise(F.map_from_arrays(keys, F.transform(keys, value)))

    return bound(entries, merged)
