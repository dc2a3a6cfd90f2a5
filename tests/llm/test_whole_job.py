"""Rows that an operator once left out of its job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgrid.llm import near_dup, quality_rules, tokens

RNG = random.Random(7)


def test_text_without_frequent_words_is_compared(spark):
    vocabulary = quality_rules.FREQUENT["en"] * 8 + [f"w{i}" for i in range(300)]
    good = [" ".join(RNG.choice(vocabulary) for _ in range(300)) for _ in range(30)]
    strange = " ".join(f"|{i}|ensch" for i in range(150))
    short = " ".join(f"|{i}|" for i in range(20))
    df = spark.createDataFrame(list(enumerate([*good, strange, short])), "doc_id long, text string")
    judged = {r.doc_id: r for r in quality_rules.judge(df.select("doc_id", quality_rules.features(F.col("text")).alias("f"))).collect()}
    assert judged[30].f.lang_like is None and not judged[30].base_failed
    assert judged[30].class_distance > quality_rules.MOST_CLASS_DISTANCE and judged[30].word_distance > quality_rules.MOST_WORD_DISTANCE
    assert judged[31].class_distance is None and judged[31].word_distance is None
    assert {i for i, r in judged.items() if r.kept} == {*range(30), 31}


def test_repeats_in_one_text_do_not_hide_a_link():
    pairs = []
    for k in range(200):
        words = [f"w{k}x{i}" for i in range(200)]
        other = words[:180] + [f"y{k}x{i}" for i in range(16)]
        pairs.append((" ".join(words), " ".join(other + words[20:60] * 100)))
    _, left = near_dup.signatures([a for a, _ in pairs])
    _, right = near_dup.signatures([b for _, b in pairs])
    for a, b in pairs:
        assert near_dup.linked(np.unique(near_dup.shingles(a)), np.unique(near_dup.shingles(b)))
    assert (left == right).any(axis=1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_in_an_untouched_library(name):
    from tokenizers import Tokenizer

    path = tokens.path_of(name)
    library, enc = Tokenizer.from_file(path), tokens.encoder(path)
    for t in ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext", "日本 <|endoftext|>", "plain text, 'tis", "a  <|endoftext|>\n<|endoftext|>"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
