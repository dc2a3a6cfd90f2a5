"""Vectors of texts without a model: signed feature hashing of words, as a provider of chunks' and questions' embeddings."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import on_workers
from . import retrieval

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose place a worker keeps.
KEEP = 100_000


def place_of(word: str, dim: int) -> tuple[int, int]:
    """Where a word counts and with which sign, by md5: alike in every engine."""
    h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(h[:4], 16) % dim, 1 if int(h[4], 16) < 8 else -1


@dataclass(frozen=True)
class FeatureHash:
    """The offline provider: a text's vector is the sum of its words' signed units, words lower-cased in A to Z. Another provider takes its place
    where there is a model; both go through embed(), which checks what they return."""

    dim: int = 64

    def vectors(self, texts: pd.Series) -> list[np.ndarray]:
        known: dict[str, tuple[int, int]] = {}
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in _WORD.findall((text or "").encode().lower().decode()):
                at = known.get(word)
                if at is None:
                    at = place_of(word, self.dim)
                    if len(known) < KEEP:
                        known[word] = at
                v[at[0]] += at[1]
            out.append(v)
        return out


def embed(rows: DataFrame, provider, text: str = "text", name: str = "embedding") -> DataFrame:
    """rows with a vector of each text, made batch by batch by provider.vectors (a series of texts to as many vectors of provider.dim numbers).
    Too few vectors, or one of another dimension, end the job: an index of mixed dimensions would answer wrongly. A null text is an empty one."""
    on_workers(rows.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        made = list(provider.vectors(texts))
        wrong = sorted({len(v) for v in made if len(v) != provider.dim})
        if wrong or len(made) != len(texts):
            raise ValueError(f"{len(made)} vectors for {len(texts)} texts, of dimensions {wrong or provider.dim}; {provider.dim} are expected")
        return pd.Series([np.asarray(v, dtype=float) for v in made], dtype=object)

    return rows.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(text)))


def ask(questions: DataFrame, index: DataFrame, provider, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """questions (question_id, text) put to an index (namespace, chunk_id, source_label, page_start, page_end, text, embedding of the same provider):
    (what was found, of retrieval.retrieve; the context of each question as one text)."""
    asked = embed(questions.select("question_id", "text"), provider, "text", "vector").select("question_id", "vector")
    found = retrieval.retrieve(asked, index, k)
    shown = found.withColumn("score", F.format_string("%.4f", "score"))
    return found, retrieval.context(shown, questions)
