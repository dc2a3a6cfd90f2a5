"""Exact nearest vectors by angle that skips what cannot be near: cells around pivots, ruled out by the triangle inequality of angles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import on_workers
from ..sources.shared import save
from . import blocks, retrieval

#: Pivots of an index, and rings of angle around each: cells are at most their product for a namespace, and one for zero vectors.
PIVOTS, RINGS = 64, 16
#: Vectors, and questions, that meet in one task at a time.
BLOCK, ASKED = 4096, 1024
#: The cell of vectors whose cosines only the expression knows (blocks.is_odd); every question meets it.
ODD = -2


def _unit(vectors) -> np.ndarray:
    """Rows of length one; null, zero and non-finite vectors are rows of zeros."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    out = np.stack([np.asarray(v, float) if v is not None and len(v) == dim else np.zeros(dim) for v in vectors]) if dim else np.zeros((len(vectors), 0))
    out[~np.isfinite(out).all(axis=1)] = 0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Pivoted:
    """An index in cells. rows: its columns, cell and split (which part of BLOCK vectors); cells: of each namespace and cell the least and greatest
    angle to its pivot, the number of vectors and of splits."""

    rows: DataFrame
    cells: pd.DataFrame
    pivots: np.ndarray
    rings: int = RINGS


def build(index: DataFrame, pivots: int = PIVOTS, rings: int = RINGS) -> Pivoted:
    """index (namespace, chunk_id, embedding, ..) in cells. Pivots are vectors of the index, the first by hash: a bounded sample that decides
    how much is skipped, never what is found. The driver gets pivots and cells, not vectors; namespaces are a fixed few."""
    on_workers(index.sparkSession)
    first = index.filter("embedding IS NOT NULL").select("embedding", F.xxhash64("namespace", "chunk_id").alias("h")).orderBy("h").limit(pivots).collect()
    at = _unit([r["embedding"] for r in first]) if first else np.zeros((0, 0))
    at = at[(at != 0).any(axis=1)] if at.size else at

    def place(vectors: pd.Series) -> pd.DataFrame:
        unit = _unit(list(vectors))
        if not len(at) or unit.shape[1] != at.shape[1]:
            return pd.DataFrame({"cell": [ODD if blocks.is_odd(v) else -1 for v in vectors], "angle": [0.0] * len(unit)})
        cos = np.clip(unit @ at.T, -1, 1)
        best = cos.argmax(axis=1)
        angle = np.arccos(cos[np.arange(len(unit)), best])
        zero = ~(unit != 0).any(axis=1)
        odd = np.array([blocks.is_odd(v) for v in vectors], bool)
        ring = np.minimum((angle / math.pi * rings).astype(int), rings - 1)
        return pd.DataFrame({"cell": np.where(odd, ODD, np.where(zero, -1, best * rings + ring)), "angle": np.where(zero, 0.0, angle)})

    placed = index.withColumn("_p", F.pandas_udf(place, "cell int, angle double")("embedding")).select("*", F.col("_p.cell").alias("cell"), F.col("_p.angle").alias("angle")).drop("_p")
    placed = save(placed, "pivoted")
    cells = placed.groupBy("namespace", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    cells = cells.withColumn("splits", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = placed.join(F.broadcast(cells.select("namespace", "cell", "splits")), ["namespace", "cell"])
    rows = rows.withColumn("split", F.pmod(F.xxhash64("chunk_id"), F.col("splits")).cast("int")).drop("splits", "angle")
    return Pivoted(rows, cells.toPandas(), at, rings)


def _bounds(pivots: np.ndarray, rings: int, unit: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """A row a question, a column a cell: no vector of the cell has a greater cosine. An angle is at least the difference of two others."""
    cell = cells["cell"].to_numpy()
    out = np.zeros((len(unit), len(cell)))
    near = cell >= 0
    if near.any() and len(pivots):
        mine = np.arccos(np.clip(unit @ pivots.T, -1, 1))[:, cell[near] // rings]
        apart = np.maximum(0, np.maximum(mine - cells["high"].to_numpy()[near], cells["low"].to_numpy()[near] - mine))
        out[:, near] = np.cos(np.minimum(apart, math.pi))
    # the cosine with a zero vector is 0, of a zero question with all
    out[~(unit != 0).any(axis=1)] = 0
    out[:, cell == ODD] = 2
    return out


def _scored(pivoted: Pivoted, asks: DataFrame, k: int, counter=None) -> DataFrame:
    """asks (question_id, vector, namespace, cell, least) to candidates (question_id, namespace, chunk_id, raw): of each block met, the k best of a
    question and all that tie with them, and none below least. Blocks of vectors and of questions meet in one task, as products of matrices."""
    splits = asks.sparkSession.createDataFrame(pivoted.cells[["namespace", "cell", "splits"]])
    met = asks.join(F.broadcast(splits), ["namespace", "cell"]).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    many = met.groupBy("namespace", "cell").agg(F.countDistinct("question_id").alias("q")).withColumn("asks", F.ceil(F.col("q") / ASKED).cast("int"))
    met = met.join(many.select("namespace", "cell", "asks"), ["namespace", "cell"]).withColumn("ask", F.pmod(F.xxhash64("question_id"), F.col("asks")).cast("int")).drop("asks")
    vectors = pivoted.rows.select("namespace", "cell", "split", "chunk_id", "embedding").join(many.select("namespace", "cell", "asks"), ["namespace", "cell"])
    vectors = vectors.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks")
    # the namespace is told by the vectors' rows
    return blocks.met(met.withColumnRenamed("namespace", "_ns"), vectors.withColumn("_ns", F.col("namespace")), ["_ns", "cell", "split", "ask"], k, counter)


def retrieve(questions: DataFrame, pivoted: Pivoted, k: int = 3, counter=None) -> DataFrame:
    """As retrieval.retrieve, to the same rows: of each namespace the k nearest by cosine, together the 2 * k best.

    First each question meets the cells of each namespace with the greatest bounds that hold k vectors; the k-th best there is a threshold,
    and then all cells whose bound reaches it. The candidates left are scored again by the one expression of cosine, so ties
    and places are those of a whole scan. counter, an accumulator, gets the number of cosines.
    """
    on_workers(questions.sparkSession)
    kind = questions.schema["question_id"].dataType.simpleString()
    pivots, rings = pivoted.pivots, pivoted.rings
    by_name = {n: g.reset_index(drop=True) for n, g in pivoted.cells.groupby("namespace")}
    asked = f"question_id {kind}, vector array<double>, namespace string, cell int, least double"

    def rows(pdf, name, take, least):
        i, j = np.nonzero(take)
        return pd.DataFrame({"question_id": pdf["question_id"].to_numpy()[i], "vector": pdf["vector"].to_numpy()[i], "namespace": name, "cell": by_name[name]["cell"].to_numpy()[j], "least": least[i]})

    def seeds(unit: np.ndarray, name: str) -> np.ndarray:
        bound, n = _bounds(pivots, rings, unit, by_name[name]), by_name[name]["n"].to_numpy()
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    def first(batches):
        for pdf in batches:
            unit = _unit(list(pdf["vector"]))
            for name in by_name:
                yield rows(pdf, name, seeds(unit, name), np.full(len(pdf), -2.0))

    def second(batches):
        for pdf in batches:
            unit = _unit(list(pdf["vector"]))
            for name in by_name:
                least = np.array([{r["namespace"]: r["least"] for r in x}.get(name, -2.0) for x in pdf["least_of"]], float)
                bound = _bounds(pivots, rings, unit, by_name[name])
                yield rows(pdf, name, (bound >= least[:, None] - blocks.SLACK) & ~seeds(unit, name), least)

    plain = questions.select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    begun = save(_scored(pivoted, plain.mapInPandas(first, asked), k, counter), "nearest-first")
    rank = F.row_number().over(Window.partitionBy("question_id", "namespace").orderBy(F.desc("raw")))
    least = begun.filter("raw IS NOT NULL").withColumn("_r", rank).filter(F.col("_r") == k).groupBy("question_id").agg(F.collect_list(F.struct("namespace", F.col("raw").alias("least"))).alias("least_of"))
    with_least = plain.join(least, "question_id", "left").withColumn("least_of", F.coalesce("least_of", F.array().cast("array<struct<namespace:string,least:double>>")))
    more = _scored(pivoted, with_least.mapInPandas(second, asked), k, counter)
    found = begun.unionByName(more)
    return retrieval.placed(retrieval.rejoined(blocks.best(found, k), plain, pivoted.rows.drop("cell", "split")), k)
