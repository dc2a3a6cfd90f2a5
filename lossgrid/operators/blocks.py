"""Questions and vectors that share a key meet in one task, as products of matrices that leave the few pairs that may be among the nearest."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions, and vectors, of a block that are multiplied at a time.
SLICE, WIDTH = 512, 1024
#: More than rounding can make of a cosine.
SLACK = 1e-9
#: What stands for no cosine, and what only cosines reach.
NONE, NEVER = -2.0, -1.5
#: Squares of lengths between which a cosine by unit vectors is that of the expression, but for rounding.
LEAST_SQUARE, MOST_SQUARE = 1e-200, 1e200


def _arrays(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors as rows, padded with zeros to dim; their lengths, -1 for null and for those that hold a null, which are rows of zeros)."""
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    out, there = np.zeros((len(n), dim)), np.arange(dim) < n[:, None]
    out[there] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    holed = np.zeros((len(n), dim), bool)
    holed[there] = flat.is_null().to_numpy(zero_copy_only=False)
    none = holed.any(axis=1) | vectors.is_null().to_numpy(zero_copy_only=False)
    out[none], n[none] = 0, -1
    return out, n


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one; odd ones, whose cosines only the expression knows: not finite, or their squares leave the range of doubles)."""
    with np.errstate(all="ignore"):
        square = np.einsum("ij,ij->i", rows, rows)
        odd = ~((square == 0) | ((square > LEAST_SQUARE) & (square < MOST_SQUARE)))
        out = rows / np.sqrt(np.where(odd | (square == 0), 1, square))[:, None]
        out[odd] = 0
        return out, odd


def is_odd(vector) -> bool:
    """Whether only the expression knows a vector's cosines, as _units has it. Null: no."""
    if vector is None:
        return False
    with np.errstate(all="ignore"):
        square = float((np.asarray(vector, float) ** 2).sum())
    return not (square == 0 or LEAST_SQUARE < square < MOST_SQUARE)


def _distinct(rows: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors the first k: the others lose each tie to them. Vectors that hold a null count as equal, as their cosines are all 0."""
    seen: Counter[tuple[int, bytes]] = Counter()
    keep = np.ones(len(rows), bool)
    for i, at in enumerate(zip(n.tolist(), (row.tobytes() for row in rows))):
        seen[at] += 1
        keep[i] = seen[at] <= k
    return keep


def _with(top: np.ndarray, rows: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """top, the k best of each row, with further values raw of some rows; rows ascend."""
    n, k = np.bincount(rows, minlength=len(top)), top.shape[1]
    more = np.full((len(top), n.max(initial=0)), NONE)
    more[rows, np.arange(len(rows)) - (np.cumsum(n) - n)[rows]] = raw
    return np.partition(np.hstack([top, more]), more.shape[1], axis=1)[:, -k:]


def _nearest(q: tuple, v: tuple, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q and v (rows of length one, lengths, odd ones), v by chunk_id, to places in q and in v and cosines of what may be among the k nearest: the k
    best that are at least `least`, all that tie with them, odd pairs. Of what surely has cosine 0 (a zero question, another length) the first k do.

    The k best so far bound what the next WIDTH vectors give, so of these few are looked at one by one."""
    (uq, nq, oddq), (uv, nv, oddv) = q, v
    plain = (uq == 0).all(axis=1) & ~oddq
    zeros = plain.any() or len(np.unique(np.append(nq, nv))) > 1
    top, met_zeros, picked = np.full((len(uq), k), NONE), np.zeros(len(uq), int), []
    space = np.empty(len(uq) * WIDTH)
    for j in range(0, len(uv), WIDTH):
        part = slice(j, j + WIDTH)
        odd = oddv[part]
        raw = space[: len(uq) * len(odd)].reshape(len(uq), len(odd))
        np.matmul(uq, uv[part].T, out=raw)
        if zeros:
            zero = (plain[:, None] | (nq[:, None] != nv[part])) & ~odd
            raw[zero] = 0
            nth = np.cumsum(zero, axis=1) + met_zeros[:, None]
            met_zeros = nth[:, -1]
            raw[zero & (nth > k)] = NONE
        raw[:, odd] = NONE
        floor = top.min(axis=1)
        if j == 0 and raw.shape[1] > k:
            floor = np.partition(raw, raw.shape[1] - k, axis=1)[:, -k]
        raw[oddq] = NONE
        rows, cols = np.divmod(np.flatnonzero(raw >= np.maximum(np.maximum(floor, least), NEVER)[:, None] - SLACK), len(odd))
        near = raw[rows, cols]
        top = _with(top, rows, near)
        picked.append((rows, cols + j, near))
        if odd.any() or oddq.any():
            rows, cols = np.nonzero(odd | oddq[:, None])
            picked.append((rows, cols + j, np.full(len(rows), np.nan)))
    rows, cols, raw = (np.concatenate(x) for x in zip(*picked))
    stay = np.isnan(raw) | (raw >= top.min(axis=1)[rows] - SLACK)
    return rows[stay], cols[stay], raw[stay]


def met(asks: DataFrame, vectors: DataFrame, key: list[str], k: int, counter=None) -> DataFrame:
    """asks (key, question_id, vector, least) and vectors (key, namespace, chunk_id, embedding) to candidates (question_id, namespace, chunk_id, raw):
    of each key and namespace the k best of a question and all that tie with them, none below least. raw is null where only the expression of
    cosine can tell: such a pair is always a candidate. A zero question ties with all, one of another length with those that have not its length:
    of these the k first by chunk_id are enough."""
    kind = asks.schema["question_id"].dataType.simpleString()
    # floats move as they are, half as long as doubles
    floats = all(t.simpleString() == "array<float>" for t in (asks.schema["vector"].dataType, vectors.schema["embedding"].dataType))
    numbers = lambda c: F.col(c).cast("array<float>" if floats else "array<double>").alias("v")
    left = asks.select(*key, F.lit(True).alias("_ask"), "question_id", "least", numbers("vector"))
    right = vectors.select(*key, F.lit(False).alias("_ask"), "namespace", "chunk_id", numbers("embedding"))
    names = ["question_id", "namespace", "chunk_id", "raw"]

    def meet(table: pa.Table) -> pa.Table:
        is_ask = table.column("_ask")
        q, v = table.filter(is_ask), table.filter(pc.invert(is_ask))
        v = v.take(pc.sort_indices(v, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
        kinds = [table.schema.field(c).type for c in names[:3]] + [pa.float64()]
        vq, vv = _arrays(q.column("v")), _arrays(v.column("v"))
        dim = max([0, *(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (vq, vv))])
        (rq, nq), (rv, nv) = _rows(vq, dim), _rows(vv, dim)
        (uq, oddq), (uv, oddv) = _units(rq), _units(rv)
        least = q.column("least").to_numpy()
        if counter is not None:
            counter.add(len(uq) * len(uv))
        spaces = _arrays(v.column("namespace")).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        picked = []
        for space in np.unique(spaces):
            at = np.flatnonzero(spaces == space)
            at = at[_distinct(rv[at], nv[at], k)]
            mine = uv[at], nv[at], oddv[at]
            for i in range(0, len(uq), SLICE):
                part = slice(i, i + SLICE)
                rows, cols, raw = _nearest((uq[part], nq[part], oddq[part]), mine, least[part], k)
                picked.append((rows + i, at[cols], raw))
        if not picked:
            return pa.table([pa.array([], t) for t in kinds], names)
        rows, cols, raw = (np.concatenate(x) for x in zip(*picked))
        rows, cols = pa.array(rows), pa.array(cols)
        return pa.table([q.column("question_id").take(rows), v.column("namespace").take(cols), v.column("chunk_id").take(cols), pa.array(raw, mask=np.isnan(raw))], names)

    return left.unionByName(right, allowMissingColumns=True).groupBy(*key).applyInArrow(meet, f"question_id {kind}, namespace string, chunk_id string, raw double")


def best(found: DataFrame, k: int) -> DataFrame:
    """found (of met) without pairs that k others of the question and namespace surely beat: question_id, namespace, chunk_id, each once."""
    by = Window.partitionBy("question_id", "namespace")
    nth = F.row_number().over(by.orderBy(F.desc_nulls_last("raw")))
    kth = F.max(F.when(F.col("_n") == k, F.col("raw"))).over(by)
    near = found.withColumn("_n", nth).withColumn("_k", F.coalesce(kth, F.lit(NONE)))
    return near.filter(F.col("raw").isNull() | (F.col("raw") >= F.col("_k") - SLACK)).select("question_id", "namespace", "chunk_id").distinct()
