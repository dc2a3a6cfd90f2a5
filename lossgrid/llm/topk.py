"""Exact top-k by inner product over impact-ordered postings, score at a time.

The index is cut into blocks of rows. In a block the size of each component is quantised to an impact
level, and the rows of one (level, dimension) are a posting segment. Queries take the segments by
descending impact; what is still open bounds every row's score from both sides, and a query stops only
where those bounds prove which rows can be members. These are scored exactly. The index is written once; queries stream by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
K = 10
#: Rows of a block on average, and queries that are answered together.
ROWS = 4096
QUERIES = 512
#: Queries of one task, on average.
STREAM = 65_536
#: Impact levels, each with about as many postings.
LEVELS = 16
#: Share of the levels after which a query first looks at its bounds.
LOOK = 0.5
#: A query stops where at most 1 / FEW of a block's rows can be members.
FEW = 32
#: Scores at or beyond this are held at it, as a long can't.
TOP = 2**63 - 1


class Block:
    """Posting segments of some rows: (level, dimension) to the places of its rows, level by level.

    ids: the rows' ids; rows: their integers; order: the places of all components in the rows, by segment; starts: where each
    segment starts in it. multiplied counts the multiplications that queries have taken.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, starts: np.ndarray):
        self.ids, self.rows, self.order, self.starts = ids, rows, order, starts
        self.multiplied = 0
        n, d = rows.shape
        self.n_levels = (len(starts) - 1) // d
        flat = rows.reshape(-1).astype(np.float64)
        self.values = flat[order]
        self.places = order // d
        left, count = (flat**2).reshape(n, d).sum(axis=1), np.full(n, d)
        #: For each level, the norm and the number of the components that each row still has after it.
        self.open, self.count = [], []
        for k in range(self.n_levels):
            at = slice(starts[k * d], starts[(k + 1) * d])
            left = left - np.bincount(self.places[at], self.values[at] ** 2, n)
            count = count - np.bincount(self.places[at], minlength=n)
            self.open.append(np.sqrt(np.maximum(left, 0) + (np.abs(flat).max(initial=0) ** 2) * d * 2.0**-50) * (count > 0))
            self.count.append(count)

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS) -> "Block":
        impact = np.abs(rows.astype(np.float64))
        # levels of about equal length, by size of component; the first holds the largest
        edges = np.unique(np.quantile(impact, np.arange(1, levels) / levels))
        level = len(edges) - np.searchsorted(edges, impact, side="right")
        d = rows.shape[1]
        segment = (level * d + np.arange(d)[None, :]).reshape(-1)
        order = np.argsort(segment, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=(len(edges) + 1) * d))])
        return cls(ids, rows, order.astype(np.int32), starts.astype(np.int64))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """query_id, id and exact score of the k best rows of each query but its own, ties to the smaller id.

        What is open of a row is at most its open norm times that of as many components of the query, the largest.
        A query stops where that proves that few rows can be members, at the latest when nothing is open.
        """
        q = queries.astype(np.float64)
        (n, d), out = self.rows.shape, []
        size = np.abs(self.rows.astype(np.float64)).max(initial=0)
        bound = np.abs(q).sum(axis=1) * size
        # the norm of the c largest components of each query, c from 0 to d
        largest = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(np.sort(q**2, axis=1)[:, ::-1], axis=1)], axis=1)) * (1 + 1e-9)
        noise = bound * ((d + 4) * 2.0**-51)
        live = np.arange(len(q))
        partial = np.zeros((n, len(q)))
        for i in range(self.n_levels):
            for j in range(d):
                at = slice(self.starts[i * d + j], self.starts[i * d + j + 1])
                if at.start < at.stop:
                    partial[self.places[at]] += self.values[at, None] * q[live, j][None, :]
                    self.multiplied += (at.stop - at.start) * len(live)
            last = i == self.n_levels - 1
            if not last and i + 1 < self.n_levels * LOOK:
                continue
            gap = largest[live][:, self.count[i]].T * self.open[i][:, None] + noise[live][None, :]
            self.multiplied += gap.size
            own = self.ids[:, None] == query_ids[live][None, :]
            least = np.where(own, -np.inf, partial - gap)
            possible = ~own & (partial + gap >= (np.partition(least, n - k, axis=0)[n - k] if n > k else -np.inf))
            possible |= ~own & (bound[live] >= 2.0**62)[None, :]
            done = possible.sum(axis=0) <= max(4 * k, n // FEW)
            done |= last
            for c in np.flatnonzero(done):
                at = np.flatnonzero(possible[:, c])
                self.multiplied += len(at) * d
                score = self.exact(at, queries[live[c]], bound[live[c]])
                order = np.lexsort((self.ids[at], -score))[:k]
                out.append(np.stack([np.full(len(order), query_ids[live[c]]), self.ids[at][order], score[order]], axis=1))
            live, partial = live[~done], partial[:, ~done]
            if not len(live):
                break
        return out

    def exact(self, at: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
        """The scores of the rows at these places; beyond a long's range they are held at its ends."""
        if bound < 2.0**62:
            return self.rows[at] @ query
        whole = [int(v) for v in query]
        return np.array([max(-TOP, min(TOP, sum(int(x) * y for x, y in zip(row, whole)))) for row in self.rows[at]], dtype=np.int64)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, v: floor(scale * x) of each component, x as double.

    Rows with a null id, a null or empty vector, or any null or non-finite component are left out.
    """
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0").filter(~F.exists("e", bad))
    return kept.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def build_index(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """vectors (vec_id, v) to a written index, a row a block and vector length: rb, d, ids, rows, order, starts."""
    numbered = common.save(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("uid")), "topk-rows")
    blocks = max(1, -(-numbered.count() // rows))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, part in own.groupby("d"):
            b = Block.of(part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64))
            out.append((int(own["rb"].iloc[0]), int(d), b.ids.tobytes(), b.rows.tobytes(), b.order.tobytes(), b.starts.tobytes()))
        return pd.DataFrame(out, columns=["rb", "d", "ids", "rows", "order", "starts"])

    # dealt by a number of the row, so repeated ids or vectors don't meet in one block
    dealt = numbered.select("vec_id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("rb"))
    return common.save(dealt.groupBy("rb").applyInPandas(run, "rb int, d int, ids binary, rows binary, order binary, starts binary"), "topk-index")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """vectors and queries (vec_id, v); query_id, rank, vec_id, score: each query's k best rows, or all if fewer.

    A row of the query's own id is no candidate. Vectors of another length than the query's take no
    part in its search. Repeated query rows count once; repeated rows are candidates each. Scores beyond a long are held at its ends.
    """
    return search(build_index(vectors, rows), queries, k, query_rows)


def search(index: DataFrame, queries: DataFrame, k: int = K, query_rows: int = QUERIES) -> DataFrame:
    """top_k over a written index. A task reads one block's segments once and lets its share of the queries stream by."""
    asked = common.save(queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.size("v").alias("d")), "topk-queries")
    groups = max(1, -(-asked.count() // STREAM))
    blocks = index.select("rb", "d").distinct()
    none = F.lit(None).cast("binary")
    right = asked.withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).join(blocks, "d")
    right = right.select("rb", "d", "qg", F.lit(1).alias("kind"), "vec_id", "v", *[none.alias(c) for c in ("ids", "rows", "order", "starts")])
    left = index.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left = left.select("rb", "d", "qg", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), "ids", "rows", "order", "starts")
    key = ["rb", "d", "qg"]

    def run(batches):
        block, held = None, None
        for pdf in batches:
            for name, part in pdf.groupby(key, sort=True):
                first = part[part["kind"] == 0]
                if len(first):
                    r = first.iloc[0]
                    block = Block(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64).reshape(-1, int(r["d"])), np.frombuffer(r["order"], np.int32), np.frombuffer(r["starts"], np.int64))
                    held = name
                ask = part[part["kind"] == 1]
                if held != name:
                    raise ValueError("queries came before their block")
                for at in range(0, len(ask), query_rows):
                    some = ask.iloc[at : at + query_rows]
                    out = block.best(some["vec_id"].to_numpy(np.int64), np.stack(some["v"].to_numpy()).astype(np.int64), k)
                    yield pd.DataFrame(np.concatenate([np.zeros((0, 3), np.int64), *out]), columns=["query_id", "vec_id", "score"])

    near = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind").mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every row of embeddings whose vec_id is divisible by 100. Rows with a null id, null or empty vectors
    and those with null or non-finite components take no part; ties go to the smaller vec_id; an empty table gives no rows."""
    v = common.save(quantised(common.read(spark, sf_dir, "embeddings")), "topk-vectors")
    return top_k(v, v.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
