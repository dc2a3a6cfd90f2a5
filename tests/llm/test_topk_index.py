"""The index: fewer multiplications than a scan, the same results, and components of any finite size."""

import numpy as np
from pyspark.sql import functions as F

from lossgrid.llm import topk


def plain(ids, rows, query_id, query, k):
    score = [max(-topk.TOP, min(topk.TOP, sum(int(x) * int(y) for x, y in zip(r, query)))) for r in rows]
    best = sorted((-s, i) for s, i in zip(score, ids.tolist()) if i != query_id)[:k]
    return [(query_id, i, -s) for s, i in best]


def test_stops_before_a_scan_ends():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 0.125, (4096, 64)) * 1024).astype(np.int64)
    ids = np.arange(4096)
    block = topk.Block.of(ids, rows)
    assert len(block.order) == rows.size and block.starts[-1] == rows.size
    asked = ids[::100]
    got = np.concatenate(block.best(asked, rows[asked], 10))
    want = [x for i in asked.tolist() for x in plain(ids, rows, i, rows[i], 10)]
    assert sorted(map(tuple, got.tolist())) == sorted(want)
    assert block.multiplied < 0.95 * rows.size * len(asked)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    for size in (1e5, 1e6, 1e9, 1e15):
        rows = (rng.normal(size=(40, 5)) * size).round(3)
        rows[7] = rows[3]
        whole = np.floor(rows * 1024).clip(-(2.0**63), 2.0**63 - 1025).astype(np.int64)
        v = topk.quantised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>"))
        got = {tuple(r) for r in topk.top_k(v, v.filter("vec_id < 5"), 4).select("query_id", "vec_id", "score").collect()}
        assert got == {x for i in range(5) for x in plain(np.arange(40), whole, i, whole[i], 4)}


def test_index_is_written_once_and_asked_twice(spark):
    v = topk.quantised(spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.25)).alias("embedding")))
    index = topk.build_index(v, 100)
    assert index.count() > 3
    one, two = topk.search(index, v.filter("vec_id < 30"), 3, 7), topk.search(index, v.filter("vec_id < 30"), 3)
    assert one.count() == 90 and one.exceptAll(two).count() == 0
