"""Skipping search against the whole scan, and how much it skips."""

import random

import numpy as np

from lossgrid.operators import nearest, retrieval
from lossgrid.streaming import clocks

INDEX = "namespace string, chunk_id string, embedding array<double>"


def clustered(n, dim=16, centres=40, spread=0.05):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(centres, dim))
    return [(at[i % centres] + spread * rng.normal(size=dim)).tolist() for i in range(n)]


def both(spark, index, asked, counter=None):
    i, q = spark.createDataFrame(index, INDEX), spark.createDataFrame(asked, "question_id int, vector array<double>")
    show = lambda df: sorted(tuple(r) for r in df.select("question_id", "place", "namespace", "chunk_id", "score").collect())
    return show(nearest.retrieve(q, nearest.build(i), 3, counter)), show(retrieval.retrieve(q, i, 3))


def test_clustered_vectors_are_mostly_skipped(spark):
    vectors = clustered(3000)
    index = [(f"n{i % 2}", f"c{i:05d}", v) for i, v in enumerate(vectors)]
    asked = [(i, vectors[7 * i]) for i in range(60)]
    counter = spark.sparkContext.accumulator(0)
    got, want = both(spark, index, asked, counter)
    assert got == want and len(got) == 60 * 6
    assert counter.value < 0.5 * 60 * 3000


def test_odd_vectors(spark):
    rng = random.Random(1)
    index = [(rng.choice("ab"), f"c{i:03d}", [rng.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(3)]) for i in range(150)] + [("a", "zero", [0.0, 0.0, 0.0]), ("a", "null", None), ("c", "only", [1.0, 0.0, 0.0])]
    asked = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(20)] + [(99, [0.0, 0.0, 0.0])]
    got, want = both(spark, index, asked)
    assert got == want


def test_steps_of_a_stream_do_not_hang_on_batches(spark, tmp_path):
    """Pages in several batches, out of order within the lateness allowed, raise what one batch raises; at each clock that is what the table says."""
    import datetime as dt

    from pyspark.sql import functions as F

    rng, start = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(c, start + dt.timedelta(minutes=rng.randrange(6000))) for c in range(12) for _ in range(rng.randrange(1, 9))] + [(99, start + dt.timedelta(minutes=6100))]
    rows.sort(key=lambda r: r[1])
    schema = "claim_id long, at timestamp"
    for k in range(0, len(rows), 9):
        part = rows[k : k + 9]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04d}")
    table = spark.createDataFrame(rows, schema)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    done = clocks.run(spark, live, 3)
    last = max(r[1] for r in rows)
    for hours in (0, 5, 20, 60, 95):
        clock = last - dt.timedelta(hours=hours)
        got = {r.claim_id: (r.aging_risk_level, r.sla_breached, r.held) for r in clocks.at_clock(table, done, F.unix_millis(F.lit(clock))).collect()}
        want = {}
        for c in {r[0] for r in rows}:
            seen = sorted(t for k, t in rows if k == c and t <= clock)
            if seen:
                age = (clock - seen[0]).total_seconds() / 3600
                want[c] = ("LOW" if age < 6 else "MEDIUM" if age < 18 else "HIGH" if age < 24 else "CRITICAL", age > 24, len(seen) < 3)
        assert got == want, hours
