"""A fixed format is tried only where the text has its shape, and nothing is lost by that."""

import datetime as dt

from pyspark.sql import functions as F

from lossgrid.functions import dates
from lossgrid.plans import question_queries

TEXTS = ["05-Mar-2024", "05-MARCH-2024", "05-mar-2024 10:30", "05/03/2024", "05/03/2024 10:30", "05-03-2024", "05-03-2024 25:30", "2024-03-05 10:30:05", "2024-03-05T10:30:05", "2024-03-05t10:30:05", "2024-03-05 10:30", "2024-03-05", "-2024-03-05", "+12024-03-05", "12024-03-05", "05-03--2024", "05-Mar-24", "5-Mar-2024", " 05-Mar-2024 ", "05-Mar-2024\n", "x", "", None]


def test_shapes_lose_nothing(spark):
    rows = [(t,) for t in TEXTS]
    tried = [F.try_to_timestamp(F.trim("v"), F.lit(f)) for f in dates.FORMATS]
    shaped = [F.coalesce(F.trim("v").rlike(dates._shape(f)), F.lit(False)) for f in dates.FORMATS]
    got = spark.createDataFrame(rows, "v string").select("v", F.array(*tried).cast("array<string>").alias("t"), F.array(*shaped).alias("s")).collect()
    assert all(s or t is None for r in got for t, s in zip(r.t, r.s))
    assert any(t is not None for r in got for t in r.t)
    # at most one format is tried for a text
    assert max(sum(r.s) for r in got) == 1


def test_dates_are_dealt_before_they_become_texts(spark):
    out = question_queries.date_texts(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == 4
    assert out.filter(F.col("day").isNull() & (F.col("claim_id") % 10 != 9)).count() == 0 and out.filter(F.col("day") > F.lit(dt.date(1990, 1, 1))).count() > 0
