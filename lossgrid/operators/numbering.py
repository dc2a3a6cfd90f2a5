"""Consecutive numbers for rows in an order, without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save


def numbered(df: DataFrame, order: list, name: str = "nth", start: int = 1) -> DataFrame:
    """df with a column of whole numbers from start on, in the order; equal rows in any order.

    Ranges of the order go to tasks, which sort theirs and write it; only the number of rows of each task, as many as there are shuffle
    partitions, meets in one. The table is written so that both passes see the same rows in the same place.
    """
    # the id of a row is its task's number times 2^33 and its place there
    dealt = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    out = dealt.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return out.select(*df.columns, (F.col("_before") + place + start).cast("long").alias(name))
