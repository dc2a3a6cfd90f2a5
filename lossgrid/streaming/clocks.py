"""Clocks of claims in a stream: timers raise a claim's aging level and hold it until its pages are there."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.session import on_workers
from ..sources.shared import new_path

#: Hours of age from which a claim is at a level.
LEVELS = (("MEDIUM", 6), ("HIGH", 18), ("CRITICAL", 24))
HOUR_MS = 3_600_000
#: Pages that a claim waits for.
PAGES = 5
RELEASED = "RELEASED"
STEP = "claim_id bigint, step string, at_ms bigint"


def due(times: list[int], pages: int) -> dict[str, int]:
    """What happens to a claim and when (milliseconds), by the times of its first pages in order: the first page is its receipt."""
    out = {level: times[0] + hours * HOUR_MS for level, hours in LEVELS} if times else {}
    return out | ({RELEASED: times[pages - 1]} if len(times) >= pages else {})


class Clocks(StatefulProcessor):
    """Keeps the times of a claim's first pages and one timer, for what is due next: when it rings, all that is due up to the watermark is told,
    and the timer is set anew. Steps come from timers alone, so they do not hang on how rows fall into batches or in which order they come, as
    long as none comes later than the watermark allows: what a page may still change is due after the watermark."""

    def __init__(self, pages: int = PAGES):
        self.pages = pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "times string, timer long")

    def _kept(self) -> tuple[list[int], int | None]:
        times, timer = self.first.get() or ("", None)
        return [int(x) for x in times.split(",") if x], timer

    def _wait(self, times: list[int], timer: int | None, left: list[int]) -> None:
        """Keep times, and a timer for the first of left instead of timer."""
        after = min(left, default=None)
        if after != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        self.first.update((",".join(map(str, times)), after))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old, timer = self._kept()
        new = heapq.nsmallest(self.pages, [*old, *(r["at_ms"] for r in rows)])
        if new != old:
            told = {s for s, t in due(old, self.pages).items() if timer is None or t < timer}
            self._wait(new, timer, [t for s, t in due(new, self.pages).items() if s not in told])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        times, _ = self._kept()
        by = max(at, timerValues.getCurrentWatermarkInMs())
        left = {s: t for s, t in due(times, self.pages).items() if t >= at}
        self._wait(times, None, [t for t in left.values() if t > by])
        yield from (Row(claim_id=key[0], step=s, at_ms=t) for s, t in left.items() if t <= by)

    def close(self) -> None:
        pass


def steps(pages: DataFrame, n_pages: int = PAGES, late: str = "0 seconds") -> DataFrame:
    """A stream of pages (claim_id, at) to a stream of steps (STEP): a level reached, or the claim released with its last page."""
    rows = pages.select("claim_id", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    return rows.groupBy("claim_id").transformWithState(Clocks(n_pages), STEP, "Append", "EventTime")


def run(spark: SparkSession, pages: DataFrame, n_pages: int = PAGES) -> DataFrame:
    """All that a stream of pages has by now, its steps as a table: every timer up to the latest page has rung."""
    on_workers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    target, checkpoint = new_path(spark, "steps"), new_path(spark, "steps-checkpoint")
    steps(pages, n_pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(STEP).parquet(target)


def at_clock(pages: DataFrame, done: DataFrame, clock: Column) -> DataFrame:
    """The claims of pages (claim_id, at) at a clock (milliseconds), by their steps: claim_id, aging_risk_level, sla_breached, held. A claim
    counts from its receipt on."""
    ranks = F.create_map(*[F.lit(x) for i, (level, _) in enumerate(LEVELS, 1) for x in (level, i)])
    names = F.array(F.lit("LOW"), *[F.lit(level) for level, _ in LEVELS])
    past = done.filter(F.col("at_ms") <= clock)
    top = past.groupBy("claim_id").agg(F.max(ranks[F.col("step")]).alias("rank"), F.bool_or((F.col("step") == LEVELS[-1][0]) & (F.col("at_ms") < clock)).alias("breached"), F.bool_or(F.col("step") == RELEASED).alias("released"))
    there = pages.filter(F.unix_millis("at") <= clock).select("claim_id").distinct()
    out = there.join(top, "claim_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("claim_id", F.get(names, F.coalesce("rank", F.lit(0))).alias("aging_risk_level"), no("breached").alias("sla_breached"), (~no("released")).alias("held"))
