"""Queries that run a stream over a table and show what it has raised."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as b
from ..streaming import clocks

#: Hours before the last event at which the claims are looked at.
CLOCKS = (0, 12, 30, 100)


def stream_clocks(spark, sf):
    """Users as claims, their events as pages that come in: level, breach and hold of each at several clocks, from the steps of one stream."""
    schema = b.table(spark, sf, "events").schema
    # a stream takes folders or patterns; this one is the table's file or folder
    live = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    page = lambda df: df.select(F.col("user_id").cast("long").alias("claim_id"), F.col("ts").cast("timestamp").alias("at"))
    done = clocks.run(spark, page(live))
    table = page(b.table(spark, sf, "events"))
    last = table.agg(F.unix_millis(F.max("at")).alias("last")).first()["last"]
    out = None
    for hours in CLOCKS:
        one = clocks.at_clock(table, done, F.lit((last or 0) - hours * clocks.HOUR_MS).cast("long")).withColumn("hours_before", F.lit(hours))
        out = one if out is None else out.unionByName(one)
    return out


SQL = {
    "stream_clocks": f"""WITH e AS (SELECT user_id AS claim_id, epoch_ms(ts) AS seen FROM events), c AS (SELECT max(seen) - hours_before * 3600000 AS clock, hours_before FROM e, (SELECT unnest([{", ".join(map(str, CLOCKS))}]) AS hours_before) GROUP BY hours_before),
      p AS (SELECT claim_id, CAST(hours_before AS INTEGER) AS hours_before, (clock - min(seen)) / 3600000.0 AS h, count(*) AS pages FROM e JOIN c ON seen <= clock GROUP BY claim_id, hours_before, clock)
      SELECT claim_id, hours_before, CASE WHEN h < 6 THEN 'LOW' WHEN h < 18 THEN 'MEDIUM' WHEN h < 24 THEN 'HIGH' ELSE 'CRITICAL' END AS aging_risk_level, h > 24 AS sla_breached, pages < {clocks.PAGES} AS held FROM p""",
}
QUERIES = {k: globals()[k] for k in SQL}
