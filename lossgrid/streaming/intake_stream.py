"""Claims as a stream: waiting period and aging of each file of new claims as it comes. An addition; batch is the main path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import triage

CLAIM = "claim_id long, incident_date date, policy_inception date, waiting_period_days int, received_at timestamp"


def assess(claims: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Stateless, so it is the same for a table and a stream."""
    return triage.aging(triage.waiting_period(claims), F.col("received_at"), F.current_timestamp() if as_of is None else as_of)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, as_of: Column | None = None) -> StreamingQuery:
    """Parquet files put into source, to parquet in target, once each."""
    claims = spark.readStream.schema(CLAIM).parquet(source)
    return assess(claims, as_of).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
