"""What a session needs before Python workers run this package's functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where it is, if it isn't installed."""
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top not in have:
        env["PYTHONPATH"] = os.pathsep.join([top, *have])
