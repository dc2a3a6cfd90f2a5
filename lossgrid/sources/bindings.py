"""Canonical claim tables from the star-schema tables; each has the same expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import on_workers

#: Incident types.
INCIDENT_TYPES = ("ACCIDENT_OWN", "ACCIDENT_WITH_THIRD_PARTY", "ACCIDENT_WITH_THIRD_PARTY_INJURY", "THEFT_COMPLETE", "THEFT_PARTIAL", "FIRE", "FLOOD_OR_NATURAL_CALAMITY", "VANDALISM", "THIRD_PARTY_CLAIM_ONLY", "PERSONAL_ACCIDENT", "OTHER")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of each order is its incident; the least by number, part, supplier, date and quantity."""
    line = table(spark, sf_dir, "lineitem")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"))
    return line.groupBy("l_orderkey").agg(first.alias("l")).select("l_orderkey", "l.*")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim with its policy: one row an order that has lines."""
    o = table(spark, sf_dir, "orders")
    j = incidents(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.col("l_shipdate").cast("date")
    start = F.col("o_orderdate").cast("date")
    n = F.col("l_quantity").cast("int")
    types = F.array(*[F.lit(t) for t in INCIDENT_TYPES])
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    verdict = lambda hit: F.struct(F.when(hit, "true").otherwise("false").alias("triggered"), F.lit("HIGH").alias("confidence"), F.lit("as judged").alias("reason"))
    return j.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("policy_number"), F.col("o_custkey").alias("member_id"), F.col("o_custkey").alias("vehicle_reg"),
        F.element_at(types, n % len(INCIDENT_TYPES) + 1).alias("incident_type"), day.alias("incident_date"), F.date_add(day, n % 10).alias("received_date"),
        start.alias("policy_inception"), F.date_add(start, 365).alias("policy_expiry"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "LAPSED").otherwise("CANCELLED").alias("policy_status"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("hypothecated"), (F.col("o_totalprice") * 2).alias("idv"), F.lit(30).alias("waiting_period_days"),
        (F.col("o_orderkey") % 6 * 10).cast("double").alias("ncb_percent"),
        F.when(F.col("l_partkey") % 7 == 0, "Yes").otherwise("No").alias("injury_reported"), F.when(F.col("l_suppkey") % 9 == 0, "true").otherwise("No").alias("legal_notice"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).when(F.col("l_partkey") % 5 == 1, "HDFC Bank").otherwise("NIL").alias("hypothecation_rc"),
        F.when(part % 4 == 0, "LMV|MCWG").when(part % 4 == 2, "MCWG").when(part % 4 == 3, "TRANS, LMV").alias("authorised_classes"),
        F.when(supp % 3 == 0, "Motor Car (LMV)").when(supp % 3 == 1, "Motor Cycle (MCWG)").alias("vehicle_class_rc"),
        F.when(part % 11 == 1, F.lit(None)).otherwise(part % 11 == 0).alias("owner_differs"),
        F.when(supp % 13 == 0, F.array(F.lit("vehicle_make"), F.lit("policy_number"))).otherwise(F.array().cast("array<string>")).alias("failed_checks"),
        F.when(supp % 19 != 0, F.struct(verdict(part % 17 == 0).alias("narrative_coherence"), verdict(part % 3 == 0).alias("key_status_concern"), verdict(part % 23 == 0).alias("damage_severity_plausibility"))).alias("verdict"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("prior_id"), F.col("o_custkey").alias("vehicle_reg"), F.col("o_custkey").alias("member_id"), F.col("o_orderdate").cast("date").alias("claim_date"), F.col("o_orderpriority").alias("prior_type"), (F.col("o_orderstatus") == "F").alias("ncb_impact"), F.col("o_orderkey").alias("row_pos"))


_TYPES = "[" + ", ".join(f"'{t}'" for t in INCIDENT_TYPES) + "]"

#: The same tables as common table expressions.
SQL = f"""
WITH inc AS (
  SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn FROM lineitem l) WHERE rn = 1
), claims AS (
  SELECT o_orderkey AS claim_id, o_orderkey AS policy_number, o_custkey AS member_id, o_custkey AS vehicle_reg,
    ({_TYPES})[CAST(l_quantity AS INTEGER) % {len(INCIDENT_TYPES)} + 1] AS incident_type,
    CAST(l_shipdate AS DATE) AS incident_date, CAST(l_shipdate AS DATE) + CAST(CAST(l_quantity AS INTEGER) % 10 AS INTEGER) AS received_date,
    CAST(o_orderdate AS DATE) AS policy_inception, CAST(o_orderdate AS DATE) + 365 AS policy_expiry,
    CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'LAPSED' ELSE 'CANCELLED' END AS policy_status,
    substr(o_orderpriority, 1, 1) IN ('1', '2') AS hypothecated, o_totalprice * 2 AS idv, 30 AS waiting_period_days,
    CAST(o_orderkey % 6 * 10 AS DOUBLE) AS ncb_percent,
    CASE WHEN l_partkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS injury_reported, CASE WHEN l_suppkey % 9 = 0 THEN 'true' ELSE 'No' END AS legal_notice,
    CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HDFC Bank' ELSE 'NIL' END AS hypothecation_rc,
    CASE l_partkey % 4 WHEN 0 THEN 'LMV|MCWG' WHEN 2 THEN 'MCWG' WHEN 3 THEN 'TRANS, LMV' END AS authorised_classes,
    CASE l_suppkey % 3 WHEN 0 THEN 'Motor Car (LMV)' WHEN 1 THEN 'Motor Cycle (MCWG)' END AS vehicle_class_rc,
    CASE l_partkey % 11 WHEN 1 THEN NULL WHEN 0 THEN true ELSE false END AS owner_differs,
    CASE WHEN l_suppkey % 13 = 0 THEN 2 ELSE 0 END AS n_failed, l_suppkey % 19 <> 0 AS judged,
    l_partkey % 17 = 0 AS v_narrative, l_partkey % 3 = 0 AS v_key, l_partkey % 23 = 0 AS v_damage
  FROM inc JOIN orders ON l_orderkey = o_orderkey
), history AS (
  SELECT o_orderkey AS prior_id, o_custkey AS vehicle_reg, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS claim_date, o_orderpriority AS prior_type, o_orderstatus = 'F' AS ncb_impact, o_orderkey AS row_pos FROM orders
)
"""
