"""Claims history: what a vehicle or member had in the months before an incident, in one pass over claims and prior claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
BACK_TO_BACK_DAYS = 30
REPEAT_CLAIMS = 3
VEHICLE_MONTHS, MEMBER_MONTHS = 36, 12


def key_of(value: Column) -> Column:
    """A key as both sides compare it: trimmed, upper case; blank is null, which matches nothing."""
    return F.nullif(F.upper(F.trim(value.cast("string"))), F.lit(""))


def _day_number(day: Column) -> Column:
    """Days in order, 32 to a month: so many months earlier is so many times 32 less, whatever the months' lengths."""
    return (F.year(day) * 12 + F.month(day)) * 32 + F.dayofmonth(day)


def before_incidents(claims: DataFrame, history: DataFrame, key: str, months: int) -> DataFrame:
    """A row for each key and incident date of claims: _k, _day, n, impact, last_claim_date, first (row_pos, prior_id), latest (claim_date,
    row_pos, prior_id) of the prior claims of the key in the months before, the incident's day excluded.

    Prior claims of a key and day become one row before they move, and so do claims: a key has at most as many rows as the calendar has
    days, however many claims it has. One window a key then looks back by a range of day numbers. 29 February looks back to 28 February
    in years without it, one number more.
    """
    priors = history.select(key_of(F.col(key)).alias("_k"), F.col("claim_date").cast("date").alias("_day"), "row_pos", "prior_id", "ncb_impact").filter("_k IS NOT NULL AND _day IS NOT NULL")
    place = F.struct("row_pos", "prior_id")
    days = priors.groupBy("_k", "_day").agg(F.count("*").alias("n"), F.count_if("ncb_impact").alias("impact"), F.min(place).alias("first"), F.max(place).alias("latest"))
    asks = claims.select(key_of(F.col(key)).alias("_k"), F.col("incident_date").cast("date").alias("_day")).filter("_k IS NOT NULL AND _day IS NOT NULL").distinct()
    both = days.withColumns({"latest": F.struct(F.col("_day").alias("claim_date"), "latest.row_pos", "latest.prior_id"), "asked": F.lit(False)})
    both = both.unionByName(asks.withColumn("asked", F.lit(True)), allowMissingColumns=True).withColumn("_at", _day_number(F.col("_day")))
    by = Window.partitionBy("_k").orderBy("_at")
    leap = (F.month("_day") == 2) & (F.dayofmonth("_day") == 29)
    back = lambda f, c: F.when(leap, f(c).over(by.rangeBetween(-32 * months - 1, -1))).otherwise(f(c).over(by.rangeBetween(-32 * months, -1)))
    found = both.select("_k", "_day", "asked", back(F.sum, "n").alias("n"), back(F.sum, "impact").alias("impact"), back(F.min, "first").alias("first"), back(F.max, "latest").alias("latest"))
    return found.filter("asked").select("_k", "_day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("impact", F.lit(0)).alias("impact"), "first", "latest")


def _with(claims: DataFrame, history: DataFrame, key: str, months: int) -> DataFrame:
    """claims with the columns of before_incidents; each claim meets one row. A hot key's claims are many rows against a few, which AQE splits."""
    found = before_incidents(claims, history, key, months)
    return claims.join(found, (key_of(F.col(key)) == F.col("_k")) & (F.col("incident_date").cast("date") == F.col("_day")), "left")


def vehicle_history(claims: DataFrame, history: DataFrame) -> DataFrame:
    """One row a claim: counts and flags of its vehicle's claims in 36 months. An unknown incident date gives history_available false
    and nulls; an unknown vehicle has no prior claim."""
    known = F.col("incident_date").isNotNull()
    last = F.col("latest.claim_date")
    days = F.datediff("incident_date", last)
    return _with(claims, history, "vehicle_reg", VEHICLE_MONTHS).select(
        *[F.col(c) for c in claims.columns], known.alias("history_available"), F.when(known, F.coalesce("n", F.lit(0))).alias("prior_claims_36m_count"), last.alias("last_claim_date"),
        days.alias("days_since_last_claim"), F.when(known, F.coalesce(days <= BACK_TO_BACK_DAYS, F.lit(False))).alias("back_to_back_flag"), F.coalesce("impact", F.lit(0)).alias("ncb_impact_claims"),
        F.col("first.prior_id").alias("first_prior_id"), F.col("latest.prior_id").alias("latest_prior_id"),
    )


def member_history(claims: DataFrame, history: DataFrame) -> DataFrame:
    """claims with the count of their member's claims in 12 months, all vehicles."""
    n = F.when(F.col("incident_date").isNotNull(), F.coalesce("n", F.lit(0)))
    return _with(claims, history, "member_id", MEMBER_MONTHS).select(*[F.col(c) for c in claims.columns], n.alias("prior_claims_12m_count"), (n >= REPEAT_CLAIMS).alias("repeat_claimant_flag"))


def full_history(claims: DataFrame, history: DataFrame) -> DataFrame:
    return member_history(vehicle_history(claims, history), history).withColumn("ncb_discrepancy", ncb_note())


#: What a report shows of a prior claim, where the history has it.
PRIOR_ROW = ("prior_id", "claim_date", "prior_type", "prior_status", "settled_amount", "ncb_impact")


def history_rows(claims: DataFrame, history: DataFrame) -> DataFrame:
    """The prior claims themselves, a row each: claim_id, pos (in the history's order), PRIOR_ROW as far as the history has it. Only the
    report of a case asks for them: here the output is as many rows as claims and prior claims meet, by an equi join with the range as
    residual, so AQE can split a hot vehicle."""
    shown = [c for c in PRIOR_ROW if c in history.columns]
    c = claims.select("claim_id", key_of(F.col("vehicle_reg")).alias("_k"), F.col("incident_date").cast("date").alias("_day"))
    h = history.select(key_of(F.col("vehicle_reg")).alias("_hk"), F.col("claim_date").cast("date").alias("_hd"), "row_pos", *shown)
    met = c.join(h, (F.col("_k") == F.col("_hk")) & (F.col("_hd") < F.col("_day")) & (F.col("_hd") >= F.add_months("_day", -VEHICLE_MONTHS)))
    pos = F.row_number().over(Window.partitionBy("claim_id").orderBy("row_pos")) - 1
    return met.select("claim_id", pos.alias("pos"), *shown)


def ncb_note() -> Column:
    """Null without discrepancy."""
    text = F.concat(F.lit("NCB is "), F.format_string("%.0f", F.col("ncb_percent")), F.lit("% on policy but "), F.col("ncb_impact_claims").cast("string"), F.lit(" recent claim(s) show ncb_impact = TRUE. Verify whether NCB was protected via NCB_PROTECT add-on."))
    return F.when((F.col("ncb_percent") > 0) & (F.col("ncb_impact_claims") > 0), text)
