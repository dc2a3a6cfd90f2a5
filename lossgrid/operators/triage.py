"""Triage rules: waiting period, escalation, aging, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import incident_key, says_yes

#: Fixed values.
HIGH_VALUE = 500_000
HIGH_VALUE_TYPES = ("THEFT_COMPLETE", "ACCIDENT_WITH_THIRD_PARTY_INJURY", "FIRE")
ENDED = ("LAPSED", "CANCELLED")
LATE_DAYS = 7
DEFAULT_WAITING_DAYS = 30


def waiting_period(df: DataFrame) -> DataFrame:
    """df with the waiting-period columns; reads policy_inception, incident_date and waiting_period_days (null or 0: 30)."""
    days = F.datediff("incident_date", "policy_inception")
    wait = F.coalesce(F.nullif(F.col("waiting_period_days"), F.lit(0)), F.lit(DEFAULT_WAITING_DAYS))
    active = F.coalesce((days >= 0) & (days < wait), F.lit(False))
    before = F.coalesce(days < 0, F.lit(False))
    n, w = days.cast("string"), wait.cast("string")
    note = (
        F.when(days.isNull(), "Could not parse dates for waiting period calculation.")
        .when(before, "Incident date is before policy inception. Critical exception — immediate hold.")
        .when(active, F.concat(F.lit("WAITING PERIOD ACTIVE — incident occurred "), n, F.lit(" days after inception. Mandatory waiting period is "), w, F.lit(" days.")))
        .otherwise(F.concat(F.lit("Waiting period has elapsed. Policy has been in force for "), n, F.lit(" days at the incident date.")))
    )
    return df.withColumns({"waiting_days": wait, "days_since_inception": days, "waiting_period_active": active, "incident_pre_inception": before, "waiting_confidence": F.when(days.isNull(), "LOW").otherwise("HIGH"), "waiting_note": note})


def expiry_warning(policy: Column, expiry: Column, incident: Column, incident_day: Column, expiry_day: Column) -> Column:
    """Null unless the incident is after expiry; policy, expiry and incident are shown as text."""
    text = F.concat(F.lit("Policy "), policy, F.lit(" expired "), expiry, F.lit(". Incident date "), incident, F.lit(" is after expiry. Coverage requires renewal verification."))
    return F.when(incident_day > expiry_day, text)


def conditions() -> list[tuple[str, Column, Column, Column, str]]:
    """Escalation in order: code, test, label, trigger text, instruction. Reads the columns of waiting_period(), of
    the history operators, band and score of the signals, and the claim's own."""
    kind = incident_key(F.col("incident_type"))
    idv = F.coalesce(F.col("idv").cast("double"), F.lit(0.0))
    status = F.upper(F.coalesce("policy_status", F.lit("")))
    late = F.datediff("received_date", "incident_date")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")
    return [
        ("HIGH_VALUE_CLAIM", (idv > HIGH_VALUE) & kind.isin(*HIGH_VALUE_TYPES), F.lit("High-Value Claim"), text("IDV Rs.", F.format_number(idv, 0), " > Rs.5,00,000 AND incident type is ", kind), "Refer to senior claims manager before proceeding."),
        ("THIRD_PARTY_BODILY_INJURY", says_yes(F.col("injury_reported")), F.lit("Third-Party Bodily Injury Reported"), F.lit("tp_injury_reported = TRUE on FNOL form"), "Refer to senior claims manager. Do not make any liability statement to claimant. Legal exposure."),
        ("THEFT_WITH_ACTIVE_LOAN", (kind == "THEFT_COMPLETE") & F.col("hypothecated"), F.lit("Theft with Active Loan (Hypothecation)"), F.lit("incident_type = THEFT_COMPLETE AND hypothecated = TRUE"), "Financer notification required. NOC must be obtained. Refer to senior."),
        ("INCIDENT_IN_WAITING_PERIOD", F.col("waiting_period_active"), F.lit("Incident in Mandatory Waiting Period"), text("days_since_inception = ", num("days_since_inception"), " < waiting_period_days = ", num("waiting_days")), "Do not communicate any coverage finding. Senior review mandatory."),
        ("BACK_TO_BACK_CLAIMS", F.col("back_to_back_flag"), F.lit("Back-to-Back Claims"), text("days_since_last_claim = ", num("days_since_last_claim"), " (threshold: 30 or fewer days)"), "Senior review required before proceeding."),
        ("LATE_FNOL_OVER_7_DAYS", late > LATE_DAYS, F.lit("Late FNOL — Over 7 Days"), text("FNOL received ", late.cast("string"), " days after incident date"), "Request written explanation from claimant. Refer to senior."),
        ("LEGAL_NOTICE_OR_TRIBUNAL", says_yes(F.col("legal_notice")), F.lit("Legal Notice or Tribunal Reference"), F.lit("legal_notice_present = TRUE on FNOL form"), "Immediate hold. Do not contact claimant without legal team approval."),
        ("INCIDENT_BEFORE_POLICY_START", F.col("incident_pre_inception"), F.lit("Incident Before Policy Start Date"), F.lit("incident_date < policy_inception_date"), "Critical exception. Immediate hold. Do not communicate anything."),
        ("POLICY_NOT_FOUND", status.isin(*ENDED), text("Policy Status: ", status), text("policy_status = ", status), "Immediate hold. All coverage sections unavailable. Verify with underwriting."),
        ("REPEAT_CLAIMANT", F.col("repeat_claimant_flag"), F.lit("Repeat Claimant"), text("prior_claims_12m = ", num("prior_claims_12m_count"), " (threshold: 3 or more)"), "Surface to senior for awareness. Does not block triage independently."),
        ("ELEVATED_REVIEW_INDICATORS", F.col("band") == "HIGH", F.lit("Elevated Review Indicators"), text("fraud_signals.band = HIGH (score = ", num("score"), ")"), "Refer to SIU for review. Does not by itself constitute a finding."),
    ]


def escalation(df: DataFrame) -> DataFrame:
    """df with triggered (structs in order), escalation_flag and escalation_reason (codes joined by pipe, else null)."""
    made = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), label.alias("label"), trigger.alias("trigger"), F.lit(todo).alias("adjuster_instruction"))) for code, test, label, trigger, todo in conditions()]
    out = df.withColumn("triggered", F.filter(F.array(*made), lambda x: x.isNotNull()))
    flag = F.size("triggered") > 0
    return out.withColumns({"escalation_flag": flag, "escalation_reason": F.when(flag, F.array_join(F.transform("triggered", lambda x: x["code"]), "|"))})


def aging(df: DataFrame, received: Column, as_of: Column) -> DataFrame:
    """df with the age in hours at as_of, its level, when it is due and whether that is over. Unknown receipt: level UNKNOWN, age 0."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(received.cast("timestamp"))) / F.lit(3_600_000_000.0)
    level = F.when(received.isNull(), "UNKNOWN").when(hours < 6, "LOW").when(hours < 18, "MEDIUM").when(hours < 24, "HIGH").otherwise("CRITICAL")
    return df.withColumns({
        "fnol_age_hours": F.coalesce(F.round(hours, 2), F.lit(0.0)), "aging_risk_level": level,
        "sla_due": F.date_format(received + F.expr("INTERVAL 24 HOURS"), "dd-MMM-yyyy HH:mm"), "sla_breached": F.coalesce(hours > 24, F.lit(False)),
    })


def status(policy_status: Column, escalated: Column, critical_missing: Column) -> Column:
    return (
        F.when(F.upper(F.coalesce(policy_status, F.lit(""))).isin(*ENDED), "EXCEPTION_RAISED").when(escalated, "ESCALATED").when(critical_missing, "PENDED_FOR_INPUTS").otherwise("COMPLETE")
    )
