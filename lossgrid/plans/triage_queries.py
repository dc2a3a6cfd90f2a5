"""Queries over the bound claim tables: history, waiting period, signals, escalation, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, signals, triage
from ..sources import bindings as b


def assessed(spark, sf: str) -> DataFrame:
    """Each claim with all that the rules say: one wide plan, history computed once."""
    base = history.full_history(b.claims(spark, sf), b.history(spark, sf))
    return triage.escalation(signals.evaluate(triage.waiting_period(base)))


def claims_history_36m(spark, sf):
    out = history.vehicle_history(b.claims(spark, sf), b.history(spark, sf))
    return out.select("claim_id", "prior_claims_36m_count", "last_claim_date", "days_since_last_claim", "back_to_back_flag", "ncb_impact_claims", "first_prior_id", "latest_prior_id")


def claims_history_12m(spark, sf):
    return history.member_history(b.claims(spark, sf), b.history(spark, sf)).select("claim_id", "prior_claims_12m_count", "repeat_claimant_flag")


def ncb_discrepancy(spark, sf):
    out = history.vehicle_history(b.claims(spark, sf), b.history(spark, sf))
    return out.select("claim_id", history.ncb_note().alias("ncb_discrepancy")).filter("ncb_discrepancy IS NOT NULL")


def event_range_join(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "user_id", "ts")
    p = e.select(F.col("event_id").alias("prior_event"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    out = e.join(p, (F.col("user_id") == F.col("u")) & (F.col("t") < F.col("ts")) & (F.col("t") >= F.col("ts") - F.expr("INTERVAL 3 DAYS")))
    return out.groupBy("event_id").agg(F.count("*").alias("prior_events"), F.max("t").alias("last_ts"))


def waiting_period(spark, sf):
    return triage.waiting_period(b.claims(spark, sf)).select("claim_id", "waiting_days", "days_since_inception", "waiting_period_active", "incident_pre_inception", "waiting_confidence", "waiting_note")


def policy_expiry_warning(spark, sf):
    shown = lambda c: F.col(c).cast("string")
    c = b.claims(spark, sf)
    return c.select("claim_id", triage.expiry_warning(shown("policy_number"), shown("policy_expiry"), shown("incident_date"), F.col("incident_date"), F.col("policy_expiry")).alias("policy_expiry_warning")).filter("policy_expiry_warning IS NOT NULL")


def signals_long(spark, sf):
    return signals.rows(_ready(spark, sf), "claim_id")


def _ready(spark, sf):
    """Claims with all that the signals read."""
    return triage.waiting_period(history.full_history(b.claims(spark, sf), b.history(spark, sf)))


def _scored(spark, sf):
    return signals.evaluate(_ready(spark, sf))


def signal_score_band(spark, sf):
    return _scored(spark, sf).select("claim_id", "score", "band", "n_triggered")


def signal_confidence(spark, sf):
    return _scored(spark, sf).groupBy("band", "confidence").agg(F.count("*").alias("claims"), F.sum("incomplete").alias("incomplete"))


def adjuster_summary(spark, sf):
    return _scored(spark, sf).select("claim_id", "adjuster_summary")


def indicator_banner(spark, sf):
    out = _scored(spark, sf).filter(F.col("band").isin("MEDIUM", "HIGH"))
    return out.select("claim_id", "band", "score", signals.codes().alias("codes"))


def escalation_codes(spark, sf):
    return assessed(spark, sf).select("claim_id", "escalation_flag", "escalation_reason", F.size("triggered").alias("n_conditions"))


def triage_status(spark, sf):
    missing = F.col("claim_id") % 4 == 0
    out = assessed(spark, sf).withColumn("triage_status", triage.status(F.col("policy_status"), F.col("escalation_flag"), missing))
    return out.groupBy("triage_status", "incident_type").agg(F.count("*").alias("claims"), F.sum("score").alias("score"))


def aging_risk(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "ts")
    out = triage.aging(e, F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return out.select("event_id", "fnol_age_hours", "aging_risk_level", "sla_due", "sla_breached")


_HIST = b.SQL + """
, h36 AS (
  SELECT c.claim_id, count(h.prior_id) AS n, max(h.claim_date) AS last_claim_date, count(*) FILTER (WHERE h.ncb_impact) AS impact,
         arg_min(h.prior_id, h.row_pos) AS first_prior_id, arg_max(h.prior_id, (h.claim_date, h.row_pos)) AS latest_prior_id
  FROM claims c LEFT JOIN history h ON c.vehicle_reg = h.vehicle_reg AND h.claim_date < c.incident_date AND h.claim_date >= CAST(c.incident_date - INTERVAL 36 MONTH AS DATE)
  GROUP BY c.claim_id
), h12 AS (
  SELECT c.claim_id, count(h.prior_id) AS m
  FROM claims c LEFT JOIN history h ON c.member_id = h.member_id AND h.claim_date < c.incident_date AND h.claim_date >= CAST(c.incident_date - INTERVAL 12 MONTH AS DATE)
  GROUP BY c.claim_id
), wide AS (
  SELECT c.*, n, last_claim_date, CAST(c.incident_date - last_claim_date AS INTEGER) AS days_last, impact, m,
         CAST(c.incident_date - policy_inception AS INTEGER) AS days, CAST(received_date - incident_date AS INTEGER) AS late
  FROM claims c JOIN h36 USING (claim_id) JOIN h12 USING (claim_id)
), sig AS (
  SELECT *,
    coalesce(days_last <= 30, false) AS s1, m >= 3 AS s2, days < 0 OR days BETWEEN 0 AND 45 AS s3, ncb_percent > 0 AND impact > 0 AS s4,
    hypothecation_rc IS NOT NULL AND (upper(hypothecation_rc) NOT IN ('NONE', 'NIL', 'NA', 'N/A', '')) <> hypothecated AS s5,
    authorised_classes IS NOT NULL AND vehicle_class_rc IS NOT NULL AS both_classes,
    coalesce(authorised_classes IS NOT NULL AND vehicle_class_rc IS NOT NULL AND NOT list_has_any(regexp_extract_all(upper(authorised_classes), '[A-Z0-9]+'), regexp_extract_all(upper(vehicle_class_rc), '[A-Z0-9]+')), false) AS s6,
    coalesce(owner_differs, false) AS s7, late > 7 AS s8, n_failed > 0 AS s9, judged AND v_narrative AS s10, incident_type = 'THEFT_COMPLETE' AND judged AND v_key AS s11, judged AND v_damage AS s12
  FROM wide
), flat AS (
  SELECT *, 3 * s1::INT + s2::INT + 3 * s3::INT + s4::INT + coalesce(s5, false)::INT + 3 * s6::INT + 3 * s7::INT + s8::INT + s9::INT + 3 * s10::INT + s11::INT + s12::INT AS score,
    s1::INT + s2::INT + s3::INT + s4::INT + coalesce(s5, false)::INT + s6::INT + s7::INT + s8::INT + s9::INT + s10::INT + s11::INT + s12::INT AS n_triggered,
    (hypothecation_rc IS NULL)::INT + (NOT both_classes)::INT + (owner_differs IS NULL)::INT + (NOT judged)::INT + (incident_type = 'THEFT_COMPLETE' AND NOT judged)::INT + (NOT judged)::INT AS incomplete
  FROM sig
), scored AS (
  SELECT *, CASE WHEN score <= 2 THEN 'LOW' WHEN score <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS band,
    CASE WHEN incomplete = 0 THEN 'HIGH' WHEN incomplete <= 3 THEN 'MODERATE' ELSE 'LOW' END AS confidence
  FROM flat
), esc AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN idv > 500000 AND incident_type IN ('THEFT_COMPLETE', 'ACCIDENT_WITH_THIRD_PARTY_INJURY', 'FIRE') THEN 'HIGH_VALUE_CLAIM' END,
    CASE WHEN injury_reported = 'Yes' THEN 'THIRD_PARTY_BODILY_INJURY' END,
    CASE WHEN incident_type = 'THEFT_COMPLETE' AND hypothecated THEN 'THEFT_WITH_ACTIVE_LOAN' END,
    CASE WHEN days >= 0 AND days < 30 THEN 'INCIDENT_IN_WAITING_PERIOD' END,
    CASE WHEN s1 THEN 'BACK_TO_BACK_CLAIMS' END,
    CASE WHEN late > 7 THEN 'LATE_FNOL_OVER_7_DAYS' END,
    CASE WHEN legal_notice = 'true' THEN 'LEGAL_NOTICE_OR_TRIBUNAL' END,
    CASE WHEN days < 0 THEN 'INCIDENT_BEFORE_POLICY_START' END,
    CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'POLICY_NOT_FOUND' END,
    CASE WHEN s2 THEN 'REPEAT_CLAIMANT' END,
    CASE WHEN band = 'HIGH' THEN 'ELEVATED_REVIEW_INDICATORS' END], lambda x: x IS NOT NULL), '|') AS codes
  FROM scored
)
"""
_CODES = ("BACK_TO_BACK_CLAIMS", "REPEAT_CLAIMANT", "BIND_AND_GRIND", "NCB_DISCREPANCY", "HYPOTHECATION_INCONSISTENCY", "DL_CLASS_MISMATCH", "OWNER_NAME_MISMATCH", "LATE_REPORTING", "CROSS_DOC_FIELD_MISMATCH", "NARRATIVE_COHERENCE", "KEY_STATUS_CONCERN", "DAMAGE_SEVERITY_PLAUSIBILITY")
_COMPLETE = ("true", "true", "true", "true", "hypothecation_rc IS NOT NULL", "both_classes", "owner_differs IS NOT NULL", "true", "true", "judged", "incident_type <> 'THEFT_COMPLETE' OR judged", "judged")
_LONG = " UNION ALL ".join(f"SELECT claim_id, '{c}' AS code, CASE WHEN coalesce(s{i}, false) THEN {3 if i in (1, 3, 6, 7, 10) else 1} ELSE 0 END AS weight, coalesce(s{i}, false) AS triggered, {d} AS data_complete FROM sig" for i, (c, d) in enumerate(zip(_CODES, _COMPLETE), 1))
_LISTED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN s{i} THEN '{c}' END" for i, c in enumerate(_CODES, 1)) + "], lambda x: x IS NOT NULL), '|')"

SQL = {
    "claims_history_36m": _HIST + "SELECT c.claim_id, n AS prior_claims_36m_count, last_claim_date, CAST(c.incident_date - last_claim_date AS INTEGER) AS days_since_last_claim, coalesce(c.incident_date - last_claim_date <= 30, false) AS back_to_back_flag, impact AS ncb_impact_claims, first_prior_id, latest_prior_id FROM claims c JOIN h36 USING (claim_id)",
    "claims_history_12m": _HIST + "SELECT claim_id, m AS prior_claims_12m_count, m >= 3 AS repeat_claimant_flag FROM h12",
    "ncb_discrepancy": _HIST + "SELECT claim_id, 'NCB is ' || CAST(CAST(ncb_percent AS INTEGER) AS VARCHAR) || '% on policy but ' || impact || ' recent claim(s) show ncb_impact = TRUE. Verify whether NCB was protected via NCB_PROTECT add-on.' AS ncb_discrepancy FROM wide WHERE ncb_percent > 0 AND impact > 0",
    "event_range_join": "SELECT e.event_id, count(*) AS prior_events, max(p.ts) AS last_ts FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 3 DAY GROUP BY e.event_id",
    "waiting_period": _HIST + """SELECT claim_id, waiting_period_days AS waiting_days, days AS days_since_inception, days >= 0 AND days < 30 AS waiting_period_active, days < 0 AS incident_pre_inception, 'HIGH' AS waiting_confidence,
        CASE WHEN days < 0 THEN 'Incident date is before policy inception. Critical exception — immediate hold.'
             WHEN days < 30 THEN 'WAITING PERIOD ACTIVE — incident occurred ' || days || ' days after inception. Mandatory waiting period is 30 days.'
             ELSE 'Waiting period has elapsed. Policy has been in force for ' || days || ' days at the incident date.' END AS waiting_note FROM wide""",
    "policy_expiry_warning": b.SQL + "SELECT claim_id, 'Policy ' || policy_number || ' expired ' || policy_expiry || '. Incident date ' || incident_date || ' is after expiry. Coverage requires renewal verification.' AS policy_expiry_warning FROM claims WHERE incident_date > policy_expiry",
    "signals_long": _HIST + _LONG,
    "signal_score_band": _HIST + "SELECT claim_id, score, band, n_triggered FROM scored",
    "signal_confidence": _HIST + "SELECT band, confidence, count(*) AS claims, CAST(sum(incomplete) AS BIGINT) AS incomplete FROM scored GROUP BY band, confidence",
    "adjuster_summary": _HIST + """SELECT claim_id, n_triggered || ' of 12 elevated-review indicators are present — Confidence: ' || confidence || '.' || CASE band WHEN 'HIGH' THEN ' Recommend referral to SIU for further review. Adjuster to determine next steps.'
        WHEN 'MEDIUM' THEN ' Review the indicator list before proceeding. Does not independently escalate.' ELSE ' No action required beyond standard triage.' END AS adjuster_summary FROM scored""",
    "indicator_banner": _HIST + f"SELECT claim_id, band, score, {_LISTED} AS codes FROM scored WHERE band IN ('MEDIUM', 'HIGH')",
    "escalation_codes": _HIST + "SELECT claim_id, codes <> '' AS escalation_flag, nullif(codes, '') AS escalation_reason, CASE WHEN codes = '' THEN 0 ELSE CAST(len(string_split(codes, '|')) AS INTEGER) END AS n_conditions FROM esc",
    "triage_status": _HIST + "SELECT CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'EXCEPTION_RAISED' WHEN codes <> '' THEN 'ESCALATED' WHEN claim_id % 4 = 0 THEN 'PENDED_FOR_INPUTS' ELSE 'COMPLETE' END AS triage_status, incident_type, count(*) AS claims, CAST(sum(score) AS BIGINT) AS score FROM esc GROUP BY ALL",
    "aging_risk": """WITH a AS (SELECT event_id, ts, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 3600000000.0 AS h FROM events)
        SELECT event_id, round(h, 2) AS fnol_age_hours, CASE WHEN h < 6 THEN 'LOW' WHEN h < 18 THEN 'MEDIUM' WHEN h < 24 THEN 'HIGH' ELSE 'CRITICAL' END AS aging_risk_level, strftime(ts + INTERVAL 24 HOUR, '%d-%b-%Y %H:%M') AS sla_due, h > 24 AS sla_breached FROM a""",
}
QUERIES = {k: globals()[k] for k in SQL}
