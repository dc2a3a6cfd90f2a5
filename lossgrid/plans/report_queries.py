"""Queries of the sections of a case's report and of the register's cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import case, intake, pii, reports, triage
from ..sources import bindings as b
from ..sources import matrix
from . import case_queries, intake_queries, text_queries, triage_queries

CARD = {"FNOL": "fnol_id", "Member": "member_id", "Status": "triage_status", "Report": "triage_json_path"}


def escalation_detail(spark, sf):
    """Each condition that a claim meets, in order, with its label, what met it and what the adjuster is to do."""
    return case.escalation_section(triage_queries.assessed(spark, sf))


def history_section(spark, sf):
    return reports.history_pairs(triage_queries.assessed(spark, sf))


def aging_section(spark, sf):
    aged = triage.aging(b.claims(spark, sf).select("claim_id", "received_date"), F.col("received_date").cast("timestamp"), F.lit(case_queries.AS_OF).cast("timestamp"))
    return reports.aging_pairs(aged)


def register_cards(spark, sf):
    """The cards of all records, of every fourth after an update with two reasons."""
    reg = intake_queries.register_update(spark, sf)
    both = F.when(F.col("escalation_reason").isNotNull(), F.concat("escalation_reason", F.lit("|LATE_FNOL_OVER_7_DAYS")))
    return reports.register_cards(reg.withColumn("escalation_reason", both), CARD)


def pending_documents(spark, sf):
    return reports.pending_documents(intake.checklist(intake_queries._gaps(spark, sf)))


def redaction_report(spark, sf):
    """The report of each claim's redaction, its counts of what was found."""
    done = pii.redact(text_queries._pages(spark, sf), scope=("EMAIL_ADDRESS", "CREDIT_CARD"))
    mails = pii.entity_counts(done).filter("entity_type = 'EMAIL_ADDRESS'")
    out = pii.redaction_report(pii.confidence(done), mails)
    return out.select("claim_id", "confidence_score", "icon", "message", F.array_join("entity_lines", "|").alias("lines"))


def _pairs(rows: list[tuple[str, str]], source: str) -> str:
    listed = ", ".join(f"{{'pos': {i}, 'label': '{label}', 'value': {value}}}" for i, (label, value) in enumerate(rows))
    return f"SELECT claim_id, p.pos AS pos, p.label AS label, p.value AS value FROM (SELECT claim_id, unnest([{listed}]) AS p FROM {source})"


def _condition(code: str, test: str, label: str, trigger: str, todo: str) -> str:
    return f"CASE WHEN coalesce({test}, false) THEN {{'code': '{code}', 'label': {label}, 'trigger': {trigger}, 'adjuster_instruction': '{todo}'}} END"


#: Where a document stands among those of its incident type.
_PLACES = ", ".join(f"('{kind.replace('_', '')}', '{document}', {[r[2] for r in matrix.ROWS if r[0] == kind].index(document)})" for kind, _, document, *_ in matrix.ROWS)
_KIND = "replace(upper(trim(coalesce(incident_type, ''))), ' ', '_')"
_CONDITIONS = [
    ("HIGH_VALUE_CLAIM", "idv > 500000 AND incident_type IN ('THEFT_COMPLETE', 'ACCIDENT_WITH_THIRD_PARTY_INJURY', 'FIRE')", "'High-Value Claim'", f"'IDV Rs.' || format('{{:,.0f}}', CAST(idv AS DOUBLE)) || ' > Rs.5,00,000 AND incident type is ' || {_KIND}", "Refer to senior claims manager before proceeding."),
    ("THIRD_PARTY_BODILY_INJURY", "injury_reported = 'Yes'", "'Third-Party Bodily Injury Reported'", "'tp_injury_reported = TRUE on FNOL form'", "Refer to senior claims manager. Do not make any liability statement to claimant. Legal exposure."),
    ("THEFT_WITH_ACTIVE_LOAN", "incident_type = 'THEFT_COMPLETE' AND hypothecated", "'Theft with Active Loan (Hypothecation)'", "'incident_type = THEFT_COMPLETE AND hypothecated = TRUE'", "Financer notification required. NOC must be obtained. Refer to senior."),
    ("INCIDENT_IN_WAITING_PERIOD", "days >= 0 AND days < 30", "'Incident in Mandatory Waiting Period'", "'days_since_inception = ' || days || ' < waiting_period_days = 30'", "Do not communicate any coverage finding. Senior review mandatory."),
    ("BACK_TO_BACK_CLAIMS", "s1", "'Back-to-Back Claims'", "'days_since_last_claim = ' || days_last || ' (threshold: 30 or fewer days)'", "Senior review required before proceeding."),
    ("LATE_FNOL_OVER_7_DAYS", "late > 7", "'Late FNOL — Over 7 Days'", "'FNOL received ' || late || ' days after incident date'", "Request written explanation from claimant. Refer to senior."),
    ("LEGAL_NOTICE_OR_TRIBUNAL", "legal_notice = 'true'", "'Legal Notice or Tribunal Reference'", "'legal_notice_present = TRUE on FNOL form'", "Immediate hold. Do not contact claimant without legal team approval."),
    ("INCIDENT_BEFORE_POLICY_START", "days < 0", "'Incident Before Policy Start Date'", "'incident_date < policy_inception_date'", "Critical exception. Immediate hold. Do not communicate anything."),
    ("POLICY_NOT_FOUND", "policy_status IN ('LAPSED', 'CANCELLED')", "'Policy Status: ' || policy_status", "'policy_status = ' || policy_status", "Immediate hold. All coverage sections unavailable. Verify with underwriting."),
    ("REPEAT_CLAIMANT", "s2", "'Repeat Claimant'", "'prior_claims_12m = ' || m || ' (threshold: 3 or more)'", "Surface to senior for awareness. Does not block triage independently."),
    ("ELEVATED_REVIEW_INDICATORS", "band = 'HIGH'", "'Elevated Review Indicators'", "'fraud_signals.band = HIGH (score = ' || score || ')'", "Refer to SIU for review. Does not by itself constitute a finding."),
]
_AGED = f"(epoch_us(TIMESTAMP '{case_queries.AS_OF}') - epoch_us(CAST(received_date AS TIMESTAMP))) / 3600000000.0"
SQL = {
    "escalation_detail": triage_queries._HIST + ", c AS (SELECT claim_id, list_filter([" + ", ".join(_condition(*c) for c in _CONDITIONS) + """], lambda x: x IS NOT NULL) AS l FROM scored),
        e AS (SELECT claim_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c)
        SELECT claim_id, CAST(i - 1 AS INTEGER) AS pos, x.code AS code, x.label AS label, x.trigger AS trigger, x.adjuster_instruction AS adjuster_instruction FROM e""",
    "history_section": triage_queries._HIST + _pairs([
        ("Prior claims on this vehicle (36 months)", "CAST(n AS VARCHAR)"), ("Last claim date", "coalesce(CAST(last_claim_date AS VARCHAR), 'None')"), ("Days since last claim", "coalesce(CAST(days_last AS VARCHAR), 'N/A')"),
        ("Back-to-back flag", f"CASE WHEN s1 THEN '{reports.ACTIVE_30}' ELSE '{reports.NOT_TRIGGERED}' END"), ("12-month cross-policy claims", "CAST(m AS VARCHAR)"), ("Repeat claimant flag", f"CASE WHEN s2 THEN '{reports.ACTIVE_3}' ELSE '{reports.NOT_TRIGGERED}' END"),
        ("NCB cross-check", f"CASE WHEN ncb_percent > 0 AND impact > 0 THEN 'NCB is ' || CAST(CAST(ncb_percent AS INTEGER) AS VARCHAR) || '% on policy but ' || impact || ' recent claim(s) show ncb_impact = TRUE. Verify whether NCB was protected via NCB_PROTECT add-on.' ELSE '{reports.NO_DISCREPANCY}' END"),
    ], "sig"),
    "aging_section": b.SQL + f", aged AS (SELECT claim_id, received_date, {_AGED} AS h FROM claims) " + _pairs([
        ("FNOL Age (hours)", "CAST(round(h, 2) AS VARCHAR)"), ("Risk Level", "CASE WHEN h < 6 THEN 'LOW' WHEN h < 18 THEN 'MEDIUM' WHEN h < 24 THEN 'HIGH' ELSE 'CRITICAL' END"),
        ("SLA Due", "strftime(CAST(received_date AS TIMESTAMP) + INTERVAL 24 HOUR, '%d-%b-%Y %H:%M')"), ("SLA Breached", "CAST(h > 24 AS VARCHAR)"),
    ], "aged"),
    "register_cards": intake_queries._REG + """, l AS (SELECT fnol_id, list_concat([{'label': 'FNOL', 'value': fnol_id}, {'label': 'Member', 'value': CAST(member_id AS VARCHAR)}, {'label': 'Status', 'value': CASE WHEN k % 4 = 0 THEN 'ESCALATED' ELSE 'PENDING' END},
          {'label': 'Report', 'value': CASE WHEN k % 4 = 0 THEN fnol_id || '.json' ELSE '—' END}], CASE WHEN k % 4 = 0 THEN [{'label': 'Escalation', 'value': 'REPEAT_CLAIMANT'}, {'label': 'Escalation', 'value': 'LATE_FNOL_OVER_7_DAYS'}] ELSE [] END) AS l FROM reg),
        e AS (SELECT fnol_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l) SELECT fnol_id, CAST(i - 1 AS INTEGER) AS pos, x.label AS label, x.value AS value FROM e""",
    "pending_documents": intake_queries._GAP + f""", o AS (SELECT * FROM (VALUES {_PLACES}) AS t(kind, document, pos))
        SELECT claim_id, CAST(pos AS INTEGER) AS pos, document AS name, criticality = 'BLOCKING' AS blocking, collection_by AS collection_target FROM g JOIN o USING (kind, document) WHERE NOT received""",
    "redaction_report": f"""WITH conf AS ({text_queries.SQL["redaction_confidence"]}), mails AS (SELECT c_custkey % 200 AS claim_id, count(*) AS n FROM customer GROUP BY 1)
        SELECT claim_id, confidence_score, CASE proceed_status WHEN 'PROCEED' THEN 'ok' WHEN 'WARN' THEN 'warn' ELSE 'stop' END AS icon,
          CASE proceed_status WHEN 'PROCEED' THEN 'Redaction complete' WHEN 'WARN' THEN 'Redaction complete, review advised' ELSE 'Held: redaction confidence is too low' END AS message, 'EMAIL_ADDRESS: ' || n AS lines
        FROM conf JOIN mails USING (claim_id)""",
}
QUERIES = {k: globals()[k] for k in SQL}
