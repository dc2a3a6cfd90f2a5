"""What the printed triage report shows, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_LINES = 25


def side_by_side(pages: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """pages (claim_id, page_num, text) in blocks of lines: claim_id, page_num, block, n_lines, text."""
    each = pages.select("claim_id", "page_num", F.split("text", "\n").alias("l"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int"))
    part = F.slice("l", F.col("block") * lines + 1, lines)
    return each.withColumn("block", F.explode(blocks)).select("claim_id", "page_num", "block", F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("text"))


def summary_lines(summaries: DataFrame) -> DataFrame:
    """summaries (id, text): each non-blank line as opening, bullet or sub, with its mark cut off. The first unmarked line is
    the opening; later unmarked ones are bullets."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(x.rlike("^[•\\-*–]"), "bullet").when(x.rlike(r"^\d[.):]"), "sub").otherwise("plain")
    rows = summaries.select("id", F.posexplode(F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("line")))).alias("pos", "l")).select("id", "pos", "l.*")
    from pyspark.sql import Window

    plain = F.sum((F.col("kind") == "plain").cast("int")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    text = F.when(F.col("kind") == "bullet", F.trim(F.regexp_replace("line", "^[•\\-*– ]+", ""))).when(F.col("kind") == "sub", F.trim(F.regexp_replace("line", r"^\d+[.):] *", ""))).otherwise(F.col("line"))
    return rows.select("id", "pos", F.when(F.col("kind") != "plain", F.col("kind")).when(plain == 1, "opening").otherwise("bullet").alias("kind"), text.alias("text"))


#: Label and column of the snapshot and the waiting-period sections.
SECTIONS = {
    "snapshot": [("Member ID", "member_id"), ("Policy Number", "policy_number"), ("Vehicle Registration", "vehicle_reg"), ("Incident Type", "incident_type"), ("Incident Date", "incident_date"), ("Policy Status", "policy_status"), ("Policy Inception", "policy_inception"), ("Policy Expiry", "policy_expiry")],
    "waiting period": [("Policy Inception", "policy_inception"), ("Waiting Period Days", "waiting_days"), ("Incident Date", "incident_date"), ("Days Since Inception", "days_since_inception"), ("Waiting Period Active", "waiting_period_active"), ("Incident Pre-Inception", "incident_pre_inception")],
    "history": [("Claims in 36 months", "prior_claims_36m_count"), ("Last Claim", "last_claim_date"), ("Days Since Last Claim", "days_since_last_claim"), ("Back to Back", "back_to_back_flag"), ("Claims in 12 months", "prior_claims_12m_count"), ("Repeat Claimant", "repeat_claimant_flag")],
    "indicators": [("Score", "score"), ("Band", "band"), ("Confidence", "confidence")],
    "escalation": [("Escalated", "escalation_flag"), ("Reason", "escalation_reason")],
}


def sections(assessed: DataFrame) -> DataFrame:
    """Label and value pairs of the report: claim_id, section, pos, label, value. A missing value is a dash."""
    pairs = [F.struct(F.lit(s).alias("section"), F.lit(i).alias("pos"), F.lit(label).alias("label"), F.coalesce(F.col(c).cast("string"), F.lit("—")).alias("value")) for s, rows in SECTIONS.items() for i, (label, c) in enumerate(rows)]
    return assessed.select("claim_id", F.explode(F.array(*pairs)).alias("p")).select("claim_id", "p.*")


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """snapshots (of case.snapshot, with fnol_age_hours and aging_risk_level of triage.aging) as the 18 label and value pairs of the
    snapshot section: claim_id, pos, label, value; left and right column in turn. A missing value is empty, or as its pair says."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = lambda c, none: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    minute = lambda c: F.substring(text(c), 1, 16)
    hours = F.bround(F.coalesce("fnol_age_hours", F.lit(0.0)), 0).cast("long").cast("string")
    amount = F.regexp_replace(F.format_number(F.coalesce(F.col("idv_inr").cast("double"), F.lit(0.0)), 2), r"\.00$", "")
    #: The labels and the words around values.
    pairs = [
        ("FNOL ID", text("claim_id")),
        ("Aging Risk", F.concat(text("aging_risk_level"), F.lit(" ("), hours, F.lit(" hours)"))),
        ("Member ID", text("member_id")),
        ("Policy Number", text("policy_number")),
        ("Vehicle", text("vehicle")),
        ("Insurer", text("insurer")),
        ("Incident Type", F.initcap(F.replace(F.lower(text("incident_type")), F.lit("_"), F.lit(" ")))),
        ("Incident Date", minute("incident_date")),
        ("Incident Location", text("incident_location")),
        ("FNOL Received", minute("fnol_received_at")),
        ("Coverage Type", text("coverage_type")),
        ("IDV", F.concat(F.lit("Rs."), amount)),
        ("NCB at Inception", F.concat(known("ncb_percent", "0"), F.lit("%"))),
        ("Add-ons", F.when(F.size("addons") > 0, F.array_join("addons", " | ")).otherwise("None")),
        ("Hypothecated", F.when(F.col("hypothecated"), "Yes").otherwise("No")),
        ("Financer", known("financer_name", "None")),
        ("Policy Status", text("policy_status")),
        ("Policy Expiry", text("policy_expiry")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(pairs)])
    return snapshots.select("claim_id", F.explode(rows).alias("p")).select("claim_id", "p.*")


def _rows(df: DataFrame, pairs: list[tuple[str, F.Column]]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(pairs)])
    return df.select("claim_id", F.explode(each).alias("p")).select("claim_id", "p.*")


#: How the history section says that a flag is up or down.
ACTIVE_30, ACTIVE_3, NOT_TRIGGERED, NO_DISCREPANCY = "ACTIVE — prior claim within 30 days", "ACTIVE (threshold: 3+)", "Not triggered", "No discrepancy found"


def history_pairs(assessed: DataFrame) -> DataFrame:
    """The seven pairs of the history section of claims with their history: claim_id, pos, label, value. What is not known reads None or N/A."""
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    flag = lambda c, up: F.when(F.col(c), up).otherwise(NOT_TRIGGERED)
    return _rows(assessed, [
        ("Prior claims on this vehicle (36 months)", text("prior_claims_36m_count", "0")), ("Last claim date", text("last_claim_date", "None")), ("Days since last claim", text("days_since_last_claim", "N/A")),
        ("Back-to-back flag", flag("back_to_back_flag", ACTIVE_30)), ("12-month cross-policy claims", text("prior_claims_12m_count", "0")), ("Repeat claimant flag", flag("repeat_claimant_flag", ACTIVE_3)),
        ("NCB cross-check", text("ncb_discrepancy", NO_DISCREPANCY)),
    ])


def aging_pairs(cases: DataFrame) -> DataFrame:
    """The four pairs of the aging section of cases after triage.aging."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return _rows(cases, [("FNOL Age (hours)", text("fnol_age_hours")), ("Risk Level", text("aging_risk_level")), ("SLA Due", text("sla_due")), ("SLA Breached", text("sla_breached"))])


def register_cards(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """What the register shows of each record: its fields (label to column) as pairs, a dash for what is missing, and after them a pair for each reason
    of escalation: fnol_id, pos, label, value."""
    said = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—")).alias("value")) for label, c in fields.items()])
    reasons = F.when(F.coalesce("escalation_reason", F.lit("")) != "", F.split("escalation_reason", r"\|")).otherwise(F.array().cast("array<string>"))
    shown = F.concat(said, F.transform(reasons, lambda r: F.struct(F.lit("Escalation").alias("label"), r.alias("value"))))
    return records.select("fnol_id", F.posexplode(shown).alias("pos", "p")).select("fnol_id", "pos", "p.*")


def pending_documents(checklist: DataFrame) -> DataFrame:
    """Of each claim's checklist what is not there, with when it is due, in order: claim_id, pos, name, blocking, collection_target."""
    return checklist.filter("NOT received").select("claim_id", "pos", "name", "blocking", "collection_target")
