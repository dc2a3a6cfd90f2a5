"""Queries of whole cases over the bound claim tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import case, coverage, register, reports, retrieval, triage
from ..sources import bindings as b
from . import intake_queries, text_queries, triage_queries

AS_OF = "1995-06-17 12:00:00"


def _found(spark, sf):
    """Claims with their policies; of a fourth the register lacks the member, of a fifth it has no add-ons."""
    c = b.claims(spark, sf)
    k = F.col("claim_id")
    policies = c.select(
        "policy_number", F.concat(F.lit("V"), "vehicle_reg").alias("vehicle_reg"), F.when(k % 4 != 0, F.concat(F.lit("M"), "member_id")).alias("member_id"), F.concat(F.lit("Make"), k % 5).alias("vehicle_make"),
        F.concat(F.lit("Model"), k % 7).alias("vehicle_model"), (F.lit(2000) + k % 20).alias("vehicle_year"), "policy_status", "policy_inception", "policy_expiry",
        F.when(k % 2 == 0, "COMPREHENSIVE").otherwise("THIRD_PARTY").alias("coverage_type"), "idv", "ncb_percent", F.when(k % 5 != 0, "NCB_PROTECT|ROADSIDE").alias("addons"), "hypothecated",
        F.when(F.col("hypothecated"), "HDFC Bank").alias("financer_name"), F.lit("Insurer").alias("insurer_name"), F.when(k % 3 != 0, F.lit(45)).otherwise(0).alias("waiting_period_days"), k.alias("row_pos"),
    )
    form = c.select("claim_id", "policy_number", F.lit("").alias("vehicle_reg"), F.concat(F.lit("F"), "member_id").alias("member_id"), "incident_type", "incident_date", F.concat(F.lit("Place "), k % 9).alias("incident_location"), F.col("received_date").alias("received_at"))
    return coverage.find_policy(form, policies)


def snapshot_full(spark, sf):
    out = case.snapshot(_found(spark, sf))
    return out.withColumn("addons", F.array_join("addons", "|"))


def snapshot_section(spark, sf):
    """The 18 pairs of each claim's snapshot."""
    snap = case.snapshot(_found(spark, sf))
    return reports.snapshot_pairs(triage.aging(snap, F.col("fnol_received_at").cast("timestamp"), F.lit(AS_OF).cast("timestamp")))


def _fit(spark, sf, claims=None):
    return coverage.applicable_clauses(intake_queries._insured(spark, sf, claims), intake_queries._clauses(spark, sf))


def _coverage_verdicts(fit):
    k = F.col("row_pos")
    return fit.filter(k % 13 != 0).select("claim_id", k.alias("pos"), F.col("section_name").alias("section"), "clause_ref", F.when(k % 2 == 0, "COVERED").otherwise("NOT_COVERED").alias("status"),
        F.when(k % 9 == 0, "LOW").when(k % 9 < 3, "MODERATE").otherwise("HIGH").alias("confidence"), F.concat(F.lit("Clause "), "clause_ref").alias("note"))


def coverage_rows(spark, sf):
    fit = _fit(spark, sf)
    return case.coverage_rows(intake_queries._insured(spark, sf), fit, _coverage_verdicts(fit))


def _exclusions(spark, sf, claims=None, keep=lambda name, rows: rows):
    """claims: those of the bindings, if they are made; keep: writes a table and reads it back, where what applies is to be made once."""
    x = intake_queries._clauses(spark, sf).select("policy_number", F.col("clause_ref").alias("exclusion_code"), "active", F.col("excluded_types").alias("applicable_incident_types"), "reinstatement_addon", "display_order", "row_pos")
    fit = keep("exclusions", coverage.applicable_exclusions(intake_queries._insured(spark, sf, claims), x))
    k = F.col("row_pos")
    said = fit.filter(k % 3 != 0).select("claim_id", F.col("exclusion_code").alias("code"), F.concat(F.lit("Exclusion "), "exclusion_code").alias("name"), F.lit("General").alias("clause_ref"), F.when(k % 2 == 0, "LOW").otherwise("HIGH").alias("confidence"), F.lit("seen").alias("reason_relevant"))
    return case.exclusion_rows(fit, said)


def exclusion_rows(spark, sf):
    return _exclusions(spark, sf).select("claim_id", "place", "code", "applicability", "confidence")


def exclusion_section(spark, sf):
    return case.exclusion_section(b.claims(spark, sf), _exclusions(spark, sf)).select("claim_id", "place", "name", "confidence")


def _cases(spark, sf):
    fit = _fit(spark, sf)
    gaps = b.claims(spark, sf).select("claim_id", (F.col("claim_id") % 4 == 0).alias("critical_missing"))
    return case.run(b.claims(spark, sf), b.history(spark, sf), fit, _coverage_verdicts(fit), _exclusions(spark, sf), gaps, F.col("received_date").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))


def triage_full(spark, sf):
    return _cases(spark, sf).select("claim_id", "triage_status", "escalation_flag", "escalation_reason", "coverage_applicable", "coverage_confidence", "n_exclusions", "critical_missing", "score", "band", "prior_claims_36m_count", "waiting_period_active", "aging_risk_level", "sla_breached")


def escalation_section(spark, sf):
    return case.escalation_section(triage_queries.assessed(spark, sf)).select("claim_id", "pos", "code")


def member_access(spark, sf):
    reg = intake_queries._register(spark, sf).withColumn("member_id", F.when(F.col("row_pos") % 50 != 0, F.concat(F.lit(" m"), F.col("member_id") % 40)))
    return register.of_member(reg, "M7 ").select("fnol_id", "member_id")


def register_append(spark, sf):
    """The register with a new row for each customer; where they stand is told by what stands before them."""
    new = b.table(spark, sf, "customer").select(F.format_string("FNOL-2030-%09d", "c_custkey").alias("fnol_id"), F.col("c_custkey").alias("member_id"))
    reg = intake_queries._register(spark, sf)
    out = register.append(reg, new, dt.datetime(2030, 1, 1))
    last = reg.agg(F.max("row_pos").alias("last"))
    return out.crossJoin(F.broadcast(last)).select("fnol_id", "member_id", "triage_status", "escalation_flag", (F.col("row_pos") > F.col("last")).alias("is_new"))


def mean_chunk_words(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.lit(1).alias("page_num"), "text")
    return retrieval.whole_mean_words(retrieval.chunk_pages(d))


def timing_totals(spark, sf):
    steps = intake_queries.step_durations(spark, sf).withColumn("step", F.concat(F.lit("step "), "idx"))
    out = case.timing_report(steps)
    return out.select("run_id", "total_duration_s", F.size(F.from_json("report", "steps array<struct<step: string>>")["steps"]).alias("steps"))


_ALL = intake_queries._INS_ALL
_REST = _ALL[len(b.SQL):]
_EX = """, x AS (SELECT claim_id, k, CASE WHEN p_size % 10 = 0 THEN 99 ELSE p_size % 10 END AS o FROM ins JOIN cl USING (policy_number)
        WHERE k % 11 <> 0 AND (k % 5 = 0 OR list_contains(string_split(CASE WHEN k % 5 = 1 THEN 'FIRE|VANDALISM' ELSE 'FIRE|THEFT_COMPLETE' END, '|'), incident_type)) AND NOT (k % 4 = 0 AND list_contains(addons, 'ROADSIDE'))),
        ex AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY o, k) AS INTEGER) AS place FROM x), exv AS (SELECT * FROM ex WHERE k % 3 <> 0)
"""
_ROLL = """, n AS (SELECT claim_id, count(*) AS n, count(*) FILTER (WHERE k % 13 <> 0) AS j, count(*) FILTER (WHERE k % 13 <> 0 AND k % 2 = 0) AS cov, count(*) FILTER (WHERE k % 13 <> 0 AND k % 9 = 0) AS low, count(*) FILTER (WHERE k % 13 <> 0 AND k % 9 >= 3) AS high FROM fit GROUP BY claim_id),
  rolled AS (SELECT claim_id, CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN false ELSE coalesce(cov, 0) > 0 END AS coverage_applicable,
    CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'HIGH' WHEN n IS NULL THEN 'LOW' WHEN j = high THEN 'HIGH' WHEN low > 0 THEN 'LOW' ELSE 'MODERATE' END AS coverage_confidence FROM ins LEFT JOIN n USING (claim_id))
"""
SQL = {
    "snapshot_full": b.SQL + """SELECT claim_id, CASE WHEN claim_id % 4 <> 0 THEN 'M' || member_id ELSE 'F' || member_id END AS member_id, policy_number, 'V' || vehicle_reg AS vehicle_reg,
        'Make' || claim_id % 5 || ' Model' || claim_id % 7 || ' (' || (2000 + claim_id % 20) || ')' AS vehicle, incident_type, incident_date, 'Place ' || claim_id % 9 AS incident_location, received_date AS fnol_received_at,
        policy_status, policy_inception, policy_expiry, CASE WHEN claim_id % 2 = 0 THEN 'COMPREHENSIVE' ELSE 'THIRD_PARTY' END AS coverage_type, idv AS idv_inr, ncb_percent, CASE WHEN claim_id % 5 <> 0 THEN 'NCB_PROTECT|ROADSIDE' ELSE '' END AS addons,
        hypothecated, CASE WHEN hypothecated THEN 'HDFC Bank' END AS financer_name, 'Insurer' AS insurer,
        CASE WHEN incident_date > policy_expiry THEN 'Policy ' || policy_number || ' expired ' || policy_expiry || '. Incident date ' || incident_date || ' is after expiry. Coverage requires renewal verification.' END AS policy_expiry_warning,
        CASE WHEN claim_id % 3 <> 0 THEN 45 ELSE 30 END AS waiting_period_days FROM claims""",
    "coverage_rows": _ALL + """, have AS (SELECT DISTINCT claim_id FROM fit)
        SELECT claim_id, 0 AS pos, 'All Sections' AS section, 'N/A' AS clause_ref, 'NOT_COVERED' AS status, 'HIGH' AS confidence, 'Policy is ' || policy_status || '. No coverage available.' AS note FROM ins WHERE policy_status IN ('LAPSED', 'CANCELLED')
        UNION ALL SELECT claim_id, 0, 'No applicable clauses', 'N/A', 'REQUIRES_VERIFICATION', 'LOW', 'No matching clauses found in policy_clauses for this incident type.' FROM ins ANTI JOIN have USING (claim_id) WHERE policy_status NOT IN ('LAPSED', 'CANCELLED')
        UNION ALL SELECT claim_id, CAST(k AS INTEGER), p_name, CAST(k AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'COVERED' ELSE 'NOT_COVERED' END, CASE WHEN k % 9 = 0 THEN 'LOW' WHEN k % 9 < 3 THEN 'MODERATE' ELSE 'HIGH' END, 'Clause ' || k
        FROM fit JOIN ins USING (claim_id) JOIN part ON p_partkey = k WHERE k % 13 <> 0 AND policy_status NOT IN ('LAPSED', 'CANCELLED')""",
    "exclusion_rows": _ALL + _EX + "SELECT claim_id, place, CAST(k AS VARCHAR) AS code, 'REQUIRES_VERIFICATION' AS applicability, CASE WHEN k % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence FROM exv",
    "exclusion_section": _ALL + _EX + """SELECT claim_id, place, 'Exclusion ' || k AS name, CASE WHEN k % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence FROM exv
        UNION ALL SELECT claim_id, 0, 'No exclusions flagged for this policy / incident type.', '' FROM claims ANTI JOIN exv USING (claim_id)""",
    "triage_full": triage_queries._HIST + _REST + _EX + _ROLL + f""", nx AS (SELECT claim_id, count(*) AS n_exclusions FROM exv GROUP BY claim_id),
        aged AS (SELECT claim_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(received_date AS TIMESTAMP))) / 3600000000.0 AS h FROM claims)
        SELECT claim_id, CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'EXCEPTION_RAISED' WHEN codes <> '' THEN 'ESCALATED' WHEN claim_id % 4 = 0 THEN 'PENDED_FOR_INPUTS' ELSE 'COMPLETE' END AS triage_status, codes <> '' AS escalation_flag, nullif(codes, '') AS escalation_reason,
          coverage_applicable, coverage_confidence, coalesce(n_exclusions, 0) AS n_exclusions, claim_id % 4 = 0 AS critical_missing, score, band, n AS prior_claims_36m_count, days >= 0 AND days < 30 AS waiting_period_active,
          CASE WHEN h < 6 THEN 'LOW' WHEN h < 18 THEN 'MEDIUM' WHEN h < 24 THEN 'HIGH' ELSE 'CRITICAL' END AS aging_risk_level, h > 24 AS sla_breached
        FROM esc JOIN rolled USING (claim_id) LEFT JOIN nx USING (claim_id) JOIN aged USING (claim_id)""",
    "escalation_section": triage_queries._HIST + ", c AS (SELECT claim_id, string_split(codes, '|') AS l FROM esc WHERE codes <> ''), e AS (SELECT claim_id, unnest(l) AS code, generate_subscripts(l, 1) AS i FROM c) SELECT claim_id, CAST(i - 1 AS INTEGER) AS pos, code FROM e",
    "member_access": intake_queries._REG + " SELECT fnol_id, ' m' || member_id % 40 AS member_id FROM reg WHERE k % 50 <> 0 AND member_id % 40 = 7",
    "register_append": intake_queries._REG + """ SELECT fnol_id, member_id, 'PENDING' AS triage_status, false AS escalation_flag, false AS is_new FROM reg
        UNION ALL SELECT 'FNOL-2030-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), c_custkey, 'PENDING', false, true FROM customer""",
    "mean_chunk_words": f"""WITH f AS (SELECT doc_id AS source, {text_queries._WORDS} AS ws FROM documents), s AS (SELECT *, unnest(range(0, greatest(1, len(ws) - 400 + 350), 350)) AS st FROM f WHERE len(ws) > 0)
        SELECT source, count(*) AS chunks, CAST(sum(len(ws[st + 1 : st + 400])) // count(*) AS BIGINT) AS mean_words FROM s GROUP BY source""",
    "timing_totals": """WITH e AS (SELECT user_id AS run_id, event_id AS idx, epoch_us(ts) / 1e6 AS mark, max(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS fin FROM events),
        d AS (SELECT run_id, idx, round(coalesce(lead(mark) OVER w, fin) - mark, 3) AS dur, round(mark - first_value(mark) OVER w, 3) AS off FROM e WINDOW w AS (PARTITION BY run_id ORDER BY idx))
        SELECT run_id, round(arg_max(off + dur, idx), 3) AS total_duration_s, CAST(count(*) AS INTEGER) AS steps FROM d GROUP BY run_id""",
}
SQL["snapshot_section"] = b.SQL + f""", snap AS ({SQL["snapshot_full"][len(b.SQL):]}),
  aged AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(fnol_received_at AS TIMESTAMP))) / 3600000000.0 AS h FROM snap),
  said AS (SELECT claim_id, unnest([
    {{'pos': 0, 'label': 'FNOL ID', 'value': CAST(claim_id AS VARCHAR)}},
    {{'pos': 1, 'label': 'Aging Risk', 'value': CASE WHEN h < 6 THEN 'LOW' WHEN h < 18 THEN 'MEDIUM' WHEN h < 24 THEN 'HIGH' ELSE 'CRITICAL' END || ' (' || CAST(round_even(h, 0) AS BIGINT) || ' hours)'}},
    {{'pos': 2, 'label': 'Member ID', 'value': member_id}},
    {{'pos': 3, 'label': 'Policy Number', 'value': CAST(policy_number AS VARCHAR)}},
    {{'pos': 4, 'label': 'Vehicle', 'value': vehicle}},
    {{'pos': 5, 'label': 'Insurer', 'value': insurer}},
    {{'pos': 6, 'label': 'Incident Type', 'value': array_to_string(list_transform(string_split(lower(incident_type), '_'), lambda x: upper(x[1]) || x[2:]), ' ')}},
    {{'pos': 7, 'label': 'Incident Date', 'value': CAST(CAST(incident_date AS DATE) AS VARCHAR)}},
    {{'pos': 8, 'label': 'Incident Location', 'value': incident_location}},
    {{'pos': 9, 'label': 'FNOL Received', 'value': CAST(CAST(fnol_received_at AS DATE) AS VARCHAR)}},
    {{'pos': 10, 'label': 'Coverage Type', 'value': coverage_type}},
    {{'pos': 11, 'label': 'IDV', 'value': 'Rs.' || regexp_replace(format('{{:,.2f}}', CAST(idv_inr AS DOUBLE)), '\\.00$', '')}},
    {{'pos': 12, 'label': 'NCB at Inception', 'value': CAST(ncb_percent AS VARCHAR) || '%'}},
    {{'pos': 13, 'label': 'Add-ons', 'value': CASE WHEN addons = '' THEN 'None' ELSE replace(addons, '|', ' | ') END}},
    {{'pos': 14, 'label': 'Hypothecated', 'value': CASE WHEN hypothecated THEN 'Yes' ELSE 'No' END}},
    {{'pos': 15, 'label': 'Financer', 'value': coalesce(financer_name, 'None')}},
    {{'pos': 16, 'label': 'Policy Status', 'value': policy_status}},
    {{'pos': 17, 'label': 'Policy Expiry', 'value': CAST(CAST(policy_expiry AS DATE) AS VARCHAR)}}]) AS p FROM aged)
  SELECT claim_id, p.pos AS pos, p.label AS label, p.value AS value FROM said"""
QUERIES = {k: globals()[k] for k in SQL}
