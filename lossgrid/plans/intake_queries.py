"""Queries of intake validation, coverage, register and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_set
from ..operators import coverage, intake, register, reports, signals
from ..sources import bindings as b
from ..sources import matrix
from ..sources.shared import dealt
from . import triage_queries

#: A small catalogue for the bound documents: type, name, key, tier, condition, place.
CATALOGUE = [
    (intake.FORM, "Policy Number", "policy_number", "MANDATORY", "", 1),
    (intake.FORM, "Third Party Vehicle", "third_party_vehicle_reg", "CONDITIONAL", "Required when third_party_involved = Yes", 2),
    (intake.FORM, "Damage", "damage_description", "OPTIONAL", "", 3),
    (intake.DL, "Licence Status", "licence_status", "MANDATORY", "", 1),
    (intake.DL, "Endorsements", "endorsements", "MANDATORY", "", 2),
]


def _bound_documents(spark, sf):
    """Customers as documents of three types."""
    c = b.table(spark, sf, "customer")
    k = F.col("c_custkey")
    kind = F.when(F.col("c_nationkey") % 3 == 0, intake.FORM).when(F.col("c_nationkey") % 3 == 1, intake.DL).otherwise(intake.RC)
    pairs = [("policy_number", F.when(k % 4 == 0, "N/A").otherwise(F.col("c_name"))), ("third_party_involved", F.when(k % 3 == 0, "Yes").otherwise("No")), ("third_party_vehicle_reg", F.when(k % 5 == 0, F.col("c_mktsegment"))), ("licence_status", F.when(k % 7 == 0, "none").otherwise(F.col("c_mktsegment"))), ("endorsements", F.when(k % 8 != 0, "None"))]
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs]))
    return c.select(k.alias("claim_id"), F.lit(1).alias("page"), kind.alias("doc_type"), fields.alias("fields"))


def field_completeness(spark, sf):
    cat = spark.createDataFrame(CATALOGUE, "doc_type string, display_name string, json_key string, tier string, condition string, row_pos int")
    out = intake.completeness(_bound_documents(spark, sf), cat)
    return out.select("claim_id", "doc_type", "status", "fields_checked", "fields_present", F.array_join("missing_mandatory", "|").alias("missing_mandatory"), F.array_join("missing_conditional", "|").alias("missing_conditional"))


def _gaps(spark, sf):
    claims = b.claims(spark, sf).select("claim_id", "incident_type", F.create_map(F.lit("third_party_involved"), F.lit("No")).alias("fields"))
    i = F.col("claim_id")
    got = F.array(F.when(i % 2 == 0, intake.FIR), F.when(i % 3 != 0, " registration_certificate "), F.when(i % 5 != 0, intake.DL), F.when(i % 7 != 0, intake.PHOTO), F.lit(intake.FORM), F.lit("UNKNOWN"))
    docs = claims.select("claim_id", F.explode(F.filter(got, lambda x: x.isNotNull())).alias("doc_type"))
    return intake.document_gaps(claims, docs, matrix.document_matrix(spark))


def document_gap(spark, sf):
    of = lambda s: F.size(F.filter("gaps", lambda g: g["status"] == s))
    return _gaps(spark, sf).select("claim_id", "gap_status", "critical_missing", of("RECEIVED").alias("received"), of("MISSING_BLOCKING").alias("missing_blocking"), of("MISSING_MANDATORY").alias("missing_mandatory"))


def doc_checklist(spark, sf):
    return intake.checklist(_gaps(spark, sf)).groupBy("name", "mandatory", "blocking", "status", "collection_target").agg(F.count("*").alias("n"))


def _pairs(spark, sf):
    """Customers as a form, a certificate, a report and a licence whose fields agree or not."""
    c = dealt(b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    of = lambda *kv: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in kv]), F.array(*[v for _, v in kv]))
    docs = F.array(
        F.struct(F.lit(1).alias("page"), F.lit(intake.FORM).alias("doc_type"), of(("fir_number", name), ("vehicle_make", seg), ("incident_date_time", F.lit("05-03-2024 10:00"))).alias("fields")),
        F.struct(F.lit(2).alias("page"), F.lit(intake.FIR).alias("doc_type"), of(("fir_number", F.when(k % 3 == 0, F.lower(name)).when(k % 3 == 1, F.lit("FIR-1"))), ("date_of_incident", F.when(k % 2 == 0, "05-03-2024T09:30").otherwise("06-03-2024"))).alias("fields")),
        F.struct(F.lit(3).alias("page"), F.lit(intake.RC).alias("doc_type"), of(("make", F.when(k % 4 == 0, F.concat(seg, F.lit(" ltd (new)"))).when(k % 4 == 1, "other").otherwise(F.lower(seg)))).alias("fields")),
        F.struct(F.lit(4).alias("page"), F.lit(intake.DL).alias("doc_type"), of(("dl_valid_on_incident_date", F.when(k % 5 == 0, "Yes, valid").otherwise("no")), ("licence_status", F.when(k % 6 == 0, "INACTIVE").otherwise("expired"))).alias("fields")),
    )
    return c.select(k.alias("claim_id"), F.explode(docs).alias("d")).select("claim_id", "d.*")


def consistency_exact(spark, sf):
    return intake.consistency(_pairs(spark, sf)).filter(F.col("field").isin("fir_number", "incident_date")).select("claim_id", "field", "status")


def consistency_contains(spark, sf):
    return intake.consistency(_pairs(spark, sf)).filter("field = 'vehicle_make'").select("claim_id", "status", "detail")


def dl_validity(spark, sf):
    return intake.consistency(_pairs(spark, sf)).filter("field = 'driving_licence_validity'").select("claim_id", "status", "detail")


def _all_pairs(spark, sf):
    """Customers as documents that carry the fields of all comparisons; they agree, differ or lack by the customer's number."""
    c = dealt(b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    has = lambda *kv: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in kv]), F.array(*[(F.lit(v) if isinstance(v, str) else v) for _, v in kv]))
    form = has(("vehicle_registration_number", name), ("vehicle_make", seg), ("vehicle_model", F.concat(seg, F.lit(" one"))), ("fir_number", name), ("incident_date_time", "05-03-2024 10:00"), ("police_station", "North Gate"), ("policy_number", name), ("third_party_vehicle_reg", F.when(k % 4 != 0, name)), ("adjuster_id", seg))
    rc = has(("registration_number", F.when(k % 6 != 1, F.lower(name)).otherwise("other")), ("make", F.when(k % 4 == 0, F.concat(seg, F.lit(" ltd (new)"))).when(k % 4 == 1, "other").otherwise(F.lower(seg))), ("model", F.when(k % 3 == 0, F.concat(seg, F.lit("ONE x"))).when(k % 3 == 1, "two")), ("insurance_policy_number", F.when(k % 5 == 1, "P-1").when(k % 5 > 1, name)))
    fir = has(("complainant_vehicle_reg", F.when(k % 7 != 0, name)), ("fir_number", F.when(k % 3 == 0, F.lower(name)).when(k % 3 == 1, "FIR-1")), ("date_of_incident", F.when(k % 2 == 0, "05-03-2024T09:30").otherwise("06-03-2024")), ("police_station", F.when(k % 4 == 0, " north gate").when(k % 4 == 1, "South").otherwise("NORTHGATE")), ("third_party_vehicle_reg", F.when(k % 3 == 0, F.concat(name, F.lit(" (A)"))).when(k % 3 == 1, "other")))
    photo = has(("vehicle_reg", F.when(k % 10 == 0, "other").otherwise(name)), ("adjuster_id", F.when(k % 6 == 0, "").when(k % 6 == 1, "X").otherwise(seg)))
    dl = has(("dl_valid_on_incident_date", F.when(k % 5 == 0, "Yes, valid").otherwise("no")), ("licence_status", F.when(k % 6 == 0, "INACTIVE").otherwise("expired")))
    docs = F.array(*[F.struct(F.lit(i).alias("page"), F.lit(t).alias("doc_type"), f.alias("fields")) for i, (t, f) in enumerate([(intake.FORM, form), (intake.FIR, fir), (intake.RC, rc), (intake.DL, dl), (intake.PHOTO, photo)], 1)])
    return c.select(k.alias("claim_id"), F.explode(docs).alias("d")).select("claim_id", "d.*")


def consistency_all(spark, sf):
    """Every comparison of every claim."""
    return intake.consistency(_all_pairs(spark, sf)).select("claim_id", "field", "status", "detail", F.array_join("sources_checked", "|").alias("sources"))


def _turns(spark, sf):
    t = b.table(spark, sf, "conversations")
    return t.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text")).select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("page"), F.col("role").alias("doc_type"), F.create_map(F.lit("text"), F.col("text")).alias("fields"))


_ROLES = {"u": "user", "a": "assistant", "s": "system"}


def _by(spark, sf, last):
    out = intake.by_type(_turns(spark, sf), _ROLES, last)
    return out.select("claim_id", *[F.col(c)["text"].alias(n) for c, n in (("u", "user_text"), ("a", "assistant_text"), ("s", "system_text"))])


def extracted_summary_first(spark, sf):
    return _by(spark, sf, False)


def by_type_last(spark, sf):
    return _by(spark, sf, True)


def step_durations(spark, sf):
    e = b.table(spark, sf, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    steps = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), (F.unix_micros(F.max("ts").over(w).cast("timestamp")) / F.lit(1e6)).alias("end"))
    return intake.step_durations(steps)


def dl_class_disjoint(spark, sf):
    p = b.table(spark, sf, "part")
    return p.select("p_partkey", (~F.arrays_overlap(token_set(F.col("p_name")), token_set(F.col("p_type")))).alias("disjoint"), F.size(token_set(F.col("p_type"))).alias("tokens"))


def llm_verdict_validation(spark, sf):
    """Verdicts made of the events: of a seventh the confidence is unknown, of a fifth the reason empty."""
    e = b.table(spark, sf, "events")
    k = F.col("event_id")
    one = F.concat(F.lit('{"triggered": '), F.when(k % 2 == 0, "true").otherwise('"false"'), F.lit(', "confidence": "'), F.when(k % 7 == 0, "SURE").otherwise("HIGH"), F.lit('", "reason": "'), F.when(k % 5 == 0, "").otherwise("seen"), F.lit('"'))
    text = F.concat(F.lit('{"narrative_coherence": '), one, F.lit('}, "key_status_concern": '), one, F.lit(', "applicable": false}, "damage_severity_plausibility": '), F.when(k % 11 == 0, F.lit("null")).otherwise(F.concat(one, F.lit("}"))), F.lit(', "extra": 1}'))
    v = signals.parse_verdict(text)
    return e.select("event_id", v.isNotNull().alias("valid"), (F.lower(v["narrative_coherence"]["triggered"]) == "true").alias("narrative"))


def _policies(spark, sf):
    c = b.claims(spark, sf)
    return c.select(F.concat(F.lit("P"), F.col("policy_number").cast("string")).alias("policy_number"), F.concat(F.lit("V"), F.col("vehicle_reg").cast("string")).alias("vehicle_reg"), "policy_status", "idv", F.col("claim_id").alias("row_pos"))


def claim_snapshot(spark, sf):
    """Every third claim carries an unknown policy number, so its registration decides; of these every second is lower case."""
    k = F.col("claim_id")
    asked = b.claims(spark, sf).select("claim_id", F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit(" P"), k.cast("string"))).alias("policy_number"), F.when(k % 33 == 0, "V-unknown").when(k % 2 == 0, F.concat(F.lit("v"), F.col("vehicle_reg").cast("string"))).otherwise(F.concat(F.lit("V"), F.col("vehicle_reg").cast("string"))).alias("vehicle_reg"))
    return coverage.find_policy(asked, _policies(spark, sf)).select("claim_id", "found_by", F.col("p.policy_number").alias("policy_number"), F.col("p.policy_status").alias("policy_status"), F.col("p.idv").alias("idv"))


def _clauses(spark, sf):
    """Parts as clauses of the policies of all claims, four a policy."""
    p = b.table(spark, sf, "part")
    k = F.col("p_partkey")
    some = F.array(F.when(k % 5 == 0, "ALL").otherwise("FIRE"), F.when(k % 2 == 0, "THEFT_COMPLETE").otherwise("VANDALISM"))
    policy = F.shiftright(k, 2)
    return p.select(policy.alias("policy_number"), k.alias("row_pos"), k.cast("string").alias("clause_ref"), F.col("p_name").alias("section_name"), some.alias("applicable_incident_types"), F.when(k % 3 == 0, F.array(F.lit("COMPREHENSIVE"))).otherwise(F.array().cast("array<string>")).alias("coverage_type_filter"), F.when(k % 7 == 0, "NCB_PROTECT").otherwise("").alias("addon_required"),
                    (k % 11 != 0).alias("active"), F.when(k % 5 == 0, "SMALL").when(k % 5 == 1, "FIRE|VANDALISM").otherwise("FIRE|THEFT_COMPLETE").alias("excluded_types"), F.when(k % 4 == 0, "ROADSIDE").alias("reinstatement_addon"), (F.col("p_size") % 10).alias("display_order"))


def _insured(spark, sf, claims=None):
    """All claims, by member to policies of a few clauses each; claims: those of the bindings, if they are made."""
    k = F.col("claim_id")
    policy = F.shiftright("member_id", 2)
    return (b.claims(spark, sf) if claims is None else claims).select("claim_id", policy.alias("policy_number"), "incident_type", "policy_status", F.when(k % 2 == 0, "COMPREHENSIVE").otherwise("THIRD_PARTY").alias("coverage_type"), F.when(k % 3 == 0, F.array(F.lit("NCB_PROTECT"))).when(k % 3 == 1, F.array(F.lit("ROADSIDE"))).otherwise(F.array().cast("array<string>")).alias("addons"))


def clause_filter_all(spark, sf):
    return coverage.applicable_clauses(_insured(spark, sf), _clauses(spark, sf)).select("claim_id", "clause_ref")


def exclusion_filter_all(spark, sf):
    x = _clauses(spark, sf).select("policy_number", F.col("clause_ref").alias("exclusion_code"), "active", F.col("excluded_types").alias("applicable_incident_types"), "reinstatement_addon", "display_order", "row_pos")
    return coverage.applicable_exclusions(_insured(spark, sf), x).select("claim_id", "exclusion_code", "display_order", "place")


def coverage_rollup_all(spark, sf):
    claims, clauses = _insured(spark, sf), _clauses(spark, sf)
    fit = coverage.applicable_clauses(claims, clauses)
    k = F.col("row_pos")
    verdicts = fit.filter(k % 13 != 0).select("claim_id", F.when(k % 2 == 0, "COVERED").otherwise("NOT_COVERED").alias("status"), F.when(k % 9 == 0, "LOW").when(k % 9 < 3, "MODERATE").otherwise("HIGH").alias("confidence"))
    return coverage.coverage_rollup(claims, fit, verdicts)


def _register(spark, sf):
    o = b.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.format_string("FNOL-%d-%04d", F.lit(2020) + (k % 5).cast("int"), k).alias("fnol_id"), F.col("o_custkey").alias("member_id"), F.lit("PENDING").alias("triage_status"), F.lit(False).alias("escalation_flag"), F.lit(None).cast("string").alias("escalation_reason"), F.lit(None).cast("string").alias("triage_json_path"), F.lit(None).cast("string").alias("triage_pdf_path"), k.alias("row_pos"))


def register_lookup_all(spark, sf):
    """Every id of the register, and as many that it does not have; those have no row."""
    reg = _register(spark, sf)
    ids = reg.select(F.explode(F.array(F.concat(F.lit(" "), F.lower("fnol_id")), F.concat(F.lit("none-"), "fnol_id"))).alias("id"))
    return register.look_up(reg, ids).select("id", "fnol_id", "member_id")


def register_update(spark, sf):
    reg = _register(spark, sf)
    changes = reg.filter("row_pos % 4 = 0").select("fnol_id", F.lit("ESCALATED").alias("triage_status"), F.lit(True).alias("escalation_flag"), F.lit("REPEAT_CLAIMANT").alias("escalation_reason"), F.concat("fnol_id", F.lit(".json")).alias("triage_json_path"), F.lit(None).cast("string").alias("triage_pdf_path"))
    return register.update(reg, changes)


def next_fnol_number(spark, sf):
    return register.next_number(_register(spark, sf), 2026)


def member_lookup(spark, sf):
    pol = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("member_id"), F.col("o_orderkey").alias("policy_number"), F.col("o_orderkey").alias("row_pos"))
    ids = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return register.look_up_member(pol, ids).select("id", "n_policies", F.col("policies")[0]["policy_number"].alias("first_policy"))


def access_filter(spark, sf):
    return register.visible_to(_register(spark, sf).withColumn("member_id", F.when(F.col("row_pos") % 50 != 0, F.col("member_id"))), "7").select("fnol_id", "member_id")


def side_by_side_blocks(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.lit(1).alias("page_num"), "text")
    return reports.side_by_side(d)


def summary_lines(spark, sf):
    return reports.summary_lines(b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit(". "), F.lit("\n- ")).alias("text"))).groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def report_sections(spark, sf):
    return reports.sections(triage_queries.assessed(spark, sf)).filter(F.col("section").isin("waiting period", "indicators", "escalation")).select("claim_id", "section", "pos", "label", "value")


def report_sections_all(spark, sf):
    """All sections of pairs, the snapshot and the history among them."""
    return reports.sections(triage_queries.assessed(spark, sf)).select("claim_id", "section", "pos", "label", "value")


_NEED = "(VALUES " + ", ".join(f"('{k.replace('_', '')}', '{c}', '{d}', '{t}', '{by}')" for k, c, d, t, _, by, _ in matrix.rows()) + ") AS m(kind, criticality, document, doc_type, collection_by)"
_GAP = b.SQL + f""", g AS (
  SELECT c.claim_id, m.*, CASE doc_type WHEN 'FIR' THEN claim_id % 2 = 0 WHEN 'REGISTRATION_CERTIFICATE' THEN claim_id % 3 <> 0 WHEN 'DRIVING_LICENCE' THEN claim_id % 5 <> 0 WHEN 'VEHICLE_DAMAGE_PHOTO_LOG' THEN claim_id % 7 <> 0 ELSE false END AS received
  FROM claims c JOIN {_NEED} ON replace(c.incident_type, '_', '') = m.kind)
"""
_CUST = """WITH d AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey % 3 AS t FROM customer)"""
_INS_ALL = b.SQL + """, ins AS (
  SELECT claim_id, member_id // 4 AS policy_number, incident_type, policy_status, CASE WHEN claim_id % 2 = 0 THEN 'COMPREHENSIVE' ELSE 'THIRD_PARTY' END AS coverage_type,
    CASE claim_id % 3 WHEN 0 THEN ['NCB_PROTECT'] WHEN 1 THEN ['ROADSIDE'] ELSE [] END AS addons FROM claims
), cl AS (
  SELECT p_partkey AS k, p_partkey // 4 AS policy_number, [CASE WHEN p_partkey % 5 = 0 THEN 'ALL' ELSE 'FIRE' END, CASE WHEN p_partkey % 2 = 0 THEN 'THEFT_COMPLETE' ELSE 'VANDALISM' END] AS types, p_size FROM part
), fit AS (
  SELECT claim_id, k FROM ins JOIN cl USING (policy_number)
  WHERE (list_contains(types, incident_type) OR list_contains(types, 'ALL')) AND (k % 3 <> 0 OR coverage_type = 'COMPREHENSIVE') AND (k % 7 <> 0 OR list_contains(addons, 'NCB_PROTECT')))
"""
_REG = """WITH reg AS (SELECT 'FNOL-' || (2020 + o_orderkey % 5) || '-' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS fnol_id, o_custkey AS member_id, o_orderkey AS k FROM orders)"""
_SECTION = triage_queries._HIST + ", shown AS (SELECT *, CASE WHEN codes <> '' THEN codes END AS reason FROM esc) " + " UNION ALL ".join(
    f"SELECT claim_id, '{s}' AS section, {i} AS pos, '{label}' AS label, coalesce(CAST({sql} AS VARCHAR), '—') AS value FROM shown"
    for s, i, label, sql in [
        ("waiting period", 0, "Policy Inception", "policy_inception"), ("waiting period", 1, "Waiting Period Days", "waiting_period_days"), ("waiting period", 2, "Incident Date", "incident_date"), ("waiting period", 3, "Days Since Inception", "days"),
        ("waiting period", 4, "Waiting Period Active", "days >= 0 AND days < 30"), ("waiting period", 5, "Incident Pre-Inception", "days < 0"), ("indicators", 0, "Score", "score"), ("indicators", 1, "Band", "band"), ("indicators", 2, "Confidence", "confidence"),
        ("escalation", 0, "Escalated", "codes <> ''"), ("escalation", 1, "Reason", "reason"),
    ]
)

SQL = {
    "field_completeness": _CUST + """, v AS (SELECT k, t, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS pn, k % 3 = 0 AS tp, k % 5 = 0 AS tpv, k % 7 <> 0 AS ls, k % 8 <> 0 AS en FROM d)
        SELECT k AS claim_id, CASE t WHEN 0 THEN 'FNOL_REGISTRATION_FORM' WHEN 1 THEN 'DRIVING_LICENCE' ELSE 'REGISTRATION_CERTIFICATE' END AS doc_type,
          CASE WHEN t = 2 THEN 'SKIPPED' WHEN t = 0 AND pn = 0 OR t = 1 AND NOT (ls AND en) THEN 'INCOMPLETE_MANDATORY' WHEN t = 0 AND tp AND NOT tpv THEN 'INCOMPLETE_CONDITIONAL' ELSE 'COMPLETE' END AS status,
          CAST(CASE t WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS fields_checked, CAST(CASE t WHEN 0 THEN pn + tpv::INT WHEN 1 THEN ls::INT + en::INT ELSE 0 END AS INTEGER) AS fields_present,
          CASE WHEN t = 0 AND pn = 0 THEN 'policy_number' WHEN t = 1 THEN concat_ws('|', CASE WHEN NOT ls THEN 'licence_status' END, CASE WHEN NOT en THEN 'endorsements' END) ELSE '' END AS missing_mandatory,
          CASE WHEN t = 0 AND tp AND NOT tpv THEN 'third_party_vehicle_reg' ELSE '' END AS missing_conditional FROM v""",
    "document_gap": _GAP + "SELECT claim_id, CASE WHEN bool_or(NOT received AND criticality = 'BLOCKING') THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS gap_status, bool_or(NOT received AND criticality = 'BLOCKING') AS critical_missing, CAST(count(*) FILTER (WHERE received) AS INTEGER) AS received, CAST(count(*) FILTER (WHERE NOT received AND criticality = 'BLOCKING') AS INTEGER) AS missing_blocking, CAST(count(*) FILTER (WHERE NOT received AND criticality = 'MANDATORY') AS INTEGER) AS missing_mandatory FROM g GROUP BY claim_id",
    "doc_checklist": _GAP + "SELECT document AS name, true AS mandatory, criticality = 'BLOCKING' AS blocking, CASE WHEN received THEN 'RECEIVED' ELSE 'MISSING' END AS status, collection_by AS collection_target, count(*) AS n FROM g GROUP BY ALL",
    "consistency_exact": _CUST + """ SELECT k AS claim_id, 'fir_number' AS field, CASE k % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'SKIPPED' END AS status FROM d
        UNION ALL SELECT k, 'incident_date', CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END FROM d""",
    "consistency_contains": _CUST + " SELECT k AS claim_id, CASE WHEN k % 4 = 1 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN k % 4 = 1 THEN 'Mismatch: FNOL Form=' || seg || ', RC=other' ELSE 'All values match' END AS detail FROM d",
    "dl_validity": _CUST + """, v AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'Yes, valid' ELSE 'no' END AS a, CASE WHEN k % 6 = 0 THEN 'INACTIVE' ELSE 'expired' END AS s FROM d)
        SELECT k AS claim_id, CASE WHEN upper(a) LIKE '%YES%' OR upper(s) LIKE '%ACTIVE%' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN upper(a) LIKE '%YES%' OR upper(s) LIKE '%ACTIVE%' THEN 'DL valid: ' || a || ' | Status: ' || s ELSE 'DL validity unclear — valid: ' || a || ', status: ' || s END AS detail FROM v""",
    "extracted_summary_first": "WITH t AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL) SELECT conv_id AS claim_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text, arg_min(text, turn) FILTER (WHERE role = 'system') AS system_text FROM t GROUP BY conv_id",
    "by_type_last": "WITH t AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL) SELECT conv_id AS claim_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text, arg_max(text, turn) FILTER (WHERE role = 'system') AS system_text FROM t GROUP BY conv_id",
    "step_durations": """WITH e AS (SELECT user_id AS run_id, event_id AS idx, epoch_us(ts) / 1e6 AS mark, max(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS fin FROM events)
        SELECT run_id, idx, round(coalesce(lead(mark) OVER w, fin) - mark, 3) AS duration_s, round(mark - first_value(mark) OVER w, 3) AS start_offset_s FROM e WINDOW w AS (PARTITION BY run_id ORDER BY idx)""",
    "dl_class_disjoint": "SELECT p_partkey, NOT list_has_any(regexp_extract_all(upper(p_name), '[A-Z0-9]+'), regexp_extract_all(upper(p_type), '[A-Z0-9]+')) AS disjoint, CAST(len(list_distinct(regexp_extract_all(upper(p_type), '[A-Z0-9]+'))) AS INTEGER) AS tokens FROM part",
    "llm_verdict_validation": "WITH v AS (SELECT event_id, event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0 AS valid FROM events) SELECT event_id, valid, CASE WHEN valid THEN event_id % 2 = 0 END AS narrative FROM v",
    "claim_snapshot": b.SQL + """, f AS (SELECT claim_id, vehicle_reg, claim_id % 3 = 0 AS lost, CASE WHEN claim_id % 33 <> 0 THEN vehicle_reg END AS reg FROM claims),
        v AS (SELECT vehicle_reg, min(claim_id) AS first_id FROM claims GROUP BY vehicle_reg)
        SELECT f.claim_id, CASE WHEN NOT lost THEN 'policy_number' WHEN first_id IS NOT NULL THEN 'vehicle_reg' END AS found_by, 'P' || p.policy_number AS policy_number, p.policy_status, p.idv
        FROM f LEFT JOIN v ON v.vehicle_reg = f.reg LEFT JOIN claims p ON p.claim_id = CASE WHEN lost THEN first_id ELSE f.claim_id END""",
    "clause_filter_all": _INS_ALL + "SELECT claim_id, CAST(k AS VARCHAR) AS clause_ref FROM fit",
    "exclusion_filter_all": _INS_ALL + """, x AS (SELECT claim_id, k, CASE WHEN p_size % 10 = 0 THEN 99 ELSE p_size % 10 END AS o FROM ins JOIN cl USING (policy_number)
        WHERE k % 11 <> 0 AND (k % 5 = 0 OR list_contains(string_split(CASE WHEN k % 5 = 1 THEN 'FIRE|VANDALISM' ELSE 'FIRE|THEFT_COMPLETE' END, '|'), incident_type)) AND NOT (k % 4 = 0 AND list_contains(addons, 'ROADSIDE')))
        SELECT claim_id, CAST(k AS VARCHAR) AS exclusion_code, CAST(o AS INTEGER) AS display_order, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY o, k) AS INTEGER) AS place FROM x""",
    "coverage_rollup_all": _INS_ALL + """, n AS (SELECT claim_id, count(*) AS n, count(*) FILTER (WHERE k % 13 <> 0) AS j, count(*) FILTER (WHERE k % 13 <> 0 AND k % 2 = 0) AS cov, count(*) FILTER (WHERE k % 13 <> 0 AND k % 9 = 0) AS low, count(*) FILTER (WHERE k % 13 <> 0 AND k % 9 >= 3) AS high FROM fit GROUP BY claim_id)
        SELECT claim_id, CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN false ELSE coalesce(cov, 0) > 0 END AS coverage_applicable,
          CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'HIGH' WHEN n IS NULL THEN 'LOW' WHEN j = high THEN 'HIGH' WHEN low > 0 THEN 'LOW' ELSE 'MODERATE' END AS coverage_confidence,
          CASE WHEN policy_status IN ('LAPSED', 'CANCELLED') THEN 'NOT_COVERED' WHEN n IS NULL THEN 'REQUIRES_VERIFICATION' ELSE 'JUDGED' END AS coverage_case FROM ins LEFT JOIN n USING (claim_id)""",
    "register_lookup_all": _REG + " SELECT ' ' || lower(fnol_id) AS id, fnol_id, member_id FROM reg",
    "register_update": _REG + " SELECT fnol_id, member_id, CASE WHEN k % 4 = 0 THEN 'ESCALATED' ELSE 'PENDING' END AS triage_status, k % 4 = 0 AS escalation_flag, CASE WHEN k % 4 = 0 THEN 'REPEAT_CLAIMANT' END AS escalation_reason, CASE WHEN k % 4 = 0 THEN fnol_id || '.json' END AS triage_json_path, CAST(NULL AS VARCHAR) AS triage_pdf_path, k AS row_pos FROM reg",
    "next_fnol_number": _REG + " SELECT 'FNOL-2026-' || CASE WHEN max(k) + 1 < 10000 THEN lpad(CAST(max(k) + 1 AS VARCHAR), 4, '0') ELSE CAST(max(k) + 1 AS VARCHAR) END AS fnol_id FROM reg",
    "member_lookup": "SELECT c_custkey AS id, count(*) AS n_policies, min(o_orderkey) AS first_policy FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "access_filter": _REG + " SELECT fnol_id, CASE WHEN k % 50 <> 0 THEN member_id END AS member_id FROM reg WHERE k % 50 = 0 OR member_id = 7",
    "side_by_side_blocks": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 25 + 1)) AS blk FROM l)
        SELECT doc_id AS claim_id, 1 AS page_num, CAST(blk AS INTEGER) AS block, CAST(len(l[blk * 25 + 1 : blk * 25 + 25]) AS INTEGER) AS n_lines, array_to_string(l[blk * 25 + 1 : blk * 25 + 25], chr(10)) AS text FROM x""",
    "summary_lines": """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '- '), chr(10))) AS raw, generate_subscripts(string_split(replace(text, '. ', chr(10) || '- '), chr(10)), 1) AS pos FROM documents),
        t AS (SELECT doc_id, pos, trim(raw) AS line FROM l WHERE trim(raw) <> ''), k AS (SELECT *, CASE WHEN regexp_matches(line, '^[•\\-*–]') THEN 'bullet' WHEN regexp_matches(line, '^[0-9][.):]') THEN 'sub' ELSE 'plain' END AS kind FROM t),
        n AS (SELECT *, sum(CASE WHEN kind = 'plain' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM k)
        SELECT doc_id AS id, CASE WHEN kind <> 'plain' THEN kind WHEN p = 1 THEN 'opening' ELSE 'bullet' END AS kind, count(*) AS n,
          CAST(sum(length(CASE kind WHEN 'bullet' THEN trim(regexp_replace(line, '^[•\\-*– ]+', '')) WHEN 'sub' THEN trim(regexp_replace(line, '^[0-9]+[.):] *', '')) ELSE line END)) AS BIGINT) AS chars FROM n GROUP BY 1, 2""",
    "report_sections": _SECTION,
}
SQL["report_sections_all"] = _SECTION + "".join(
    f" UNION ALL SELECT claim_id, '{s}', {i}, '{label}', coalesce(CAST({sql} AS VARCHAR), '—') FROM shown"
    for s, pairs in {
        "snapshot": [("Member ID", "member_id"), ("Policy Number", "policy_number"), ("Vehicle Registration", "vehicle_reg"), ("Incident Type", "incident_type"), ("Incident Date", "incident_date"), ("Policy Status", "policy_status"), ("Policy Inception", "policy_inception"), ("Policy Expiry", "policy_expiry")],
        "history": [("Claims in 36 months", "n"), ("Last Claim", "last_claim_date"), ("Days Since Last Claim", "days_last"), ("Back to Back", "s1"), ("Claims in 12 months", "m"), ("Repeat Claimant", "s2")],
    }.items()
    for i, (label, sql) in enumerate(pairs)
)


def _compared(field: str, sources: dict[str, str], loose: bool = False, both: bool = False) -> str:
    """One comparison in SQL: the values there are, equal or (loose) one part of the other when bare."""
    found = "list_filter([" + ", ".join(f"{{'l': '{label}', 'v': {sql}}}" for label, sql in sources.items()) + "], lambda x: x.v IS NOT NULL AND x.v <> '')"
    bare = "replace(upper(trim(regexp_replace(x.v, '\\([^)]*\\)', '', 'g'))), ' ', '')" if loose else "replace(upper(trim(x.v)), ' ', '')"
    same = "(contains(b[1], b[2]) OR contains(b[2], b[1]))" if loose else "len(list_distinct(b)) = 1"
    names = "|".join(sources)
    return f"""SELECT k AS claim_id, '{field}' AS field, CASE WHEN len(f) < 2 THEN 'SKIPPED' WHEN {same} THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE WHEN len(f) < 2 THEN 'Field present in fewer than 2 documents' WHEN {same} THEN 'All values match' ELSE 'Mismatch: ' || array_to_string(list_transform(f, lambda x: x.l || '=' || x.v), ', ') END AS detail,
      CASE WHEN len(f) < 2 THEN '{names}' ELSE array_to_string(list_transform(f, lambda x: x.l), '|') END AS sources
    FROM (SELECT k, f, list_transform(f, lambda x: {bare}) AS b FROM (SELECT k, {found} AS f FROM d{" WHERE " + " AND ".join(f"({v}) IS NOT NULL" for v in sources.values()) if both else ""}))"""


SQL["consistency_all"] = _CUST + " " + " UNION ALL ".join([
    _compared("vehicle_registration_number", {"FNOL Form": "name", "RC": "CASE WHEN k % 6 = 1 THEN 'other' ELSE lower(name) END", "FIR": "CASE WHEN k % 7 <> 0 THEN name END", "Photo Log": "CASE WHEN k % 10 = 0 THEN 'other' ELSE name END"}),
    _compared("vehicle_make", {"FNOL Form": "seg", "RC": "CASE k % 4 WHEN 0 THEN seg || ' ltd (new)' WHEN 1 THEN 'other' ELSE lower(seg) END"}, loose=True),
    _compared("vehicle_model", {"FNOL Form": "seg || ' one'", "RC": "CASE k % 3 WHEN 0 THEN seg || 'ONE x' WHEN 1 THEN 'two' END"}, loose=True),
    _compared("fir_number", {"FNOL Form": "name", "FIR": "CASE k % 3 WHEN 0 THEN lower(name) WHEN 1 THEN 'FIR-1' END"}),
    _compared("incident_date", {"FNOL Form": "'05-03-2024'", "FIR": "CASE WHEN k % 2 = 0 THEN '05-03-2024' ELSE '06-03-2024' END"}),
    _compared("police_station", {"FNOL Form": "'North Gate'", "FIR": "CASE k % 4 WHEN 0 THEN ' north gate' WHEN 1 THEN 'South' ELSE 'NORTHGATE' END"}),
    _compared("policy_number", {"FNOL Form": "name", "RC": "CASE WHEN k % 5 = 1 THEN 'P-1' WHEN k % 5 > 1 THEN name END"}),
    _compared("third_party_vehicle_reg", {"FNOL Form": "CASE WHEN k % 4 <> 0 THEN name END", "FIR": "CASE k % 3 WHEN 0 THEN name || ' (A)' WHEN 1 THEN 'other' END"}, loose=True, both=True),
    _compared("adjuster_id", {"FNOL Form": "seg", "Photo Log": "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'X' ELSE seg END"}),
    """SELECT k, 'driving_licence_validity', CASE WHEN k % 5 = 0 OR k % 6 = 0 THEN 'PASS' ELSE 'FAIL' END,
      CASE WHEN k % 5 = 0 OR k % 6 = 0 THEN 'DL valid: ' || CASE WHEN k % 5 = 0 THEN 'Yes, valid' ELSE 'no' END || ' | Status: ' || CASE WHEN k % 6 = 0 THEN 'INACTIVE' ELSE 'expired' END ELSE 'DL validity unclear — valid: no, status: expired' END, 'Driving Licence' FROM d""",
])
QUERIES = {k: globals()[k] for k in SQL}
