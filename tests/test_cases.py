"""Whole cases: queries against their SQL, and the reference values of small cases."""

import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lossgrid.operators import case, coverage, register, retrieval
from lossgrid.plans import case_queries, catalogue

SF = "/root/testdata/sf0.001"


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(case_queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = Counter(tuple(normal(v) for v in r) for r in got.select(*names).collect())
    assert rows == Counter(tuple(normal(v) for v in r) for r in want.fetchall()) and rows


def test_snapshot_of_odd_policies(spark):
    policies = spark.createDataFrame(
        [("P1", "R1", "", "Maruti", "Swift", 2019, "ACTIVE", dt.date(2024, 1, 1), dt.date(2025, 1, 1), "COMPREHENSIVE", 1.0, 20.0, "A|B", None, None, "I", 0, 1), ("P2", "R2", "MEM-2", None, "X", None, None, None, None, None, None, None, "", True, "Bank", "I", None, 2)],
        "policy_number string, vehicle_reg string, member_id string, vehicle_make string, vehicle_model string, vehicle_year int, policy_status string, policy_inception date, policy_expiry date, coverage_type string, idv double, ncb_percent double, addons string, hypothecated boolean, financer_name string, insurer_name string, waiting_period_days int, row_pos int",
    )
    claims = spark.createDataFrame(
        [(1, " P1 ", "", "FORM-1", "FIRE", dt.date(2025, 2, 1), "here", "now"), (2, "none", " r2", "FORM-2", "FIRE", None, None, None), (3, "none", "", "FORM-3", "FIRE", None, None, None)],
        "claim_id int, policy_number string, vehicle_reg string, member_id string, incident_type string, incident_date date, incident_location string, received_at string",
    )
    got = {r.claim_id: r for r in case.snapshot(coverage.find_policy(claims, policies)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].member_id, got[1].vehicle, got[1].addons, got[1].hypothecated, got[1].waiting_period_days) == ("FORM-1", "Maruti Swift (2019)", ["A", "B"], False, 30)
    assert got[1].policy_expiry_warning == "Policy P1 expired 2025-01-01. Incident date 2025-02-01 is after expiry. Coverage requires renewal verification."
    assert (got[2].member_id, got[2].vehicle, got[2].addons, got[2].policy_expiry_warning) == ("MEM-2", "None X (None)", [], None)


def test_json_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([(1, "COMPLETE", None, [("a", 1)]), (2, 'q"\n', "é", [])], "claim_id long, triage_status string, note string, rows array<struct<code: string, n: int>>")
    case.write_json(cases, f"{tmp_path}/cases")
    back = case.read_json(spark, f"{tmp_path}/cases", cases.schema)
    assert sorted(back.collect()) == sorted(cases.collect())
    (tmp_path / "cases" / "part-bad.txt").write_text("{no")
    with pytest.raises(Exception):
        case.read_json(spark, f"{tmp_path}/cases", cases.schema).collect()


def test_checks_and_rows(spark):
    checks = spark.createDataFrame([(1, 1, "b", "FAIL"), (1, 0, "a", "FAIL"), (1, 2, "c", "PASS"), (2, 0, "a", "SKIPPED")], "claim_id int, pos int, field string, status string")
    assert {(r.claim_id, tuple(r.failed_checks), r.all_passed) for r in case.checks_passed(checks).collect()} == {(1, ("a", "b"), False), (2, (), True)}
    claims = spark.createDataFrame([(1,), (2,)], "claim_id int")
    rows = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "claim_id int, pos int, code string")
    assert {r.claim_id: [x.code for x in r.l] for r in case.rows_of(claims, rows, "pos", ("code",), "l").collect()} == {1: ["x", "y"], 2: []}


def test_register_changes(spark):
    reg = spark.createDataFrame([("FNOL-1", "m", "PENDING", False, None, None, None, 0), ("FNOL-2", None, "PENDING", False, None, None, None, 1)], "fnol_id string, member_id string, triage_status string, escalation_flag boolean, escalation_reason string, triage_json_path string, triage_pdf_path string, row_pos long")
    change = lambda i: (i, "COMPLETE", False, None, "j", None)
    kinds = "fnol_id string, triage_status string, escalation_flag boolean, escalation_reason string, triage_json_path string, triage_pdf_path string"
    twice = spark.createDataFrame([change("FNOL-1"), change(" FNOL-1"), change("FNOL-1")], kinds)
    assert Counter(r.triage_status for r in register.update(reg, twice).collect()) == {"COMPLETE": 1, "PENDING": 1}
    with pytest.raises(LookupError, match="FNOL-9"):
        register.update_all(reg, spark.createDataFrame([change("FNOL-9")], kinds))
    new = register.new_rows(spark.createDataFrame([("FNOL-3", 7)], "fnol_id string, member_id long"), dt.datetime(2030, 1, 1))
    assert "void" not in str(new.dtypes) and new.head().member_id == "7" and new.head().triage_status == "PENDING"
    assert register.append(reg, new, dt.datetime(2030, 1, 1)).schema == reg.schema


def test_nobody_reads_a_record_without_member(spark):
    reg = spark.createDataFrame([("a", None), ("b", " "), ("c", " mem-1 "), ("d", "MEM-2")], "fnol_id string, member_id string")
    assert [r.fnol_id for r in register.of_member(reg, "MEM-1").collect()] == ["c"]
    assert register.of_member(reg, " ").count() == register.of_member(reg, None).count() == 0


def test_retrieval_of_zero_vectors_and_many_questions(spark, monkeypatch):
    index = spark.createDataFrame([("n", f"c{i}", [float(i), 1.0]) for i in range(9)] + [("n", "zero", [0.0, 0.0])], "namespace string, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)] + [(99, [0.0, 0.0])], "question_id int, vector array<double>")
    few = retrieval.retrieve(asked, index).select("question_id", "place", "chunk_id", "score").collect()
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 2)
    assert sorted(few) == sorted(retrieval.retrieve(asked, index).select("question_id", "place", "chunk_id", "score").collect()) and len(few) == 24
    assert {r.score for r in few if r.question_id == 99} == {0.0}


def test_messages(spark):
    q = spark.createDataFrame([(1, 5, "why?")], "question_id int, conv_id int, question string")
    turns = spark.createDataFrame([(5, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(9)], "conv_id int, turn int, role string, text string")
    got = retrieval.messages(q, spark.createDataFrame([], "question_id int, context string"), turns, "Be brief.").orderBy("pos").collect()
    assert [(r.role, r.content) for r in got] == [("system", "Be brief.\n\n" + retrieval.NO_CONTEXT)] + [("user" if t % 2 else "assistant", f"t{t}") for t in range(3, 9)] + [("user", "why?")]
