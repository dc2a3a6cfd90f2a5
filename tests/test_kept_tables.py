"""Tables that stay: crashes, reruns, rival writers; the register and its numbers on one; chunks of a source in many ranges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lossgrid.operators import register, retrieval
from lossgrid.sources.versioned import Conflict, Versioned


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_rerun_and_vacuum(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t", ("k",), 4)
    with pytest.raises(LookupError):
        t.read()
    first = spark.createDataFrame([(i, f"a{i}") for i in range(50)] + [(None, "none")], "k int, v string")
    assert t.upsert(first, "one") == 1 and len(rows(t.read())) == 51
    before = t.manifest()["buckets"]
    change = spark.createDataFrame([(7, "x"), (7, "y"), (None, "still none")], "k int, v string")
    assert t.upsert(change, "two") == 2
    after = t.manifest()["buckets"]
    touched = {str(b) for b in t.touched(change)}
    assert {b for b in after if after[b] != before[b]} == touched and len(touched) < 4
    want = {r.k: r.v for r in t.read().collect()}
    assert len(want) == 51 and want[7] == "y" and want[None] == "still none" and want[8] == "a8"
    assert t.upsert(change.withColumn("v", F.lit("z")), "two") == 2 and {r.k: r.v for r in t.read().collect()} == want
    t.vacuum()
    assert {r.k: r.v for r in t.read().collect()} == want and t.vacuum() == 0


def test_crash_between_write_and_swap(spark, tmp_path, monkeypatch):
    t = Versioned(spark, f"file://{tmp_path}/t", ("k",), 4)
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), "one")
    change = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")

    def lost(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Versioned, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(change, "two")
    assert rows(t.read()) == [(1, "a")]
    assert t.upsert(change, "two") == 2 and rows(t.read()) == [(1, "b"), (2, "c")]
    assert t.vacuum() == 2 and rows(t.read()) == [(1, "b"), (2, "c")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    t = Versioned(spark, f"file://{tmp_path}/t", ("k",), 4)
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), "one")
    late = t.manifest() | {"version": 2, "batches": ["one", "late"]}
    t.upsert(spark.createDataFrame([(2, "b")], "k int, v string"), "two")
    with pytest.raises(Conflict):
        t._commit(late)
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.manifest()["batches"] == ["one", "two"]


def test_register_that_stays(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/reg", ("fnol_id",), 8)
    start = register.new_rows(spark.createDataFrame([("FNOL-2025-0041", "m0")], "fnol_id string, member_id string"), dt.datetime(2025, 1, 1)).withColumn("row_pos", F.lit(0).cast("long"))
    t.upsert(start, "start")
    claims = spark.createDataFrame([(f"m{i}", "P") for i in range(1, 30)], "member_id string, policy_number string")
    for _ in range(2):  # the second time nothing is numbered anew
        register.kept_append(t, claims, 2026, [F.expr("CAST(substring(member_id, 2) AS INT)")], dt.datetime(2026, 1, 1), "batch-1")
    got = {r.member_id: (r.fnol_id, r.row_pos, r.triage_status) for r in t.read().collect()}
    assert got == {"m0": ("FNOL-2025-0041", 0, "PENDING")} | {f"m{i}": (f"FNOL-2026-{41 + i:04d}", i, "PENDING") for i in range(1, 30)}
    kinds = "fnol_id string, triage_status string, escalation_flag boolean, escalation_reason string, triage_json_path string, triage_pdf_path string"
    change = lambda i: spark.createDataFrame([(i, "COMPLETE", False, None, "j", None)], kinds)
    register.kept_update(t, change(" FNOL-2026-0042 "), "change-1")
    assert [r.member_id for r in t.read().filter("triage_status = 'COMPLETE'").collect()] == ["m1"] and t.read().count() == 30
    with pytest.raises(LookupError, match="FNOL-9"):
        register.kept_update(t, change("FNOL-9"), "change-2")


def test_chunks_of_a_source_in_many_ranges(spark, monkeypatch):
    pages = [("hot", p, " ".join(f"w{p}x{i}" for i in range(p % 13))) for p in range(700)] + [("small", 3, " a  b\tc "), ("none", 1, " "), ("null", 1, None)]
    df = spark.createDataFrame(pages, "source string, page_num int, text string")
    whole = rows(retrieval.chunk_pages(df, 40, 7))
    monkeypatch.setattr(retrieval, "PAGE_RANGE", 16)
    assert rows(retrieval.chunk_pages(df, 40, 7)) == whole
    words = [w for s, _, t in pages if s == "hot" for w in t.split()]
    texts = {r[1]: r[5] for r in whole if r[2] == "hot"}
    assert texts == {k: " ".join(words[33 * k : 33 * k + 40]) for k in range(len(texts))} and len(texts) == -(-(len(words) - 40 + 33) // 33)
