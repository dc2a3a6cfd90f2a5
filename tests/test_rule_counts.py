"""Counts of all rules are those of the SQL, also beside letters with accents and where a match follows another."""

import random

import duckdb

from lossgrid.plans import text_queries

PARTS = ["Mr", "Mrs. ", "Asha Rao", "a@b", "x.com", ".y@z.org", "www.", "https://x", "ab:cd:", "1.2.3.4", " MG Road", ", Pune, Goa", "1234", " 5678", " 9012", "9876543210", "(987)654-3210", "+919876543210", "+91 9876543210", "ABCDE1234F", "MH12AB1234", "-", "4111 1111 1111 1111", "A1234567", "GB29ABCD1234567", " ", "\n", "\v", "\0", "é", "ß", "٣", "_"]


def test_counts_are_those_of_the_sql(spark, tmp_path):
    draw = random.Random(11)
    rows = [(i, "".join(draw.choices(PARTS, k=draw.randint(1, 12)))) for i in range(3000)] + [(3000, None), (3001, ""), (3002, "é9876543210")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "call (987) 654-3210(987) 654-3210")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("pii_entity_counts", "pii_entity_counts_all"):
        want = con.sql(text_queries.SQL[name]).fetchall()
        assert sorted(map(tuple, text_queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 2


def test_no_rule_is_counted_on_its_own(spark):
    plan = text_queries.pii_entity_counts_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "ArrowEvalPython" in plan
