"""The coverage queries over all claims, against their SQL."""

from collections import Counter

import duckdb
import pytest

from lossgrid.plans import catalogue
from lossgrid.sources import bindings

SF = "/root/testdata/sf0.001"
NAMES = ("clause_filter_all", "exclusion_filter_all", "coverage_rollup_all")


@pytest.mark.parametrize("name", NAMES)
def test_every_claim_is_judged(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(want.fetchall()) and max(r[0] for r in rows) > 500
    if name == "coverage_rollup_all":
        assert {r[0] for r in rows} == {r.claim_id for r in bindings.claims(spark, SF).select("claim_id").collect()}
