"""The register's look-up of all its ids and unknown ones, against its SQL."""

from collections import Counter

import duckdb

from lossgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_id_is_looked_up(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    rows = [tuple(r) for r in catalogue.QUERIES["register_lookup_all"](spark, SF).collect()]
    assert Counter(rows) == Counter(con.execute(catalogue.ORACLES["register_lookup_all"]).fetchall())
    assert len({r[1] for r in rows if r[1]}) == con.execute("SELECT count(DISTINCT o_orderkey) FROM orders").fetchone()[0]
