"""Rows of signals come without the reasons that they do not show."""

from lossgrid.operators import signals
from lossgrid.plans import triage_queries

SF = "/root/testdata/sf0.001"
SHOWN = ("code", "weight", "triggered", "data_complete")


def test_rows_of_signals_make_no_reason(spark):
    out = triage_queries.signals_long(spark, SF)
    for df in (out, triage_queries.indicator_banner(spark, SF)):
        assert "within the normal reporting window" not in df._jdf.queryExecution().optimizedPlan().toString()
    whole = signals.evaluate(triage_queries._ready(spark, SF)).selectExpr("claim_id", "inline(signals)").select("claim_id", *SHOWN)
    assert out.exceptAll(whole).count() == whole.exceptAll(out).count() == 0 and out.count() > 0
