"""Score and counts come without the texts of the signals."""

from pyspark.sql import functions as F

from lossgrid.plans import triage_queries

SF = "/root/testdata/sf0.001"


def test_no_reason_is_made_for_a_score(spark):
    out = triage_queries._scored(spark, SF)
    assert "inception date" not in out.select("claim_id", "score", "band", "n_triggered", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    sums = out.select("score", "incomplete", "n_triggered", F.expr("aggregate(signals, 0, (s, x) -> s + x.weight)").alias("w"), F.expr("size(filter(signals, x -> NOT x.data_complete))").alias("i"), F.expr("size(filter(signals, x -> x.triggered))").alias("n"))
    assert sums.filter("score <> w OR incomplete <> i OR n_triggered <> n").count() == 0 and sums.count() > 0
