"""Customers' pages are dealt by key before they are made and redacted."""

from lossgrid.plans import text_queries

SF = "/root/testdata/sf0.001"


def test_customers_are_dealt_before_pages_are_made(spark):
    pages = text_queries._pages(spark, SF)
    assert pages.rdd.getNumPartitions() == 4
    # keys move, texts do not
    above, dealt, below = pages._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")
    assert dealt and "Contact u" in above and "Contact u" not in below
    assert text_queries.redaction_confidence(spark, SF).count() == min(200, pages.count())
