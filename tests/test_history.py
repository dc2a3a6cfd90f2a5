"""History in one pass: against a plain count, at the edges of months, and with one vehicle of very many claims."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lossgrid.operators import history, numbering, register
from lossgrid.sources.providers import Model

CLAIM = "claim_id int, vehicle_reg string, member_id string, incident_date date"
PRIOR = "row_pos int, prior_id string, vehicle_reg string, member_id string, claim_date date, prior_type string, ncb_impact boolean"


def months_before(day, months):
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, m + 1, min(day.day, last))


def plain(claims, prior):
    out = {}
    for cid, vehicle, member, day in claims:
        same = lambda a, b: (a or "").strip().upper() == (b or "").strip().upper() != ""
        if day is None:
            out[cid] = (None, None, None, 0, None, None, None)
            continue
        found = sorted(p for p in prior if same(p[2], vehicle) and p[4] and months_before(day, 36) <= p[4] < day)
        n12 = sum(1 for p in prior if same(p[3], member) and p[4] and months_before(day, 12) <= p[4] < day)
        last = max((p[4] for p in found), default=None)
        latest = max(found, key=lambda p: (p[4], p[0]), default=None)
        out[cid] = (len(found), last, (day - last).days if last else None, sum(bool(p[6]) for p in found), found[0][1] if found else None, latest and latest[1], n12)
    return out


def measured(spark, claims, prior):
    got = history.full_history(spark.createDataFrame(claims, CLAIM).withColumn("ncb_percent", F.lit(10.0)), spark.createDataFrame(prior, PRIOR)).collect()
    return {r.claim_id: (r.prior_claims_36m_count, r.last_claim_date, r.days_since_last_claim, r.ncb_impact_claims, r.first_prior_id, r.latest_prior_id, r.prior_claims_12m_count) for r in got}


def test_against_a_plain_count(spark):
    rng = random.Random(4)
    edge = [dt.date(2024, 2, 29), dt.date(2021, 2, 28), dt.date(2021, 3, 1), dt.date(2020, 2, 29), dt.date(2023, 2, 28), dt.date(2023, 3, 31), dt.date(2020, 3, 31), dt.date(2021, 1, 1), dt.date(2024, 1, 1), dt.date(2023, 3, 1)]
    days = edge + [dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(1900)) for _ in range(60)]
    keys = ["v1", " V1 ", "v2", "", None, "  "]
    claims = [(i, rng.choice(keys), rng.choice(keys), rng.choice([*days, None])) for i in range(300)] + [(1000 + i, "v1", "v2", d) for i, d in enumerate(edge)]
    prior = [(i, f"p{i}", rng.choice(keys), rng.choice(keys), rng.choice([*days, *edge, None]), "FIRE", rng.choice([True, False, None])) for i in range(400)]
    assert measured(spark, claims, prior) == plain(claims, prior)
    rows = history.history_rows(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(prior, PRIOR)).collect()
    want = plain(claims, prior)
    for cid in (1000, 1001, 1008):
        mine = sorted((r.pos, r.prior_id) for r in rows if r.claim_id == cid)
        assert len(mine) == want[cid][0] and [p for p, _ in mine] == list(range(len(mine))) and (not mine or mine[0][1] == want[cid][4])


def test_one_vehicle_of_very_many_claims(spark):
    start = dt.date(2015, 1, 1)
    claims = spark.range(100_000).select(F.col("id").cast("int").alias("claim_id"), F.lit("hot").alias("vehicle_reg"), F.lit("m").alias("member_id"), F.date_add(F.lit(start), (F.col("id") % 3000).cast("int")).alias("incident_date"))
    prior = claims.select(F.col("claim_id").alias("row_pos"), F.col("claim_id").cast("string").alias("prior_id"), "vehicle_reg", "member_id", F.col("incident_date").alias("claim_date"), F.lit("FIRE").alias("prior_type"), F.lit(True).alias("ncb_impact"))
    out = history.vehicle_history(claims.withColumn("ncb_percent", F.lit(0.0)), prior)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for join in (line for line in plan.splitlines() if "Join" in line):
        assert " < " not in join and " >= " not in join
    got = {r.claim_id: r.prior_claims_36m_count for r in out.filter("claim_id IN (0, 1, 2999, 99999)").collect()}
    per_day = [sum(1 for i in range(d, 100_000, 3000)) for d in range(3000)]

    def counted(i):
        day = start + dt.timedelta(i % 3000)
        first = max(0, (months_before(day, 36) - start).days)
        return sum(per_day[first : i % 3000])

    assert got == {i: counted(i) for i in (0, 1, 2999, 99999)}


def test_numbers_follow_one_by_one(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("nth_text")).repartition(9)
    got = numbering.numbered(rows, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert numbering.numbered(rows.limit(0), ["k"], "n").count() == 0
    same = numbering.numbered(spark.range(1000).select(F.lit(1).alias("k")), ["k"], "n", 0).collect()
    assert sorted(r.n for r in same) == list(range(1000))
    reg = spark.createDataFrame([("FNOL-2024-0099", 0), ("other", 1), ("FNOL-2023-0003", 2)], "fnol_id string, row_pos long")
    new = register.number_batch(reg, spark.createDataFrame([("b",), ("a",), ("c",)], "member_id string"), 2026, ["member_id"])
    assert sorted((r.fnol_id, r.member_id) for r in new.collect()) == [("FNOL-2026-0100", "a"), ("FNOL-2026-0101", "b"), ("FNOL-2026-0102", "c")]
    out = register.append(reg, new, dt.datetime(2026, 1, 1)).collect()
    assert sorted((r.row_pos, r.fnol_id) for r in out)[3:] == [(3, "FNOL-2026-0100"), (4, "FNOL-2026-0101"), (5, "FNOL-2026-0102")]


def test_failing_rows_fail_alone(spark):
    def make():
        def call(pdf):
            if pdf["x"].isin([17, 500, 999]).any():
                raise ValueError
            return pdf["x"].astype(str)

        return call

    got = Model(make, ("x",), "answer").apply(spark.range(1000).withColumnRenamed("id", "x").coalesce(2), ("x",), "failed").collect()
    assert sorted(r.x for r in got if r.answer == "failed") == [17, 500, 999] and sum(r.answer == str(r.x) for r in got) == 997
