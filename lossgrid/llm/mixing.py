"""Mixing sources to target weights: rates of repetition from token totals, then whole and hash-drawn copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
#: A source gives at most so many times its size.
MOST = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: (source, size), one row a document. One row a source: source, source_size, target, rate.

    All sizes together are shared by weight; what a source would get above most times its size
    goes to the others by weight again. In the order of size per weight, the sources that are cut
    come first, so the level is found with running totals and no loop. A source of size 0 gets 0.
    """
    least = 1
    for w in weights:
        least *= w
    totals = sizes.groupBy("source").agg(F.sum("size").cast("decimal(38,0)").alias("s"))
    first = [F.col("source").isNull(), F.col("source")]
    ranked = common.totals_before(totals, first, {"place": F.lit(1)}, "mix-sources")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).cast("decimal(38,0)"))
    ranked = ranked.withColumn("per", (F.col("s") * (F.lit(least) / F.col("w")).cast("decimal(10,0)")).cast("decimal(38,0)"))
    run = common.totals_before(ranked.select("source", "s", "w", "per"), [F.col("per"), F.col("source").isNull(), F.col("source")], {"s_before": F.col("s"), "w_before": F.col("w")}, "mix-order")
    run = common.save(run, "mix-run")
    whole = run.agg(F.sum("s").alias("s_all"), F.sum("w").alias("w_all"))
    j = run.crossJoin(F.broadcast(whole))  # one row
    d = lambda c: c.cast("decimal(38,0)")
    left = d(F.col("s_all") - most * F.col("s_before"))
    weight = d(F.col("w_all") - F.col("w_before"))
    j = j.withColumn("cut", d(most * F.col("s") * weight) < d(left * F.col("w")))
    kept = j.agg(
        d(F.coalesce(F.sum(F.when(F.col("cut"), most * F.col("s"))), F.lit(0))).alias("given"),
        d(F.coalesce(F.sum(F.when(~F.col("cut"), F.col("w"))), F.lit(0))).alias("w_left"),
    )
    out = j.crossJoin(F.broadcast(kept))  # one row
    share = (d((F.col("s_all") - F.col("given")) * F.col("w"))).cast("double") / F.col("w_left").cast("double")
    out = out.withColumn("target", F.when(F.col("cut"), d(most * F.col("s")).cast("double")).otherwise(share))
    rate = F.when(F.col("s") > 0, F.least(F.col("target") / F.col("s").cast("double"), F.lit(float(most)))).otherwise(0.0)
    return out.select("source", F.col("s").cast("long").alias("source_size"), "target", rate.alias("rate"))


def mix(docs: DataFrame, size: F.Column, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each row.

    docs needs doc_id, source and what size reads; its columns size, source_size, target, rate and
    copies, if any, are replaced. copies is floor(rate), and one more with the fraction as probability,
    drawn from md5 of seed and doc_id: reruns agree and rows with one doc_id share the draw. Null
    source is a source of its own, the last; null doc_id draws as an empty id; null size counts 0.
    """
    own, = common.fresh(docs, "s")
    base = docs.withColumn("size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))).drop("source_size", "target", "rate", "copies")
    targets = common.save(source_targets(base.select("source", "size"), weights, most), "mix-targets")
    t = targets.select(F.col("source").alias(own), "source_size", "target", "rate")
    # one row a source; Spark broadcasts it only under its size limit, else AQE splits the hot source
    out = base.join(t, F.col("source").eqNullSafe(F.col(own))).drop(own)
    draw = common.hash_fraction(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int"))


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as copies says."""
    copy, = common.fresh(mixed, "copy")
    out = mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*columns)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others) as often as the mix takes them, by their number of words, with all their
    columns, whatever their names. Nulls and repeated rows as in mix(); an empty table stays empty."""
    place = {name: F.col(f"c{docs.columns.index(name)}").alias(name) for name in ("doc_id", "text", "source")}
    work = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    mixed = mix(work.select(*work.columns, *place.values()), n_words(F.col("text")), seed, weights, most)
    return emit(mixed, work.columns).toDF(*docs.columns)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents: doc_id, size, source_size, target, taken. Nulls and repeated rows as in mix(); an empty table gives no
    rows; other columns take no part."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = common.save(docs, "mix-sizes")
    out = mix(docs, F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


_SHARES = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), totals AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w
  FROM sized GROUP BY source
), run AS (
  SELECT *, coalesce(sum(s) OVER o, 0) AS s_before, coalesce(sum(w) OVER o, 0) AS w_before,
         sum(s) OVER () AS s_all, sum(w) OVER () AS w_all
  FROM totals WINDOW o AS (ORDER BY s * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT *, 3 * s * (w_all - w_before) < (s_all - 3 * s_before) * w AS is_cut FROM run
), level AS (
  SELECT *, coalesce(sum(3 * s) FILTER (WHERE is_cut) OVER (), 0) AS given, sum(w) FILTER (WHERE NOT is_cut) OVER () AS w_left FROM cut
), target AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
         CASE WHEN is_cut THEN CAST(3 * s AS DOUBLE) ELSE CAST((s_all - given) * w AS DOUBLE) / CAST(w_left AS DOUBLE) END AS target
  FROM level
), rated AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / CAST(t.source_size AS DOUBLE), 3.0) ELSE 0.0 END AS rate
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN
      CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rated
)
"""

SQL = _SHARES.format(docs="documents") + "SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM drawn"
