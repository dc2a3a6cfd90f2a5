"""Queries from questions in words to context, and of dates in free text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import embedding, retrieval
from ..sources import bindings as b
from ..sources.shared import dealt, save
from . import text_queries

DIM = 64


def _chunks(spark, sf):
    """The documents' chunks with their vectors; a document's language is its namespace."""
    d = b.table(spark, sf, "documents")
    chunks = retrieval.chunk_pages(d.select(F.col("doc_id").alias("source"), F.lit(1).alias("page_num"), "text"))
    named = chunks.join(d.select(F.col("doc_id").alias("source"), F.coalesce("lang", F.lit("none")).alias("namespace")), "source")
    rows = named.select("namespace", "chunk_id", F.concat(F.lit("document "), F.col("source").cast("string")).alias("source_label"), "page_start", "page_end", F.substring("text", 1, 40).alias("shown"), "text")
    return save(embedding.embed(rows, embedding.FeatureHash(DIM)).drop("text").withColumnRenamed("shown", "text"), "chunks")


def retrieve_text(spark, sf):
    """The benchmark's items as questions: embedded, put to the documents' chunks, what was found as one text each. Of a chunk its beginning is shown."""
    q = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    _, context = embedding.ask(q, _chunks(spark, sf), embedding.FeatureHash(DIM), 2)
    return context


def date_texts(spark, sf):
    """The orders' dates as people write them, in ten ways, read again."""
    o = dealt(b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 10
    day, name, year = F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM"), F.year(d).cast("string")
    end = F.when(F.dayofmonth(d).isin(1, 21, 31), "st").when(F.dayofmonth(d).isin(2, 22), "nd").when(F.dayofmonth(d).isin(3, 23), "rd").otherwise("th")
    ways = [
        F.concat_ws(" ", F.concat(day, end), name, year), F.concat(name, F.lit(" "), day, F.lit(", "), year), F.date_format(d, "dd.MM.yyyy"), F.concat_ws(" ", day, F.date_format(d, "MMM"), F.date_format(d, "yy")),
        F.concat(F.date_format(d, "EEEE"), F.lit(", "), day, F.lit(" "), name, F.lit(" "), year, F.lit(" 10:30 am")), F.date_format(d, "d/M/yy"), F.date_format(d, "yyyy-MM-dd'T'10:15:00'Z'"),
        F.concat(F.lit("the "), day, end, F.lit(" of "), F.date_format(d, "MMM"), F.lit(". "), year), F.date_format(d, "yyyy/M/d"), F.concat(day, F.lit(" "), name, F.lit(" "), year, F.lit(" or so")),
    ]
    text = F.coalesce(*[F.when(k == i, way) for i, way in enumerate(ways)])  # one way is made, not all ten
    return o.select(F.col("o_orderkey").alias("claim_id"), text.alias("said")).select("claim_id", dates.parse_day(F.col("said"), F.lit(dt.date(2024, 5, 31))).alias("day"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _vectors(rows: str, name: str) -> str:
    return f"""{name}_words AS (SELECT id, md5(w) AS h FROM (SELECT id, unnest({_WORDS}) AS w FROM {rows})),
  {name} AS (SELECT id, CAST('0x' || substr(h, 1, 4) AS INTEGER) % {DIM} AS i, CAST(sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}_words GROUP BY ALL)"""


SQL = {
    "date_texts": "SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "retrieve_text": f"""WITH f AS (SELECT doc_id, coalesce(lang, 'none') AS namespace, {text_queries._WORDS} AS ws FROM documents), s AS (SELECT *, unnest(range(0, greatest(1, len(ws) - 400 + 350), 350)) AS st FROM f WHERE len(ws) > 0),
  c AS (SELECT doc_id, namespace, st // 350 AS k, array_to_string(ws[st + 1 : st + 400], ' ') AS text FROM s),
  ch AS (SELECT doc_id || '-chunk-' || lpad(CAST(k AS VARCHAR), 3, '0') || '-' || substr(md5(doc_id || ':' || text), 1, 12) AS id, doc_id, namespace, text FROM c), qu AS (SELECT item_id AS id, text FROM benchmark),
  {_vectors("ch", "cv")}, {_vectors("qu", "qv")},
  cn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM cv GROUP BY id), qn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM qv GROUP BY id),
  dots AS (SELECT q.id AS question_id, c.id AS chunk_id, sum(q.x * c.x) AS dot FROM qv q JOIN cv c USING (i) GROUP BY ALL),
  raw AS (SELECT qu.id AS question_id, ch.id AS chunk_id, namespace, doc_id, ch.text, coalesce(dot / nullif(qn.norm * cn.norm, 0), 0) AS raw
    FROM qu CROSS JOIN ch LEFT JOIN dots ON dots.question_id = qu.id AND dots.chunk_id = ch.id LEFT JOIN qn ON qn.id = qu.id LEFT JOIN cn ON cn.id = ch.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY question_id, namespace ORDER BY raw DESC, chunk_id) AS r FROM raw QUALIFY r <= 2),
  best AS (SELECT *, round(raw, 4) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 4) DESC, namespace, r) AS place FROM near)
  SELECT question_id, string_agg('[Context ' || place || ' | document ' || doc_id || ' | Page 1 | relevance: ' || printf('%.4f', score) || ']' || chr(10) || substr(text, 1, 40), chr(10) || chr(10) ORDER BY place) AS context FROM best WHERE place <= 4 GROUP BY question_id""",
}
QUERIES = {k: globals()[k] for k in SQL}
