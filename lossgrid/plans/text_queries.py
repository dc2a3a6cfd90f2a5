"""Queries of personal-data, chunking and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest, pii, retrieval
from ..sources import bindings as b
from ..sources.shared import dealt

#: Rules on which every engine agrees about word boundaries in these texts.
SHARED = ("IN_AADHAAR", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "URL")
_PATTERN = {t: p for t, p, _ in pii.RULES}


def _rule_sums(spark, sf, types):
    d = b.table(spark, sf, "documents").select(F.lit("documents").alias("source"), "text")
    p = b.table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text"))
    counted = d.unionByName(p).select("source", pii.rule_counts(F.col("text"), types).alias("n"))
    return counted.groupBy("source").agg(*[F.sum(F.col("n")[t]).alias(t.lower()) for t in types])


def pii_entity_counts(spark, sf):
    """Counts of the shared rules over documents and pages, unmerged."""
    return _rule_sums(spark, sf, SHARED)


def pii_entity_counts_all(spark, sf):
    """All fourteen rules over documents and pages, unmerged."""
    return _rule_sums(spark, sf, tuple(_PATTERN))


def _pages(spark, sf):
    """Customers' pages: each has an e-mail address, some a card or a long number that is not masked."""
    c = dealt(b.table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    text = F.concat(F.lit("Contact u"), k.cast("string"), F.lit("@example.com about the claim. "), F.when(k % 3 == 0, "Card 4111 1111 1111 1111. ").otherwise(""), F.when(k % 4 == 0, "Ref 123456789012. ").otherwise(""), F.repeat(F.lit("text "), (k % 30).cast("int")))
    return c.select((k % 200).alias("claim_id"), k.alias("page_num"), text.alias("raw_text"))


def pii_residual_score(spark, sf):
    hits = sum((pii.count_of(F.col("raw_text"), p) for p in pii.RESIDUAL), F.lit(0))
    per = _pages(spark, sf).groupBy("claim_id").agg(F.sum(hits).cast("long").alias("residual_hits"))
    return per.withColumn("residual_score", F.round(pii.residual_score(F.col("residual_hits")), 4))


def redaction_confidence(spark, sf):
    """Masks e-mail and cards only, so the reference numbers stay behind."""
    done = pii.redact(_pages(spark, sf), scope=("EMAIL_ADDRESS", "CREDIT_CARD"))
    return pii.confidence(done).select("claim_id", F.col("residual_hits").cast("long").alias("residual_hits"), F.round("density_score", 4).alias("density_score"), "confidence_score", "confidence_label", "proceed_status")


def redaction_density(spark, sf):
    """Of a fifth of the pages nothing is personal; long ones among them lower the density of their claim."""
    k = F.col("page_num")
    plain = _pages(spark, sf).withColumn("raw_text", F.when(k % 5 == 0, F.repeat(F.lit("text "), (k % 30).cast("int"))).otherwise(F.col("raw_text")))
    out = pii.confidence(pii.redact(plain))
    return out.select("claim_id", "text_pages", "with_spans", F.round("density_score", 4).alias("density_score"), "confidence_score", "proceed_status")


def _fields(spark, sf):
    c = b.table(spark, sf, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, "FNOL_REGISTRATION_FORM").otherwise("FIR")
    return c.select(k.alias("claim_id"), kind.alias("doc_type"), F.map_from_arrays(F.array(*[F.lit(x) for x in ("member_id", "adjuster_id", "officer_in_charge", "note")]), F.array(F.col("c_name"), F.when(k % 3 == 0, "").otherwise("A1"), F.lit("Officer"), F.when(k % 7 == 0, "call 9876543210").otherwise("fine"))).alias("fields"))


def spii_leak_check(spark, sf):
    safe, _ = pii.split_fields(_fields(spark, sf))
    return pii.leak_check(safe).select("claim_id", F.array_join("leaked_fields", "|").alias("leaked"), "spii_score")


def field_split(spark, sf):
    safe, vault = pii.split_fields(_fields(spark, sf))
    left = safe.select("claim_id", F.array_join(F.array_sort(F.map_keys("fields")), "|").alias("safe_fields"))
    kept = pii.protected_fields(vault).select("claim_id", F.array_join("protected", "|").alias("protected"))
    return left.join(kept, "claim_id", "left")


def pii_spans_merged(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("raw_text"))
    return pii.entity_counts(pii.redact(d)).groupBy("entity_type").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def pii_masked_text(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("raw_text"))
    return pii.redact(d).select("claim_id", "masked_text")


def chunk_pages(spark, sf):
    """Conversations as sources, their turns as pages; small windows, so that they cross pages."""
    t = b.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return retrieval.chunk_pages(t.select(F.col("conv_id").alias("source"), F.col("turn").alias("page_num"), "text"), 40, 5)


def chunk_documents(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.lit(1).alias("page_num"), "text")
    return retrieval.chunk_pages(d).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.min("chunk_id").alias("first_id"))


def chunk_mean_words(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.lit(1).alias("page_num"), "text")
    return retrieval.mean_words(retrieval.chunk_pages(d))


def _index(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")).alias("namespace"), F.format_string("c-%06d", "vec_id").alias("chunk_id"), "embedding", F.col("vec_id").alias("n"))


def embed_dim_check(spark, sf):
    return retrieval.with_dimension(_index(spark, sf), 64).groupBy("namespace", "ok").agg(F.count("*").alias("n"))


def namespace_stats(spark, sf):
    return retrieval.statistics(_index(spark, sf))


def vector_upsert_dedupe(spark, sf):
    """Every fifth vector comes again, and every seventh under a new id."""
    i = _index(spark, sf).select("namespace", "chunk_id", "n")
    again = i.filter("n % 5 = 0").withColumn("n", F.col("n") + 1_000_000)
    new = i.filter("n % 7 = 0").select("namespace", F.concat("chunk_id", F.lit("x")).alias("chunk_id"), "n")
    return retrieval.upsert(i, again.unionByName(new))


def _questions(spark, sf):
    return _index(spark, sf).filter("n % 50 = 0").select(F.col("n").alias("question_id"), F.col("embedding").alias("vector"))


def retrieve_topk(spark, sf):
    return retrieval.retrieve(_questions(spark, sf), _index(spark, sf)).select("question_id", "place", "namespace", "chunk_id", "score")


def retrieve_pivots(spark, sf):
    """The same by an index in cells, which skips those that cannot be near."""
    return nearest.retrieve(_questions(spark, sf), nearest.build(_index(spark, sf))).select("question_id", "place", "namespace", "chunk_id", "score")


def rag_context(spark, sf):
    q = _questions(spark, sf)
    found = retrieval.retrieve(q, _index(spark, sf))
    found = found.select("question_id", "place", F.col("namespace").alias("source_label"), (F.col("n") % 9).alias("page_start"), (F.col("n") % 9 + F.col("n") % 2).alias("page_end"), F.format_string("%.4f", "score").alias("score"), F.col("chunk_id").alias("text"))
    return retrieval.context(found, q)


def rag_history_last6(spark, sf):
    t = b.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return retrieval.last_turns(t).select("conv_id", "turn", F.length("text").alias("chars"))


def _re(t: str) -> str:
    return _PATTERN[t].replace("'", "''")


_PG = """WITH pg AS (SELECT c_custkey % 200 AS claim_id, (c_custkey % 4 = 0)::INT AS ref, (c_custkey % 3 = 0)::INT AS card, length('Contact u' || c_custkey || '@example.com about the claim. ') + CASE WHEN c_custkey % 3 = 0 THEN 26 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 18 ELSE 0 END + 5 * (c_custkey % 30) AS n FROM customer)"""
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_IDX = "WITH ix AS (SELECT 'ns' || label % 2 AS namespace, 'c-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, vec_id AS n FROM embeddings)"
_TOP = _IDX + """, raw AS (SELECT q.n AS question_id, i.namespace, i.chunk_id, i.n, list_cosine_similarity(q.e, i.e) AS raw FROM ix q JOIN ix i ON q.n % 50 = 0),
  near AS (SELECT *, row_number() OVER (PARTITION BY question_id, namespace ORDER BY raw DESC, chunk_id) AS r FROM raw),
  best AS (SELECT *, round(raw, 4) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 4) DESC, namespace, r) AS place FROM near WHERE r <= 3)
"""
SQL = {
    "pii_entity_counts": "SELECT source, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{_re(t)}'))) AS BIGINT) AS {t.lower()}" for t in SHARED) + " FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages) GROUP BY source",
    "pii_residual_score": _PG + " SELECT claim_id, CAST(sum(ref + card) AS BIGINT) AS residual_hits, round(greatest(0.0, 1.0 - CAST(sum(ref + card) AS DOUBLE) * CAST(0.15 AS DOUBLE)), 4) AS residual_score FROM pg GROUP BY claim_id",
    "redaction_confidence": _PG + """, s AS (SELECT claim_id, sum(ref) AS hits, CASE WHEN count(*) FILTER (WHERE n > 100) > 0 THEN 1.0 ELSE 1.0 END AS density, greatest(0.0, 1.0 - CAST(sum(ref) AS DOUBLE) * CAST(0.15 AS DOUBLE)) AS residual FROM pg GROUP BY claim_id),
        c AS (SELECT *, round(CAST(0.4 AS DOUBLE) + residual * CAST(0.3 AS DOUBLE) + CAST(0.2 AS DOUBLE) + CAST(0.6 AS DOUBLE) * CAST(0.1 AS DOUBLE), 3) AS score FROM s)
        SELECT claim_id, CAST(hits AS BIGINT) AS residual_hits, CAST(density AS DOUBLE) AS density_score, score AS confidence_score, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.65 THEN 'MODERATE' ELSE 'LOW' END AS confidence_label, CASE WHEN score >= 0.85 THEN 'PROCEED' WHEN score >= 0.65 THEN 'WARN' ELSE 'HOLD' END AS proceed_status FROM c""",
    "redaction_density": _PG.replace("5 * (c_custkey % 30) AS n", "5 * (c_custkey % 30) AS long, 5 * (c_custkey % 30) AS short, c_custkey % 5 = 0 AS plain").replace(" FROM customer)", " FROM customer)") + """, p AS (SELECT claim_id, CASE WHEN plain THEN short ELSE long END AS n, plain FROM pg),
        s AS (SELECT claim_id, count(*) FILTER (WHERE n > 100) AS text_pages, count(*) FILTER (WHERE n > 100 AND NOT plain) AS with_spans, bool_or(NOT plain) AS any FROM p GROUP BY claim_id),
        d AS (SELECT *, CASE WHEN text_pages > 0 THEN CAST(with_spans AS DOUBLE) / text_pages ELSE CAST(1.0 AS DOUBLE) END AS density FROM s),
        c AS (SELECT *, round(CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) + density * CAST(0.2 AS DOUBLE) + CAST(0.6 AS DOUBLE) * CAST(0.1 AS DOUBLE), 3) AS score FROM d)
        SELECT claim_id, text_pages, with_spans, round(density, 4) AS density_score, score AS confidence_score, CASE WHEN score >= 0.85 THEN 'PROCEED' WHEN score >= 0.65 THEN 'WARN' ELSE 'HOLD' END AS proceed_status FROM c""",
    "spii_leak_check": "SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'FNOL_REGISTRATION_FORM.note' ELSE 'FIR.note' END ELSE '' END AS leaked, CASE WHEN c_custkey % 7 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS spii_score FROM customer",
    "field_split": "SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 2 = 0 THEN 'note|officer_in_charge' ELSE 'adjuster_id|member_id|note' END AS safe_fields, CASE WHEN c_custkey % 2 = 1 THEN 'officer_in_charge' WHEN c_custkey % 3 = 0 THEN 'member_id' ELSE 'adjuster_id|member_id' END AS protected FROM customer",
    "chunk_pages": f"""WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), w AS (SELECT conv_id, turn, {_WORDS} AS ws FROM t),
        f AS (SELECT conv_id AS source, flatten(list(ws ORDER BY turn)) AS ws, flatten(list(list_transform(ws, lambda x: turn) ORDER BY turn)) AS pg FROM w GROUP BY conv_id),
        s AS (SELECT *, unnest(range(0, greatest(1, len(ws) - 40 + 35), 35)) AS st FROM f WHERE len(ws) > 0), c AS (SELECT source, st // 35 AS k, ws[st + 1 : st + 40] AS part, pg[st + 1 : st + 40] AS pp FROM s)
        SELECT source || '-chunk-' || lpad(CAST(k AS VARCHAR), 3, '0') || '-' || substr(md5(source || ':' || array_to_string(part, ' ')), 1, 12) AS chunk_id, CAST(k AS INTEGER) AS chunk_index, source, pp[1] AS page_start, pp[len(pp)] AS page_end, array_to_string(part, ' ') AS text, CAST(len(part) AS INTEGER) AS word_count FROM c""",
    "chunk_documents": f"""WITH f AS (SELECT doc_id AS source, {_WORDS} AS ws FROM documents), s AS (SELECT *, unnest(range(0, greatest(1, len(ws) - 400 + 350), 350)) AS st FROM f WHERE len(ws) > 0),
        c AS (SELECT source, st // 350 AS k, ws[st + 1 : st + 400] AS part FROM s), n AS (SELECT source, len(part) AS m, source || '-chunk-' || lpad(CAST(k AS VARCHAR), 3, '0') || '-' || substr(md5(source || ':' || array_to_string(part, ' ')), 1, 12) AS id FROM c)
        SELECT source, count(*) AS chunks, CAST(sum(m) AS BIGINT) AS words, min(id) AS first_id FROM n GROUP BY source""",
    "embed_dim_check": _IDX + " SELECT namespace, len(e) = 64 AS ok, count(*) AS n FROM ix GROUP BY ALL",
    "namespace_stats": _IDX + " SELECT namespace, count(*) AS vectors FROM ix GROUP BY namespace",
    "vector_upsert_dedupe": _IDX + " SELECT namespace, chunk_id, CASE WHEN n % 5 = 0 THEN n + 1000000 ELSE n END AS n FROM ix UNION ALL SELECT namespace, chunk_id || 'x', n FROM ix WHERE n % 7 = 0",
    "retrieve_topk": _TOP + "SELECT question_id, CAST(place AS INTEGER) AS place, namespace, chunk_id, score FROM best WHERE place <= 6",
    "rag_context": _TOP + """SELECT question_id, string_agg('[Context ' || place || ' | ' || namespace || ' | ' || CASE WHEN n % 2 = 0 THEN 'Page ' || n % 9 ELSE 'Pages ' || n % 9 || '-' || (n % 9 + 1) END || ' | relevance: ' || printf('%.4f', score) || ']' || chr(10) || chunk_id, chr(10) || chr(10) ORDER BY place) AS context FROM best WHERE place <= 6 GROUP BY question_id""",
    "rag_history_last6": "WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t) SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars FROM r WHERE r <= 6",
}
SQL["retrieve_pivots"] = SQL["retrieve_topk"]
SQL["pii_entity_counts_all"] = "SELECT source, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{_re(t)}'))) AS BIGINT) AS {t.lower()}" for t in _PATTERN) + " FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages) GROUP BY source"
SQL["chunk_mean_words"] = SQL["chunk_documents"].replace("CAST(sum(m) AS BIGINT) AS words, min(id) AS first_id", "round(CAST(sum(m) AS DOUBLE) / count(*), 1) AS mean_words")
QUERIES = {k: globals()[k] for k in (*SQL, "pii_spans_merged", "pii_masked_text")}
