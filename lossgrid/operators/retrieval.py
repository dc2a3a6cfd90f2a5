"""Chunks of guideline text, an index of vectors by namespace, exact nearest chunks, and the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import on_workers
from ..sources.shared import save
from . import blocks

CHUNK_WORDS, OVERLAP = 400, 50
#: Questions, and vectors, that are sent to one task at most; the numbers in each; tasks that fewer vectors are dealt to, if there are 1,024 for each.
BROADCAST_QUESTIONS, BLOCK, NUMBERS, TASKS = 16384, 65536, 2**22, 16
NO_CONTEXT = "No relevant content found in the guidelines."


#: Pages of a source that are counted together; a source of any length is as many pieces of work as it has such ranges.
PAGE_RANGE = 256


def chunk_pages(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """pages (source, page_num, text) to sliding windows of words: chunk_id, chunk_index, source, page_start, page_end, text, word_count.

    Each page finds the windows that it reaches from the number of words before it and cuts its part of each. Pages are dealt by
    source and range of PAGE_RANGE pages; what stands before a range is known from the ranges' counts, so of a source only
    these numbers meet, never its words. A source without words gives none.
    """
    step = max(1, size - overlap)
    p = pages.select("source", "page_num", "text", _count_words(F.col("text")).alias("n")).filter("n > 0")
    p = p.withColumn("range", F.floor(F.col("page_num") / PAGE_RANGE))
    counts = p.groupBy("source", "range").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("source").orderBy("range")
    before = counts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("total"))
    inside = Window.partitionBy("source", "range").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    p = p.join(before, F.col("source").eqNullSafe(F.col("_s")) & F.col("range").eqNullSafe(F.col("_r"))).withColumn("at", F.col("at") + F.col("before"))
    p = p.withColumn("last", F.floor((F.greatest(F.lit(1), F.col("total") - size + step) - 1) / step))  # index of the last window
    lo = F.greatest(F.lit(0), F.floor((F.col("at") - size) / step) + 1)
    hi = F.least(F.col("last"), F.floor((F.col("at") + F.col("n") - 1) / step))
    # the text moves as it is, its words are made where its windows are
    p = p.filter(lo <= hi).withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))

    def cut(k: Column) -> Column:
        begin, end = F.greatest(F.lit(0), k * step - F.col("at")), F.least(F.col("n"), k * step + size - F.col("at"))
        return F.struct(k.alias("k"), F.array_join(F.slice("words", (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("part"), (end - begin).alias("m"))

    windows = lambda p: p.select("source", "page_num", "total", F.explode(F.transform(F.sequence(lo, hi), cut)).alias("w")).select("source", "page_num", "total", "w.*")
    # a window that one page holds is done; parts of the others meet, and a source's only page has none
    alone = F.col("m") == F.least(F.lit(size), F.col("total") - F.col("k") * step)
    whole = windows(p).filter(alone).select("source", "k", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), F.col("m").cast("int").alias("word_count"), F.col("part").alias("text"))
    crossing = windows(p.filter("n < total")).filter(~alone).groupBy("source", "k").agg(F.sort_array(F.collect_list(F.struct("page_num", "part"))).alias("parts"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.sum("m").cast("int").alias("word_count"))
    crossing = crossing.withColumn("text", F.array_join(F.transform("parts", lambda x: x["part"]), " ")).drop("parts")
    got = whole.unionByName(crossing)
    return got.select(chunk_id(F.col("source"), F.col("k"), F.col("text")).alias("chunk_id"), F.col("k").cast("int").alias("chunk_index"), "source", "page_start", "page_end", "text", "word_count")


def _count_words(text: Column) -> Column:
    """The number of words that a split at white space gives, without making them. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    source = source.cast("string")
    return F.format_string("%s-chunk-%03d-%s", source, index.cast("long"), F.substring(F.md5(F.concat(source, F.lit(":"), text)), 1, 12))


def whole_mean_words(chunks: DataFrame) -> DataFrame:
    """Chunks and mean words a chunk of each source, whole words, the rest cut off."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.floor(F.sum("word_count") / F.count("*")).alias("mean_words"))


def mean_words(chunks: DataFrame) -> DataFrame:
    """Chunks and mean words a chunk of each source, to one decimal."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("word_count"), 1).alias("mean_words"))


def messages(questions: DataFrame, contexts: DataFrame, turns: DataFrame, system: str, keep: int = 6) -> DataFrame:
    """The messages of each question in order: question_id, pos, role, content; the system text with the context, the last
    turns of its conversation (conv_id), the question itself."""
    first = questions.join(contexts, "question_id", "left").select("question_id", F.lit(-1).cast("long").alias("at"), F.lit("system").alias("role"), F.concat(F.lit(system), F.lit("\n\n"), F.coalesce("context", F.lit(NO_CONTEXT))).alias("content"))
    past = questions.select("question_id", "conv_id").join(last_turns(turns, keep), "conv_id").select("question_id", F.col("turn").cast("long").alias("at"), "role", F.col("text").alias("content"))
    last = questions.select("question_id", F.lit(2**62).alias("at"), F.lit("user").alias("role"), F.col("question").alias("content"))
    rows = first.unionByName(past).unionByName(last)
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy("at")) - 1
    return rows.select("question_id", pos.alias("pos"), "role", "content")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """index (namespace, chunk_id, ..) with the rows of new put in or over; of new's repeats one stays."""
    key = ["namespace", "chunk_id"]
    return index.join(new.select(*key), key, "left_anti").unionByName(new.dropDuplicates(key))


def statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("namespace").agg(F.count("*").alias("vectors"))


def with_dimension(index: DataFrame, dim: int) -> DataFrame:
    """index with ok: whether a row's vector has the dimension; null has none."""
    return index.withColumn("ok", F.coalesce(F.size("embedding") == dim, F.lit(False)))


def wrong_dimension(index: DataFrame, dim: int) -> DataFrame:
    return with_dimension(index, dim).filter("NOT ok").drop("ok")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is zero, null or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def retrieve(questions: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """questions (question_id, vector) and index (namespace, chunk_id, embedding, ..): of each namespace the k nearest by cosine,
    together the 2 * k best, ties by namespace and chunk_id.

    Blocks of questions meet blocks of vectors as products of matrices, so every pair is looked at and none becomes a row; what may be among the
    nearest is scored again by the one expression of cosine. Vectors move once for each BROADCAST_QUESTIONS questions, questions once for each block
    of vectors: blocks are as large as memory allows, whatever the number of shuffle partitions, as each gives every question its own nearest.
    The index is read three times.
    """
    on_workers(index.sparkSession)
    questions = save(questions.select("question_id", "vector"), "questions")
    asked, held = (df.agg(F.count("*").alias("n"), F.max(F.size(c)).alias("dim")).first() for df, c in ((questions, "vector"), (index, "embedding")))
    fit = NUMBERS // max(1, asked["dim"] or 0, held["dim"] or 0)
    blocks_of = lambda n, most: -(-n // max(1, min(most, fit)))
    few = min(TASKS, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held["n"] // 1024))
    asks, parts = max(1, blocks_of(asked["n"], BROADCAST_QUESTIONS)), max(1, blocks_of(held["n"], BLOCK), few)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = questions.withColumns({"_q": F.pmod(F.xxhash64("question_id"), F.lit(asks)).cast("int"), "least": F.lit(blocks.NONE)}).withColumn("_v", each(parts))
    right = index.select("namespace", "chunk_id", "embedding", F.pmod(F.xxhash64("namespace", "chunk_id"), F.lit(parts)).cast("int").alias("_v")).withColumn("_q", each(asks))
    found = blocks.best(blocks.met(left, right, ["_q", "_v"], k), k)
    return placed(rejoined(found, questions, index), k)


def rejoined(found: DataFrame, questions: DataFrame, index: DataFrame) -> DataFrame:
    """found (question_id, namespace, chunk_id) with the question's vector and the columns of the index; nulls are equal."""
    f = found.select(F.col("question_id").alias("_fq"), F.col("namespace").alias("_fn"), F.col("chunk_id").alias("_fc"))
    with_index = f.join(index, F.col("_fn").eqNullSafe(index["namespace"]) & F.col("_fc").eqNullSafe(index["chunk_id"])).drop("_fn", "_fc")
    return with_index.join(questions.select("question_id", "vector"), F.col("_fq").eqNullSafe(F.col("question_id"))).drop("_fq")


def placed(met: DataFrame, k: int) -> DataFrame:
    """Questions beside vectors (question_id, vector, namespace, chunk_id, embedding, ..): of each namespace the k nearest, and the place of each."""
    pairs = met.withColumn("raw", cosine(F.col("vector"), F.col("embedding"))).drop("vector", "embedding")
    best = F.row_number().over(Window.partitionBy("question_id", "namespace").orderBy(F.desc("raw"), "chunk_id"))
    near = pairs.withColumn("r", best).filter(F.col("r") <= k).withColumn("score", F.round("raw", 4))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "namespace", "r"))
    return near.withColumn("place", place).filter(F.col("place") <= 2 * k).drop("raw", "r")


def context(found: DataFrame, questions: DataFrame) -> DataFrame:
    """found (question_id, place, source_label, page_start, page_end, score, text) as one numbered text a question."""
    page = F.when(F.col("page_start") == F.col("page_end"), F.format_string("Page %s", F.col("page_start").cast("string"))).otherwise(F.format_string("Pages %s-%s", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    block = F.concat(F.lit("[Context "), F.col("place").cast("string"), F.lit(" | "), "source_label", F.lit(" | "), page, F.lit(" | relevance: "), F.col("score").cast("string"), F.lit("]\n"), "text")
    joined = found.withColumn("block", block).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    return questions.select("question_id").join(joined, "question_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def last_turns(turns: DataFrame, keep: int = 6) -> DataFrame:
    """turns (conv_id, turn, ..): the last of each conversation."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_r", r).filter(F.col("_r") <= keep).drop("_r")
