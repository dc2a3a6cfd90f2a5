"""From raw documents to packed sequences: STAGES in order, each over all that the one before it kept.

Every stage takes null and empty texts, null ids and sources, repeated rows, empty tables and columns of any name beside
doc_id, text and source as its operator states; the classifier and the rules reject texts without words, packing keeps none of
the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossgrid.llm import common, crf, mixing, near_dup, packing, quality_rules, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labels of this input, predicts good."""
    return crf.keep_good(docs, common.read(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the language references are those of this input."""
    common.ready(spark)
    return quality_rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id."""
    common.ready(spark)
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all included."""
    common.ready(spark)
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a packed document, repeats of the mix included."""
    common.ready(spark)
    return packing.pack(docs, tokens.path_of("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
