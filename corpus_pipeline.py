"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import packing, quality, queries, simhash
from rowmill.llm.registry import prepare
from rowmill.plans.registry import Tables
from rowmill.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject. Repeated rows and NULL texts are judged like any other."""
    return queries.text_toxicity(Tables(prepare(spark), sf_dir), docs.select(*COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; NULL and empty texts have no words and go."""
    prepare(spark)
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, once; documents without an id stay out of groups."""
    prepare(spark)
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    single = kept.groupBy("doc_id").agg(*[F.min(F.struct(*COLUMNS[1:])).alias("_row")]).select("doc_id", "_row.*")
    return single.union(docs.select(*COLUMNS).where(F.col("doc_id").isNull()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    prepare(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_repetitive), ("simhash", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(prepare(spark), sf_dir).documents
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
