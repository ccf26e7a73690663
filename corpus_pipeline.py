"""A corpus from raw documents to packed sequences, stage by stage.

Every stage works on all documents that the one before kept. A stage is written as Parquet to the shared work folder and read again, so that
a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.llm.common import materialise, read_table
from framelight.llm.decontaminate import mark_contamination
from framelight.llm.exact_dedup import exact_dedup
from framelight.llm.ngram_jaccard import ngram_jaccard
from framelight.llm.packing import pack
from framelight.llm.quality import THRESHOLD, fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject; nulls and empty texts are judged like any other."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "__score").filter(F.col("__score") >= THRESHOLD).select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row's own, __key, in the order of doc_id; null doc_ids come last."""
    in_order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return materialise(in_order.withColumn("__key", F.monotonically_increasing_id()))


def by_key(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose key is a doc_id of ``kept``, without the key."""
    return rows.join(kept.select(F.col("doc_id").alias("__key")), "__key", "left_semi").drop("__key")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one row that exact_dedup keeps, also where doc_ids are null or repeated."""
    rows = keyed(docs)
    return by_key(rows, exact_dedup(rows.select(F.col("__key").alias("doc_id"), "text")).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of rows linked by word shingles (five words, similarity 0.8) the one with the smallest doc_id; null comes last."""
    rows = keyed(docs)
    return by_key(rows, ngram_jaccard(rows.select(F.col("__key").alias("doc_id"), "text")).filter("doc_id = component_id"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without an occurrence of any benchmark window."""
    return mark_contamination(docs, read_table(spark, sf_dir, "benchmark"), column="__hits").filter("__hits.n_hit = 0").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece of a document."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

#: Trained scores, similarity joins and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
