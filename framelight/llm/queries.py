"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_classifier

    return quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(read_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(read_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import ngram_jaccard

    return ngram_jaccard(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_score

    return lm_score(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_harmonic_packing, op3_separator_scan, op4_url_filter, op5_exact_dedup, op6_substring_dedup, op7_decontamination, op8_language_id, op9_ngram_jaccard, op10_lm_scoring)}


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": f"""
            with d as (select doc_id, sha256({_NORM}) as text_sha256, length(coalesce(text, '')) as chars from documents)
            select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
                   doc_id = first_value(doc_id) over w as kept, text_sha256
            from d window w as (partition by text_sha256 order by chars desc, doc_id)""",
    }
