"""State of the index as DataFrames: every operation takes the old state and gives the new one; writing it is a separate, atomic step."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["video_id", "frame_seq"]


def last_write(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return batch.withColumn("__r", rank).filter("__r = 1").drop("__r")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``batch`` replace those with equal keys; within the batch the last by ``order`` wins. Columns are those of ``existing``."""
    batch = last_write(batch, keys, order) if order else batch
    return existing.join(batch.select(*keys), keys, "left_anti").unionByName(batch.select(existing.columns))


def insert_missing(existing: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose keys are new are added, once each; others are ignored."""
    batch = last_write(batch, keys, order) if order else batch.dropDuplicates(keys)
    return existing.unionByName(batch.select(existing.columns).join(existing.select(*keys), keys, "left_anti"))


def replacement_faults(batch: DataFrame, videos: DataFrame) -> DataFrame:
    """Reasons why a batch may not replace the frames of ``videos``: (video_id, fault), one row each."""
    one = batch.groupBy("video_id").agg(F.count("*").alias("n"), F.count_distinct("frame_id").alias("ids"), F.count("timestamp_ms").alias("timed"), F.count_distinct("timestamp_ms").alias("times"))
    joined = videos.select("video_id", F.lit(True).alias("asked")).join(one, "video_id", "full_outer")
    faults = F.array(F.when(F.col("n").isNull(), "empty"), F.when(F.col("asked").isNull(), "foreign"), F.when(F.col("ids") < F.col("n"), "duplicate_id"), F.when(F.col("times") < F.col("timed"), "duplicate_position"))
    return joined.select("video_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def replace_frames(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """All frames of the items in ``batch`` are replaced by it."""
    return existing.join(batch.select("video_id").distinct(), "video_id", "left_anti").unionByName(batch.select(existing.columns))


def soft_delete(videos: DataFrame, frames: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks items as excluded and drops their frames."""
    return set_flag(videos, ids, "excluded", True), frames.join(ids.select("video_id"), "video_id", "left_anti")


def set_flag(videos: DataFrame, ids: DataFrame, flag: str, value: bool) -> DataFrame:
    """Sets a flag of the items named, leaving their frames."""
    marked = videos.join(ids.select("video_id").distinct().withColumn("__hit", F.lit(True)), "video_id", "left")
    return marked.withColumn(flag, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(flag))).select(videos.columns)


def changed_rows(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """How many rows changed, nulls compared as values."""
    return old.select(key, F.col(column).alias("__old")).join(new.select(key, F.col(column).alias("__new")), key).agg(F.count_if(~F.col("__old").eqNullSafe(F.col("__new"))).alias("changed"))


def upsert_items(existing: DataFrame, batch: DataFrame, overwrite: list[str]) -> DataFrame:
    """Upsert of items by (source, external_id): metadata columns are overwritten, null included; all others of a known item stay."""
    keys = ["source", "external_id"]
    rest = [c for c in existing.columns if c not in keys + overwrite]
    new = batch.select(*keys, *(F.col(c).alias(f"__{c}") for c in overwrite), *(F.col(c).alias(f"__{c}") for c in rest), F.lit(True).alias("__new"))
    joined = existing.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    pick = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in overwrite] + [F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in rest]
    return joined.select(*keys, *pick).select(existing.columns)


def purge_older(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Keeps rows not older than ``days`` days."""
    return rows.filter(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def states_after(transitions: DataFrame) -> DataFrame:
    """Latest state of each item from a log (video_id, seq, status, frame_count, duration_ms, error).

    A restart keeps count and duration known before; an indexed item has no error.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = transitions.groupBy("video_id").agg(F.max_by("status", "seq").alias("status"), last("frame_count").alias("frame_count"), last("duration_ms").alias("duration_ms"), F.max_by("error", "seq").alias("e"))
    return out.withColumn("error", F.when(F.col("status") != "indexed", F.col("e"))).drop("e")


def publish_all(tables: dict[str, DataFrame], root: str) -> str:
    """Writes a new version of all tables beside the old ones and then a pointer to it with the next number.

    Readers take the pointer with the largest number, so the tables change together, and a write that fails anywhere leaves the old version
    in force: there is nothing to roll back. Pointers are only ever added.
    """
    spark, version = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    number = (_pointer(spark, root) or (0, ""))[0] + 1
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/_versions")
    return version


def publish(df: DataFrame, root: str) -> str:
    """publish_all of a single table."""
    return publish_all({"data": df}, root)


def current(spark: SparkSession, root: str, name: str = "data") -> DataFrame:
    return spark.read.parquet(f"{root}/{_pointer(spark, root)[1]}/{name}")


_POINTER = "number bigint, version string"


def _pointer(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema(_POINTER).json(f"{root}/_versions").agg(F.max(F.struct("number", "version")).alias("p")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tuple(row["p"]) if row["p"] else None
