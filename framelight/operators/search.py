"""Similarity search: exact nearest frames for a set of queries, grouped into media items and ranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Query vectors that are broadcast at once; larger query sets are searched block by block.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class RankingWeights:
    visual: float = 0.5
    frames: float = 0.3
    phash: float = 0.2

    def __post_init__(self) -> None:
        if min(self.visual, self.frames, self.phash) < 0 or self.visual + self.frames + self.phash <= 0:
            raise ValueError("weights must not be negative and must add up to more than 0")


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column[0]) if len(column) else 0
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) != size * len(column):
        raise ValueError("vectors differ in dimension")
    return flat.reshape(len(column), size)


def distances(frames: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine distances, frames x queries; 1 where a vector is zero."""
    if frames.shape[1] != queries.shape[1]:
        raise ValueError("vectors differ in dimension")
    length = np.sqrt((frames**2).sum(1))[:, None] * np.sqrt((queries**2).sum(1))[None, :]
    return np.where(length == 0, 1.0, 1 - frames @ queries.T / np.where(length == 0, 1, length))


def knn(frames: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k frames nearest to each query: query_id, frame_id, distance, rank.

    frames: frame_id, embedding; queries: query_id, embedding. A stated query set is compared with all frames, in blocks of at most
    ``block`` vectors: each batch of frames is multiplied with a block and keeps its k best of each query, so that about k rows a query and
    batch are shuffled. Ties are broken by frame_id. k <= 0 gives no rows; null vectors are left out. Filter frames before, never after.
    """
    spark = frames.sparkSession
    schema = "query_id bigint, frame_id bigint, distance double"
    if k <= 0:
        return spark.createDataFrame([], f"{schema}, rank int")
    queries = queries.filter("embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        held = numbered.filter(F.col("block") == b).orderBy("query_id").toArrow()
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(held.column("query_id")), _matrix(held.column("embedding").combine_chunks())))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                frame = np.asarray(batch.column(0))
                d = np.round(distances(_matrix(batch.column(1)), vectors), 12)
                best = np.lexsort((np.broadcast_to(frame[:, None], d.shape), d), axis=0)[:k]
                q = np.broadcast_to(np.arange(len(ids)), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q].ravel()), pa.array(frame[best].ravel()), pa.array(d[best, q].ravel())], names=["query_id", "frame_id", "distance"])

        parts.append(frames.filter("embedding is not null").select(F.col("frame_id").cast("long"), "embedding").mapInArrow(nearest, schema))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "frame_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits of one media item together: query_id, video_id, matching_frames, best_distance, best_frame_id, best_timestamp_ms.

    Of equally near frames the one ranked first wins.
    """
    best = F.min_by(F.struct("frame_id", "timestamp_ms"), F.struct("distance", "rank"))
    return hits.groupBy("query_id", "video_id").agg(F.count("*").alias("matching_frames"), F.min("distance").alias("best_distance"), best.alias("best")).select(
        "query_id", "video_id", "matching_frames", "best_distance", F.col("best.frame_id").alias("best_frame_id"), F.col("best.timestamp_ms").alias("best_timestamp_ms")
    )


def rank_candidates(candidates: DataFrame, frame_phashes: DataFrame, query_phashes: DataFrame, weights: RankingWeights = RankingWeights(), min_score: float = 0.0, exclude: DataFrame | None = None) -> DataFrame:
    """Weighted ranking: query_id, rank, video_id, match_score, visual, frames, phash, and the candidate's columns.

    Exclusions (query_id, video_id or video_id alone) come before the largest frame count is taken, the threshold after scoring. A best frame
    without a signature scores 0 for it.
    """
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must be within 0 and 1")
    if exclude is not None:
        candidates = candidates.join(exclude, [c for c in ("query_id", "video_id") if c in exclude.columns], "left_anti")
    joined = candidates.join(frame_phashes.select(F.col("frame_id").alias("best_frame_id"), F.col("phash").alias("frame_phash")), "best_frame_id", "left").join(query_phashes.select("query_id", F.col("phash").alias("query_phash")), "query_id", "left")
    most = F.max("matching_frames").over(Window.partitionBy("query_id"))
    scored = joined.select(
        "query_id", "video_id", "matching_frames", "best_distance", "best_frame_id", "best_timestamp_ms",
        C.clamp01(1 - F.col("best_distance")).alias("visual"), (F.col("matching_frames") / most).alias("frames"),
        F.coalesce(C.clamp01(1 - C.hamming("frame_phash", "query_phash") / 64.0), F.lit(0.0)).alias("phash"),
    )
    total = weights.visual + weights.frames + weights.phash
    score = (weights.visual * F.col("visual") + weights.frames * F.col("frames") + weights.phash * F.col("phash")) / total
    scored = scored.withColumn("match_score", F.round(score, 9)).filter(F.col("match_score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "best_distance", "video_id")
    return scored.withColumn("rank", F.row_number().over(order))


def search(frames: DataFrame, queries: DataFrame, k: int = 10, include_excluded: bool = False, videos: DataFrame | None = None, **ranking) -> DataFrame:
    """Nearest frames, grouped and ranked, in one plan. frames: frame_id, video_id, timestamp_ms, embedding, phash; videos: video_id, excluded."""
    if videos is not None and not include_excluded:
        frames = frames.join(videos.filter("excluded").select("video_id"), "video_id", "left_anti")
    hits = knn(frames, queries, k).join(frames.select("frame_id", "video_id", "timestamp_ms"), "frame_id")
    return rank_candidates(group_hits(hits), frames, queries, **ranking)


def index_stats(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("frames"), F.count("embedding").alias("vectors"))
