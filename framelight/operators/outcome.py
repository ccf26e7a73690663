"""What a refinement leaves: rewritten results, evidence, telemetry, fallback; and small writes to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rewrite(ranked: DataFrame, refined: DataFrame) -> DataFrame:
    """Results with the timestamps that refinement found; order and scores stay. refined: search_id, video_id, timestamp_ms, one row each."""
    new = refined.select("search_id", "video_id", F.col("timestamp_ms").alias("__t"))
    return ranked.join(new, ["search_id", "video_id"], "left").withColumn("timestamp_ms", F.coalesce("__t", "timestamp_ms")).drop("__t")


def evidence(ranked: DataFrame, provenance: DataFrame) -> DataFrame:
    """A row for each result whose time came from a named asset: candidate_rank is the place in the whole result. provenance: search_id, video_id, origin, asset_kind, asset_url, status."""
    place = ranked.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("search_id").orderBy("rank")))
    kept = provenance.filter("origin = 'refined_asset' and asset_kind is not null and asset_url is not null").withColumn("selected", F.col("status") == "improved")
    return place.join(kept, ["search_id", "video_id"]).select("search_id", "video_id", "candidate_rank", "asset_kind", "asset_url", "selected")


def telemetry(summaries: DataFrame, search_timeout_ms: int) -> DataFrame:
    """Telemetry of summaries (status, ranked, requested, evaluated, discarded, elapsed_ms): assets asked for, and why a search was limited."""
    reason = F.when(F.col("status") == "limited", F.when(F.col("ranked") > F.col("requested"), "candidate_limit").when(F.col("elapsed_ms") >= search_timeout_ms, "search_timeout").otherwise("budget_exhausted"))
    return summaries.withColumns({"assets_requested": F.col("evaluated") + F.col("discarded"), "limit_reason": reason})


def fallback(ranked: DataFrame, status: str) -> DataFrame:
    """The base results, unchanged, of a refinement that is ``disabled`` or ``failed``."""
    if status not in ("disabled", "failed"):
        raise ValueError("a fallback is disabled or failed")
    return ranked.withColumns({"refinement_status": F.lit(status), "improved": F.lit(False), "origin": F.lit("indexed_frame")})


def set_if_different(rows: DataFrame, targets: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``rows`` with the value in ``column`` where the key is a target, and changed: whether that was another value (or null) before."""
    hit = rows.join(targets.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    changed = F.col("__hit").isNotNull() & ~F.col(column).eqNullSafe(value)
    return hit.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), value).otherwise(F.col(column))).drop("__hit")


def delete_source(sources: DataFrame, children: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without those of ``gone`` (source), and children whose source is null where it went."""
    lost = gone.select("source").distinct().withColumn("__gone", F.lit(True))
    kept = children.join(lost, "source", "left").withColumn("source", F.when(F.col("__gone").isNull(), F.col("source"))).drop("__gone")
    return sources.join(lost, "source", "left_anti"), kept


def register_sources(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per source: fields of its manifest (source, base_url) where there is one; enabled stays, and is false at first."""
    m = manifests.select("source", F.col("base_url").alias("__url"))
    out = sources.join(m, "source", "full_outer")
    return out.select("source", F.coalesce("__url", "base_url").alias("base_url"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


def reconcile(videos: DataFrame, found: DataFrame) -> DataFrame:
    """Frame counts and durations of an index, where given and not negative; the status stays. found: video_id, frame_count, duration_ms."""
    f = found.filter("frame_count >= 0 and coalesce(duration_ms, 0) >= 0").select("video_id", F.col("frame_count").alias("__n"), F.col("duration_ms").alias("__d"))
    return videos.join(f, "video_id", "left").withColumns({"frame_count": F.coalesce("__n", "frame_count"), "duration_ms": F.coalesce("__d", "duration_ms")}).drop("__n", "__d")


def merge_result(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Payloads (JSON objects of texts) with the keys of a result set, for jobs of type REINDEX only. results: job_id, outcome, frames, reason."""
    r = results.select("job_id", F.create_map(F.lit("result_outcome"), F.col("outcome"), F.lit("result_frames"), F.col("frames").cast("string"), F.lit("result_reason"), F.col("reason")).alias("__new"))
    old = F.coalesce(F.from_json("payload", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    new = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("__new"), k)), F.col("__new"))
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(new)))
    merged = F.when((F.col("job_type") == "REINDEX") & F.col("__new").isNotNull(), F.to_json(sorted_, {"ignoreNullFields": "false"})).otherwise(F.col("payload"))
    return jobs.join(r, "job_id", "left").withColumn("payload", merged).drop("__new")
