"""Second pass over ranked results: which candidates and assets are looked at, which time wins, and what is told about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_prefix(ranked: DataFrame, limit: int = 3, limits: DataFrame | None = None) -> DataFrame:
    """Results to refine: at most a source's own limit of each source, then at most ``limit`` in all, in rank order. ranked: search_id, rank, source."""
    rows = ranked.withColumn("source_key", F.coalesce("source", F.lit("__default__")))
    own = F.lit(limit)
    if limits is not None:
        rows = rows.join(limits.select(F.col("source").alias("source_key"), F.col("limit").alias("own_limit")), "source_key", "left")
        own = F.coalesce("own_limit", F.lit(limit))
    rows = rows.withColumn("in_source", F.row_number().over(Window.partitionBy("search_id", "source_key").orderBy("rank"))).filter(F.col("in_source") <= own)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("search_id").orderBy("rank"))).filter(F.col("place") <= limit).select("search_id", "rank", "source", "place")


def materialised_assets(assets: DataFrame, max_assets: int = 30, max_bytes: int = 10 << 20) -> DataFrame:
    """What is done with each asset of a candidate, in order: accepted, kind, duplicate, attempts, bytes.

    assets: candidate_id, seq, kind, url, timestamp_ms, bytes. Attempts stop at ``max_assets``; when the bytes of all attempts pass ``max_bytes``, that
    asset and all later ones are left.
    """
    usable = F.coalesce(F.col("kind").isin("thumbnail", "storyboard"), F.lit(False))
    copy = F.row_number().over(Window.partitionBy("candidate_id", "usable", "url", "timestamp_ms").orderBy("seq"))
    before = Window.partitionBy("candidate_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = assets.withColumn("usable", usable).withColumn("copy", copy).withColumn("tried", F.col("usable") & (F.col("copy") == 1))
    rows = rows.withColumn("attempt", F.sum(F.when(F.col("tried"), 1).otherwise(0)).over(before)).withColumn("total", F.sum(F.when(F.col("tried"), F.col("bytes")).otherwise(0)).over(before))
    stopped = F.max(F.when(F.col("tried") & (F.col("total") > max_bytes), 1).otherwise(0)).over(before) == 1
    fate = F.when(stopped, "bytes").when((F.col("attempt") > max_assets) | (~F.col("tried") & (F.col("attempt") >= max_assets)), "attempts").when(~F.col("usable"), "kind").when(F.col("copy") > 1, "duplicate").otherwise("accepted")
    return rows.select("candidate_id", "seq", fate.alias("fate"), F.col("total").alias("bytes_so_far"))


def refine(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """Best time of each candidate: candidate_id, timestamp_ms, similarity, status, evaluated, discarded.

    candidates: candidate_id, base_timestamp_ms, base_similarity, duration_ms; assets: candidate_id, seq, url, timestamp_ms, similarity. Assets without a
    time, outside the item, or repeated are discarded. A new time needs one asset alone at the top, better than before, at another time.
    """
    j = assets.join(candidates, "candidate_id")
    inside = F.coalesce((F.col("timestamp_ms") >= 0) & (F.col("duration_ms").isNull() | (F.col("timestamp_ms") < F.col("duration_ms"))), F.lit(False))
    copy = F.row_number().over(Window.partitionBy("candidate_id", "inside", "url", "timestamp_ms").orderBy("seq"))
    j = j.withColumn("inside", inside).withColumn("valid", F.col("inside") & (copy == 1))
    best = F.max(F.when(F.col("valid"), F.col("similarity"))).over(Window.partitionBy("candidate_id"))
    j = j.withColumn("best", best)
    found = j.groupBy("candidate_id").agg(
        F.count_if("valid").alias("evaluated"), F.count_if(~F.col("valid")).alias("discarded"), F.first("best").alias("best"),
        F.count_if(F.col("valid") & (F.abs(F.col("similarity") - F.col("best")) < 1e-9)).alias("at_top"),
        F.max_by("timestamp_ms", F.when(F.col("valid"), F.col("similarity"))).alias("best_ts"),
    )
    out = candidates.join(found, "candidate_id", "left")
    better = F.coalesce((F.col("at_top") == 1) & (F.col("best") > F.col("base_similarity")) & ~F.col("best_ts").eqNullSafe(F.col("base_timestamp_ms")), F.lit(False))
    return out.select(
        "candidate_id", F.when(better, F.col("best_ts")).otherwise(F.col("base_timestamp_ms")).alias("timestamp_ms"), F.when(better, F.col("best")).otherwise(F.col("base_similarity")).alias("similarity"),
        F.when(better, "improved").otherwise("unchanged").alias("status"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("discarded", F.lit(0)).alias("discarded"),
    )


def summary(outcomes: DataFrame) -> DataFrame:
    """Status of each search's second pass. outcomes: search_id, limited, failed, evaluable, improved (one row per processed candidate)."""
    g = outcomes.groupBy("search_id").agg(F.count("*").alias("processed"), F.bool_or("limited").alias("limited"), F.count_if("failed").alias("errors"), F.bool_or("evaluable").alias("evaluable"), F.count_if("improved").alias("improved"))
    status = F.when(F.col("limited"), "limited").when((F.col("errors") > 0) & ~F.col("evaluable"), "failed").when(F.col("evaluable"), "completed").otherwise("unavailable")
    return g.select("search_id", "processed", "errors", "improved", status.alias("status"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first of evidence rows with the same search, item, url and time; url_hash added."""
    h = F.concat(F.lit("sha256:"), F.sha2("url", 256))
    rank = F.row_number().over(Window.partitionBy("search_id", "video_id", "url_hash", F.coalesce("timestamp_ms", F.lit(-1))).orderBy("seq"))
    return evidence.withColumn("url_hash", h).withColumn("r", rank).filter("r = 1").drop("r")


def within_budget(steps: DataFrame, budget_ms: int = 10_000, step_ms: int = 3_000) -> DataFrame:
    """Marks steps that a search's time budget, or their own, cuts off. steps: search_id, seq, elapsed_ms."""
    spent = F.sum("elapsed_ms").over(Window.partitionBy("search_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("search_id", "seq", spent.alias("spent_ms"), ((spent > budget_ms) | (F.col("elapsed_ms") > step_ms)).alias("limited"))


def provenance(results: DataFrame) -> DataFrame:
    """Where each result's time is from, as a struct. results: search_id, video_id, status, source, kind, url, position."""
    seen = F.when(F.col("status") == "improved", F.struct(F.lit("asset").alias("origin"), "status", "source", "kind", "url", "position"))
    none = F.struct(F.lit("frame").alias("origin"), "status", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("position"))
    return results.select("search_id", "video_id", F.coalesce(seen, none).alias("provenance"))


def telemetry_faults(rows: DataFrame) -> DataFrame:
    """Counts of telemetry rows that break a rule: processed within requested, counters not negative, similarity within 0 and 1, a selected row has a time."""
    return rows.agg(
        F.count_if(F.col("processed") > F.col("requested")).alias("processed_over_requested"), F.count_if((F.col("processed") < 0) | (F.col("requested") < 0)).alias("negative"),
        F.count_if(~F.col("similarity").between(0, 1)).alias("similarity_outside"), F.count_if(F.col("selected") & F.col("timestamp_ms").isNull()).alias("selected_without_time"),
    )
