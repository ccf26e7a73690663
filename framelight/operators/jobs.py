"""Work queue as data: dispatch, leases, retries, deduplication, reindex reports, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

TERMINAL = ("done", "failed", "unavailable")


def dispatchable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter((F.col("status") == "pending") & (F.col("not_before") <= now))


def claim(jobs: DataFrame, now: Column, workers: int) -> DataFrame:
    """Deals dispatchable jobs out in order of age: job_id, place, worker. Ids break ties."""
    order = F.row_number().over(Window.orderBy("created_at", "job_id"))
    return dispatchable(jobs, now).select("job_id", order.alias("place")).withColumn("worker", (F.col("place") - 1) % workers)


def stale(jobs: DataFrame, now: Column, lease_seconds: int = 300) -> DataFrame:
    return jobs.filter((F.col("status") == "running") & (F.col("locked_at") <= now - F.make_dt_interval(secs=F.lit(lease_seconds))))


def reset_stale(jobs: DataFrame, now: Column, lease_seconds: int = 300) -> DataFrame:
    """All jobs after leases that ran out were taken back: those wait again, without lock. jobs: status, locked_at and others."""
    gone = F.coalesce((F.col("status") == "running") & (F.col("locked_at") <= now - F.make_dt_interval(secs=F.lit(lease_seconds))), F.lit(False))
    return jobs.withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "locked_at": F.when(~gone, F.col("locked_at"))})


def settle(claimed: DataFrame, handled: tuple[str, ...], now: Column, max_attempts: int = 3) -> DataFrame:
    """State of claimed jobs after their handlers ran: job_id, status, error, delay_ms.

    claimed: job_id, job_type, attempts, http_status, error_class and error (both null where the handler succeeded). A job type without a
    handler fails for good; another job's error concerns that job only. The delay is never negative.
    """
    missing, failed = ~F.col("job_type").isin(*handled), F.col("error_class").isNotNull()
    text = F.concat_ws(": ", "error_class", F.nullif(F.trim("error"), F.lit("")))
    after = after_failure(claimed.withColumn("error", text), now, max_attempts).select("job_id", F.col("status").alias("next"), F.greatest(F.lit(0.0), F.col("delay_s") * 1000).alias("delay"))
    rows = claimed.withColumn("text", text).join(after, "job_id")
    retried = ~missing & failed
    return rows.select(
        "job_id", F.when(missing, "failed").when(failed, F.col("next")).otherwise("done").alias("status"),
        F.when(missing, F.concat(F.lit("no handler: "), "job_type")).when(failed, F.col("text")).alias("error"), F.when(retried & (F.col("next") == "pending"), F.col("delay")).alias("delay_ms"),
    )


def sweep(videos: DataFrame, frames: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos and frames after availability checks: what is gone gets that status, is excluded and loses its frames. checks: video_id, http_status, readable."""
    from ..functions.rules import availability

    found = checks.select("video_id", availability("http_status", "readable").alias("found")).filter("found <> 'available'")
    after = videos.join(found, "video_id", "left")
    kept = after.withColumns({"status": F.coalesce("found", "status"), "excluded": F.col("excluded") | F.col("found").isNotNull()}).drop("found")
    return kept, frames.join(found, "video_id", "left_anti")


def enqueue(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """Per request: the active job it reuses, or itself if it is the first of its (job_type, dedupe_key). batch: request_id, job_type, dedupe_key."""
    active = jobs.filter(~F.col("status").isin(*TERMINAL)).groupBy("job_type", "dedupe_key").agg(F.min("job_id").alias("active_id"))
    first = F.min("request_id").over(Window.partitionBy("job_type", "dedupe_key"))
    joined = batch.join(active, ["job_type", "dedupe_key"], "left").withColumn("first", first)
    reused = F.col("active_id").isNotNull() | (F.col("first") != F.col("request_id"))
    return joined.select("request_id", "job_type", "dedupe_key", reused.alias("reused"), F.coalesce("active_id", "first").alias("target_id"))


def after_failure(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """State of failed jobs: terminal errors and spent attempts fail, others wait. jobs: job_id, attempts, http_status, error."""
    attempts = F.col("attempts") + 1
    dead = (C.error_class("http_status", "error") == "terminal") | (attempts >= max_attempts)
    delay = C.backoff_seconds(attempts)
    return jobs.select("job_id", attempts.alias("attempts"), F.when(dead, "failed").otherwise("pending").alias("status"), F.when(~dead, delay).alias("delay_s"), F.when(~dead, now + F.make_dt_interval(secs=delay)).alias("not_before"))


def replay(log: DataFrame) -> DataFrame:
    """Final status of each job from its events (job_id, seq, status): terminal states are left by nothing."""
    events = F.sort_array(F.collect_list(F.struct("seq", "status")))
    step = lambda s, e: F.when(F.coalesce(s.isin(*TERMINAL), F.lit(False)), s).otherwise(e["status"])
    return log.groupBy("job_id").agg(events.alias("e")).select("job_id", F.aggregate("e", F.lit(None).cast("string"), step).alias("status"))


def reindex_outcomes(jobs: DataFrame) -> DataFrame:
    """Outcome per reindex job: job_id, result_status, result_frames, reason. jobs: job_id, status, payload (JSON with result_*)."""
    get = lambda k: F.get_json_object("payload", f"$.result_{k}")
    frames = get("frames").try_cast("bigint")
    done = F.col("status") == "done"
    status = (
        F.when(F.col("status").isin("pending", "running"), "pending")
        .when(done & (get("outcome") == "completed") & (frames > 0) & get("reason").isNull(), "completed")
        .when(done & (get("outcome") == "skipped") & (frames == 0) & (F.length(get("reason")) > 0), "skipped")
        .otherwise("failed")
    )
    return jobs.select("job_id", status.alias("result_status"), F.when(status == "completed", frames).otherwise(0).cast("long").alias("result_frames"), get("reason").alias("reason"))


def reindex_report(jobs: DataFrame) -> DataFrame:
    out = reindex_outcomes(jobs)
    counts = [F.count_if(F.col("result_status") == s).alias(s) for s in ("pending", "completed", "skipped", "failed")]
    return out.agg(*counts, F.coalesce(F.sum("result_frames"), F.lit(0)).alias("frames"))


def eligibility(requests: DataFrame, videos: DataFrame, sources: DataFrame) -> DataFrame:
    """First reason against reindexing: request_id, reason (null if eligible). requests: request_id, source, external_id."""
    s, v = sources.select("source", "enabled", F.lit(True).alias("__s")), videos.select("source", "external_id", "excluded", "status", F.lit(True).alias("__v"))
    reason = (
        F.when(F.col("__s").isNull(), "source_missing").when(~F.col("enabled"), "source_disabled").when(F.col("__v").isNull(), "video_missing")
        .when(F.col("excluded"), "video_excluded").when(~F.col("status").isin("indexed", "failed"), "video_ineligible")
    )
    return requests.join(s, "source", "left").join(v, ["source", "external_id"], "left").select("request_id", reason.alias("reason"))


def rate_limit(requests: DataFrame, max_rps: float, min_interval_ms: float) -> DataFrame:
    """Replay of a token bucket without jitter: source, i, arrival_ms, start_ms, wait_ms. requests: source, arrival_ms.

    The bucket holds ``max_rps`` tokens and starts full; a request waits until it holds one token and the least interval has passed, then takes
    one, which may leave less than none where ``max_rps`` is below one. Requests of a source follow each other, so its order is sequential by
    nature; sources are dealt to tasks, sorted and streamed, and only the state of the current one is held.
    """
    sent = requests.select(F.col("source").cast("string"), F.col("arrival_ms").cast("double")).repartition("source").sortWithinPartitions("source", "arrival_ms")

    def replay_sources(batches):
        import pandas as pd

        source, tokens, last, place = None, 0.0, None, 0
        for batch in batches:
            places, starts = [], []
            for name, arrival in zip(batch["source"], batch["arrival_ms"], strict=True):
                if name != source:
                    source, tokens, last, place = name, float(max_rps), None, 0
                now = arrival if last is None else max(arrival, last)
                if last is not None:
                    tokens = min(max_rps, tokens + (now - last) / 1000 * max_rps)
                wait = max(0.0, (1 - tokens) / max_rps * 1000, 0.0 if last is None else min_interval_ms - (now - last))
                last, tokens = now + wait, min(max_rps, tokens + wait / 1000 * max_rps) - 1
                places.append(place)
                starts.append(last)
                place += 1
            yield pd.DataFrame({"source": batch["source"], "i": places, "arrival_ms": batch["arrival_ms"], "start_ms": starts, "wait_ms": [s - a for s, a in zip(starts, batch["arrival_ms"], strict=True)]})

    return sent.mapInPandas(replay_sources, "source string, i int, arrival_ms double, start_ms double, wait_ms double")


def rate_accounting(replayed: DataFrame) -> DataFrame:
    """Per source of a replay: requests, those that waited, and the total wait in whole milliseconds."""
    return replayed.groupBy("source").agg(F.count("*").alias("requests"), F.count_if(F.col("wait_ms") > 0).alias("rate_limit_waits"), F.rint(F.sum("wait_ms")).cast("long").alias("total_wait_ms"))


def rate_specs(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rate of each source, every field overridden on its own: source, min_interval_ms, max_rps."""
    o = overrides.select("source", F.col("min_interval_ms").alias("__i"), F.col("max_rps").alias("__r"))
    return defaults.join(o, "source", "left").select("source", F.coalesce("__i", "min_interval_ms").alias("min_interval_ms"), F.coalesce("__r", "max_rps").alias("max_rps"))


def compliance_faults(sources: DataFrame) -> DataFrame:
    """Reasons, in fixed order, why a source may not be used. sources: source, robots_reviewed, terms_reviewed, review_date, enabled."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    checks = F.array(
        F.when(no("robots_reviewed"), "robots_reviewed"), F.when(no("terms_reviewed"), "terms_reviewed"),
        F.when(F.col("review_date").isNull(), "review_date"), F.when(no("enabled"), "enabled"),
    )
    return sources.select("source", F.filter(checks, lambda x: x.isNotNull()).alias("faults"))
