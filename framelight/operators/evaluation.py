"""Retrieval quality: accuracy, nearest-rank percentiles, paired policies, segments, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# fixed values: thresholds of the adoption gates
MIN_TOP5, MAX_TOP5_LOSS, MAX_NORMALISED_MEDIAN, MIN_REDUCTION, DENSE_FRAMES = 0.80, 0.05, 0.50, 0.70, 30


def nearest_rank(column: str, p: float) -> Column:
    """Nearest-rank percentile: the value at place ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(cases: DataFrame, results: DataFrame) -> DataFrame:
    """positives, top1, top5, top10, negatives, false_positive_rate. cases: case_id, expected; results: case_id, video_id, rank."""
    hit = results.alias("r").join(cases.select("case_id", "expected"), "case_id").groupBy("case_id").agg(F.min(F.when(F.col("video_id") == F.col("expected"), F.col("rank"))).alias("place"), F.lit(True).alias("any"))
    j = cases.join(hit, "case_id", "left")
    positive = F.col("expected").isNotNull()
    n, m = F.count_if(positive), F.count_if(~positive)
    tops = [F.round(ratio(F.count_if(positive & (F.col("place") <= k)), n), 4).alias(f"top{k}") for k in (1, 5, 10)]
    return j.agg(n.alias("positives"), *tops, m.alias("negatives"), F.round(ratio(F.count_if(~positive & F.coalesce("any", F.lit(False))), m), 4).alias("false_positive_rate"))


def case_identity() -> Column:
    """The case's own id, or its source, item, duration, time and path joined by bars (a zero prints as nothing)."""
    text = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("string")), F.lit(""))
    return F.coalesce(F.nullif("case_id", F.lit("")), F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("expected", F.lit("")), text("duration_ms"), text("timestamp_ms"), F.coalesce("path", F.lit(""))))


def last_observations(observations: DataFrame) -> DataFrame:
    """One observation of each policy and case, the last by position, and how many there were."""
    rest = [c for c in observations.columns if c not in ("policy", "case_id", "position")]
    return observations.groupBy("policy", "case_id").agg(F.max_by(F.struct(*rest), "position").alias("o"), F.count("*").alias("observed")).select("policy", "case_id", "o.*", "observed")


def integrity(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Per policy: missing, extra and duplicate observations."""
    o = observations.groupBy("policy", "case_id").agg(F.count("*").alias("n"))
    want = cases.select("case_id").distinct().join(F.broadcast(observations.select("policy").distinct())).withColumn("wanted", F.lit(True))  # policies are few
    j = want.join(o, ["policy", "case_id"], "full_outer")
    return j.groupBy("policy").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("duplicates"))


def _judged(cases: DataFrame, observations: DataFrame) -> DataFrame:
    j = last_observations(observations).join(cases, "case_id")
    right = (F.col("predicted") == F.col("expected")) & F.col("timestamp_ms").isNotNull() & F.col("predicted_timestamp_ms").isNotNull()
    error = F.when(right, F.abs(F.col("predicted_timestamp_ms") - F.col("timestamp_ms")))
    return j.select(
        "*", F.col("expected").isNotNull().alias("positive"), F.coalesce(F.try_element_at("ranked", F.lit(1)) == F.col("expected"), F.lit(False)).alias("hit1"),
        F.coalesce(F.array_contains(F.slice("ranked", 1, 5), F.col("expected")), F.lit(False)).alias("hit5"), error.alias("any_error"),
        F.when((F.col("frame_count") > 0) & F.col("duration_ms").isNotNull(), error).alias("error"),
    ).withColumn("normalised", F.col("error") / (F.col("duration_ms") / F.col("frame_count")))


def policy_metrics(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Per policy: cases, top1, top5, temporal errors absolute and per sampling interval, frames over distinct items."""
    judged = _judged(cases, observations)
    n = F.broadcast(cases.agg(F.count("expected").alias("positives")))
    frames = judged.filter("positive").groupBy("policy", "expected").agg(F.max_by("frame_count", "case_id").alias("f")).groupBy("policy").agg(F.sum("f").alias("frames"), F.count("*").alias("videos"))
    out = judged.groupBy("policy").agg(
        F.count("*").alias("cases"), F.count_if(F.col("positive") & F.col("hit1")).alias("h1"), F.count_if(F.col("positive") & F.col("hit5")).alias("h5"), F.count("error").alias("temporal_cases"),
        nearest_rank("error", 0.5).cast("long").alias("error_median"), nearest_rank("error", 0.95).cast("long").alias("error_p95"), F.round(nearest_rank("normalised", 0.5), 4).alias("normalised_median"),
        nearest_rank("case when error is not null then duration_ms / frame_count / 2 end", 0.5).alias("half_interval_median"),
    )
    out = out.join(n).join(frames, "policy", "left")
    gate = F.coalesce((F.col("normalised_median") <= MAX_NORMALISED_MEDIAN) & (F.col("error_median") <= F.col("half_interval_median")), F.lit(False))
    return out.select("policy", "cases", "positives", F.round(ratio(F.col("h1"), F.col("positives")), 4).alias("top1"), F.round(ratio(F.col("h5"), F.col("positives")), 4).alias("top5"), "temporal_cases", "error_median", "error_p95", "normalised_median", "frames", "videos", gate.alias("temporal_gate"))


def segment_metrics(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Per policy and segment (source/bucket): cases, top1, top5, error median; errors count whatever the frame count."""
    judged = _judged(cases, observations).withColumn("bucket", C.duration_bucket("duration_ms")).filter("positive and bucket is not null")
    return judged.groupBy("policy", F.concat_ws("/", "source", "bucket").alias("segment")).agg(
        F.count("*").alias("cases"), F.round(ratio(F.count_if("hit1"), F.count("*")), 4).alias("top1"), F.round(ratio(F.count_if("hit5"), F.count("*")), 4).alias("top5"), nearest_rank("any_error", 0.5).cast("long").alias("error_median")
    )


def compare_segments(metrics: DataFrame, one: str, other: str) -> DataFrame:
    a = metrics.filter(F.col("policy") == one).select("segment", F.col("top5").alias("one_top5"))
    return a.join(metrics.filter(F.col("policy") == other).select("segment", F.col("top5").alias("other_top5")), "segment", "full_outer")


def frame_reduction(cases: DataFrame, observations: DataFrame, dense: str, sparse: str, least: int = DENSE_FRAMES) -> DataFrame:
    """1 - frames of the sparse policy / frames of the dense one, over items that the dense one has at least ``least`` frames of."""
    f = last_observations(observations).join(cases.filter("expected is not null").select("case_id", "expected"), "case_id").groupBy("policy", "expected").agg(F.max_by("frame_count", "case_id").alias("f"))
    a = f.filter((F.col("policy") == dense) & (F.col("f") >= least)).select("expected", F.col("f").alias("d"))
    return a.join(f.filter(F.col("policy") == sparse).select("expected", F.col("f").alias("s")), "expected").agg(F.count("*").alias("videos"), F.round(1 - F.try_divide(F.sum("s").cast("double"), F.sum("d").cast("double")), 4).alias("reduction"))


def adoption(metrics: DataFrame, reduction: DataFrame, dense: str, sparse: str) -> DataFrame:
    """The gates and whether all hold."""
    a, b = metrics.filter(F.col("policy") == dense).select(F.col("top5").alias("a5")), metrics.filter(F.col("policy") == sparse).select(F.col("top5").alias("b5"), "temporal_gate")
    g = a.join(b).join(reduction)  # one row each
    gates = g.select((F.col("b5") >= MIN_TOP5).alias("top5_ok"), (F.col("a5") - F.col("b5") <= MAX_TOP5_LOSS).alias("loss_ok"), F.col("temporal_gate").alias("temporal_ok"), F.coalesce(F.col("reduction") >= MIN_REDUCTION, F.lit(False)).alias("reduction_ok"))
    return gates.withColumn("accepted", F.col("top5_ok") & F.col("loss_ok") & F.col("temporal_ok") & F.col("reduction_ok"))


def improved_or_equal(cases: DataFrame, observations: DataFrame, base: str, refined: str) -> DataFrame:
    """Share of comparable cases whose error did not grow, in percent."""
    j = _judged(cases, observations).select("policy", "case_id", "any_error").filter("any_error is not null")
    a, b = j.filter(F.col("policy") == base).select("case_id", F.col("any_error").alias("x")), j.filter(F.col("policy") == refined).select("case_id", F.col("any_error").alias("y"))
    return a.join(b, "case_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("y") <= F.col("x"), 100.0).otherwise(0.0)), 4).alias("improved_or_equal"))


# fixed values: what a set of cases must cover
REQUIRED_SOURCES, REQUIRED_BUCKETS = ("local", "web"), ("<5m", "5-15m", ">15m")


def coverage_errors(cases: DataFrame, min_cases: int, min_per_segment: int) -> DataFrame:
    """(error), each once: what a set of cases lacks. cases: case_id, expected, source, duration_ms, timestamp_ms. Only positives are held to it."""
    c = cases.withColumn("bucket", C.duration_bucket("duration_ms"))
    positive = c.filter("expected is not null")
    t, d = F.col("timestamp_ms"), F.col("duration_ms")
    yes = lambda x: F.coalesce(x, F.lit(False))
    per_case = F.array(
        F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "invalid_source"), F.when(yes(t < 0) | (F.col("bucket").isNotNull() & yes(t >= d)), "invalid_timestamp"),
        F.when(~yes((d > 0) & (t >= 0) & (t < d)), "invalid_truth"), F.when(F.col("bucket").isNull(), "invalid_duration"),
    )
    rows = positive.select("case_id", F.explode(F.filter(per_case, lambda x: x.isNotNull())).alias("code")).select(F.concat_ws(":", "code", "case_id").alias("error"))
    twice = c.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("duplicate_case_ids:"), "case_id").alias("error"))
    thin = positive.filter("bucket is not null").groupBy("source", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") < min_per_segment)
    thin = thin.select(F.format_string(f"segment_too_small:%s/%s:%d<{min_per_segment}", "source", "bucket", "n").alias("error"))
    whole = positive.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("source").isin(*REQUIRED_SOURCES), F.col("source"))).alias("s"), F.collect_set("bucket").alias("b"))
    lacks = lambda name, need, have: F.when(F.size(F.array_except(F.array(*map(F.lit, need)), F.col(have))) > 0, F.concat(F.lit(name), F.array_join(F.array_except(F.array(*map(F.lit, need)), F.col(have)), ",")))
    of_all = F.array(
        F.when(F.col("n") < min_cases, F.format_string(f"minimum_positive_cases:%d<{min_cases}", "n")),
        lacks("missing_sources:", REQUIRED_SOURCES, "s"), lacks("missing_duration_buckets:", REQUIRED_BUCKETS, "b"),
    )
    return rows.unionByName(twice).unionByName(thin).unionByName(whole.select(F.explode(F.filter(of_all, lambda x: x.isNotNull())).alias("error"))).distinct()


def coverage(cases: DataFrame, min_cases: int, min_per_segment: int) -> DataFrame:
    """Counts of a set of cases, the number of its errors, and whether it may be used."""
    positive = F.col("expected").isNotNull()
    counts = cases.agg(
        F.count("*").alias("cases"), F.count_distinct("case_id").alias("distinct_cases"), F.count_if(positive).alias("positives"),
        F.count_distinct(F.when(positive, F.col("case_id"))).alias("distinct_positives"), F.count_distinct(F.when(positive, F.col("source"))).alias("sources"),
        F.count_distinct(F.when(positive, C.duration_bucket("duration_ms"))).alias("buckets"),
    )
    errors = coverage_errors(cases, min_cases, min_per_segment).agg(F.count("*").alias("errors"))
    return counts.join(errors).withColumn("valid", (F.col("errors") == 0) & (F.col("distinct_positives") >= min_cases))  # one row each


def costs(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Per policy over observed cases: sums of assets, bytes and embeddings, and nearest-rank latencies."""
    o = observations.join(cases.select("case_id"), "case_id", "left_semi")
    return o.groupBy("policy").agg(*[F.sum(c).alias(c) for c in ("assets", "bytes", "embeddings")], nearest_rank("elapsed_ms", 0.5).alias("p50"), nearest_rank("elapsed_ms", 0.95).alias("p95"))


def sample_per_variant(frames: DataFrame, variants: DataFrame, k: int, seed: int) -> DataFrame:
    """k frames of each variant, by the rank of a hash of frame, variant and seed. Each task keeps k of a variant before the shuffle."""
    grid = frames.select("frame_id").join(F.broadcast(variants.select("variant")))  # variants are a handful by contract
    order = F.struct(F.crc32(F.concat_ws(":", "frame_id", "variant", F.lit(seed))).alias("h"), "frame_id")
    rank = F.row_number().over(Window.partitionBy("variant").orderBy(order))
    return grid.withColumn("place", rank).filter(F.col("place") <= k)


def throughput(runs: DataFrame) -> DataFrame:
    return runs.agg(ratio(F.sum("images"), F.sum("seconds")).alias("images_per_second"))
