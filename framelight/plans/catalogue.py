"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation as E
from ..operators import folds, jobs, refine, search, store
from ..sources import pages
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_NOW = "timestamp '2024-01-20 00:00:00'"


def now():
    """The fixed present of the queue queries."""
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- search -------------------------------------------------------------------------------------------------------------------------------
_HITS = "select query_id, frame_id, video_id, timestamp_ms, phash, query_phash, round(list_cosine_distance(v, qv), 9) as d, row_number() over (partition by query_id order by round(list_cosine_distance(v, qv), 9), frame_id) as rank from fr, qu {where} qualify rank <= {k}"
_GROUPS = "select query_id, video_id, count(*) as n, min(d) as bd, arg_min({{'f': frame_id, 't': timestamp_ms, 'p': bit_count(xor(phash, query_phash))}}, rank) as b from ({hits}) group by all"
_SCORED = "select query_id, video_id, n as matching_frames, bd as best_distance, b.f as best_frame_id, greatest(0, least(1, 1 - bd)) as visual, n / max(n) over (partition by query_id) as frames, 1 - b.p / 64.0::double as phash from ({groups}) {where}"


def _scored(k: int, where: str = "", drop: str = "") -> str:
    return _SCORED.format(groups=_GROUPS.format(hits=_HITS.format(k=k, where=where)), where=drop)


def _ranked_sql(k: int, w: tuple[float, float, float], least: float, drop: str = "", where: str = "") -> str:
    s = f"select *, round(({w[0]} * visual + {w[1]} * frames + {w[2]} * phash) / {sum(w)}, 6) as match_score from ({_scored(k, where, drop)})"
    return T.sql(f"select query_id, (row_number() over (partition by query_id order by match_score desc, best_distance, video_id))::int as rank, video_id, match_score, matching_frames, best_frame_id from ({s}) where match_score >= {least}", "fr", "qu")


def _ranked(df: DataFrame) -> DataFrame:
    df = df.withColumn("match_score", F.round("match_score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("match_score"), "best_distance", "video_id"))
    return df.select("query_id", rank.alias("rank"), "video_id", "match_score", "matching_frames", "best_frame_id")


def _knn(spark: SparkSession, sf: str, k: int, frames: DataFrame | None = None) -> DataFrame:
    frames = T.frames(spark, sf) if frames is None else frames
    hits = search.knn(frames, T.queries(spark, sf), k)
    # distances at nine digits decide, as in the SQL
    return hits.withColumn("distance", F.round("distance", 9))


@query(T.sql(f"select query_id, frame_id, round(d, 6) as distance, rank::int as rank from ({_HITS.format(k=10, where='')})", "fr", "qu"))
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10).withColumn("distance", F.round("distance", 6))


@query(T.sql(f"select query_id, frame_id, rank::int as rank from ({_HITS.format(k=10, where='where video_id % 3 <> 0')})", "fr", "qu"))
def knn_excluding(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, T.frames(spark, sf).filter("video_id % 3 <> 0")).select("query_id", "frame_id", "rank")


@query(T.sql("select 0::bigint as query_id, 0::bigint as frame_id where false", "fr"))
def knn_k_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 0).select("query_id", "frame_id")


def _grouped(spark: SparkSession, sf: str, k: int) -> DataFrame:
    f = T.frames(spark, sf)
    return search.group_hits(_knn(spark, sf, k).join(f.select("frame_id", "video_id", "timestamp_ms"), "frame_id"))


@query(T.sql(f"select query_id, video_id, n as matching_frames, round(bd, 6) as best_distance, b.f as best_frame_id, b.t as best_timestamp_ms from ({_GROUPS.format(hits=_HITS.format(k=20, where=''))})", "fr", "qu"))
def group_hits_by_video(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(spark, sf, 20).withColumn("best_distance", F.round("best_distance", 6))


@query(_ranked_sql(40, (0.5, 0.3, 0.2), 0))
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.rank_candidates(_grouped(spark, sf, 40), T.frames(spark, sf), T.queries(spark, sf)))


@query(_ranked_sql(40, (0.5, 0.3, 0.2), 0.5))
def rank_min_score(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.rank_candidates(_grouped(spark, sf, 40), T.frames(spark, sf), T.queries(spark, sf), min_score=0.5))


@query(_ranked_sql(40, (1.0, 0.0, 3.0), 0))
def rank_custom_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.rank_candidates(_grouped(spark, sf, 40), T.frames(spark, sf), T.queries(spark, sf), search.RankingWeights(1.0, 0.0, 3.0)))


@query(_ranked_sql(40, (0.5, 0.3, 0.2), 0, "where video_id % 5 <> 1"))
def rank_caller_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    gone = T.frames(spark, sf).select("video_id").distinct().filter("video_id % 5 = 1")
    return _ranked(search.rank_candidates(_grouped(spark, sf, 40), T.frames(spark, sf), T.queries(spark, sf), exclude=gone))


@query(T.sql("select count(distinct video_id) as videos, count(*) as frames, count(v) as vectors from fr", "fr"))
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return search.index_stats(T.frames(spark, sf))


@query(T.sql("select frame_id, phash, phash::hugeint + case when phash < 0 then 18446744073709551616 else 0 end as u from fr", "fr").replace("phash::hugeint + case when phash < 0 then 18446744073709551616 else 0 end as u", "(phash::hugeint + case when phash < 0 then 18446744073709551616::hugeint else 0 end)::varchar as unsigned"))
def phash_codec(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).withColumn("u", C.to_unsigned("phash"))
    return f.select("frame_id", C.to_signed("u").alias("phash"), F.col("u").cast("string").alias("unsigned"))


@query(T.sql("select a.frame_id as frame_id, b.frame_id as other_id, bit_count(xor(a.phash, b.phash))::int as bits from fr a join fr b on a.video_id = b.video_id and a.frame_id < b.frame_id", "fr"))
def hamming_within_video(spark: SparkSession, sf: str) -> DataFrame:
    a = T.frames(spark, sf).select("video_id", "frame_id", "phash")
    b = a.select("video_id", F.col("frame_id").alias("other_id"), F.col("phash").alias("other"))
    return a.join(b, "video_id").filter("frame_id < other_id").select("frame_id", "other_id", C.hamming("phash", "other").alias("bits"))


# ---- folds --------------------------------------------------------------------------------------------------------------------------------
@query()
def greedy_phash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return folds.greedy_phash_dedupe(T.frames(spark, sf).select("video_id", F.col("frame_id").alias("position"), "phash"), 28)


@query()
def exact_multi_key_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select("video_id", F.col("frame_id").alias("seq"), (F.col("frame_id") % 7).alias("position"), "timestamp_ms", F.expr("phash & 7").alias("phash"))
    return folds.multi_key_dedupe(f)


@query(T.sql("select video_id, (case when duration_ms is null or duration_ms <= 0 then 8 else least(8, greatest(1, ceil(duration_ms / 120000.0))) end)::bigint as target from vi", "vi"))
def adaptive_target_count(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", folds.target_count("duration_ms").alias("target"))


@query(T.sql("select distinct video_id, greatest(0, least(round_even((i + 0.5::double) * duration_ms / 8, 0)::bigint, duration_ms - 1)) as at from vi, range(8) r(i) where duration_ms > 0", "vi"))
def ideal_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", F.explode(folds.ideal_timestamps("duration_ms", F.lit(8))).alias("at"))


@query()
def select_representative(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select("video_id", F.when(F.col("video_id") % 6 != 0, F.col("video_id") * 20_000).alias("duration_ms"), F.col("frame_id").alias("seq"), "timestamp_ms")
    return folds.select_representative(f, 4, 30_000)


@query()
def gallery_positions(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf).select("video_id", F.expr("transform(sequence(0, cast(video_id % 9 as int)), i -> cast(1 + (i * 5 + video_id) % 30 as int))").alias("positions"), F.lit(30).alias("gallery_max"), F.when(F.col("video_id") % 4 != 0, F.col("duration_ms")).alias("duration_ms"))
    return folds.gallery_positions(v)


@query(T.sql("select video_id, greatest(0, least(round_even((video_id % 31)::double / 30 * duration_ms, 0)::bigint, duration_ms - 1)) as at from vi where duration_ms > 0", "vi"))
def gallery_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).filter("duration_ms > 0").select("video_id", folds.gallery_timestamp(F.col("video_id") % 31, F.lit(30), "duration_ms").alias("at"))


@query(T.sql("select video_id, i::int as position, (i // 3)::int as tile_row, (i % 3)::int as tile_column, case when duration_ms > 0 then round_even(i::double / 6 * duration_ms, 0)::bigint end as timestamp_ms from vi, range(6) r(i)", "vi"))
def storyboard_tiles(spark: SparkSession, sf: str) -> DataFrame:
    out = folds.storyboard_tiles(T.videos(spark, sf).select("video_id", F.lit(3).alias("columns"), F.lit(2).alias("rows"), "duration_ms"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("position", "tile_row", "tile_column")})


@query(T.sql("select frame_id, coalesce(timestamp_ms, 1000000000 + row_number() over (partition by video_id, timestamp_ms is null order by frame_id) - 1)::bigint as frame_seq from fr", "fr"))
def frame_sequence_keys(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("video_id", F.col("timestamp_ms").isNull()).orderBy("frame_id")
    return T.frames(spark, sf).withColumn("n", F.row_number().over(w) - 1).select("frame_id", C.frame_seq("timestamp_ms", "n").alias("frame_seq"))


# ---- store --------------------------------------------------------------------------------------------------------------------------------
@query(T.sql("select video_id, frame_id, case when frame_id % 4 = 0 then -1 else phash end as phash from fr union all select video_id, frame_id + 1000000, 7 from fr where frame_id % 10 = 0", "fr"))
def upsert_frames(spark: SparkSession, sf: str) -> DataFrame:
    old = T.frames(spark, sf).select("video_id", "frame_id", "phash")
    batch = old.filter("frame_id % 4 = 0").select("video_id", "frame_id", F.lit(-1).cast("long").alias("phash"), F.lit(1).alias("seq"))
    batch = batch.unionByName(batch.withColumn("phash", F.lit(0).cast("long")).withColumn("seq", F.lit(0)))
    new = old.filter("frame_id % 10 = 0").select("video_id", (F.col("frame_id") + 1_000_000).alias("frame_id"), F.lit(7).cast("long").alias("phash"), F.lit(0).alias("seq"))
    return store.upsert(old, batch.unionByName(new), ["video_id", "frame_id"], "seq")


@query(T.sql("select video_id, frame_id, phash from fr where video_id % 5 <> 0 union all select video_id, frame_id + 1, 0 from fr where video_id % 5 = 0 and frame_id % 2 = 0", "fr"))
def replace_video_index(spark: SparkSession, sf: str) -> DataFrame:
    old = T.frames(spark, sf).select("video_id", "frame_id", "phash")
    return store.replace_frames(old, old.filter("video_id % 5 = 0 and frame_id % 2 = 0").select("video_id", (F.col("frame_id") + 1).alias("frame_id"), F.lit(0).cast("long").alias("phash")))


@query(T.sql("select count(*) as frames, count(distinct video_id) as videos from fr where video_id % 4 <> 1", "fr"))
def soft_delete_video(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    return store.soft_delete(v, T.frames(spark, sf), v.filter("video_id % 4 = 1"))[1].agg(F.count("*").alias("frames"), F.count_distinct("video_id").alias("videos"))


@query(T.sql("select count(*) filter (where not excluded and video_id % 2 = 0) as changed from vi", "vi"))
def exclude_toggle(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    return store.changed_rows(v, store.set_flag(v, v.filter("video_id % 2 = 0"), "excluded", True), "video_id", "excluded")


@query(T.sql("""select source, external_id, case when video_id % 3 = 0 then null when video_id % 2 = 0 then 'new' else title end as title, status, excluded from vi where video_id % 3 <> 0 or true
    """.replace("case when video_id % 3 = 0 then null when video_id % 2 = 0 then 'new' else title end", "case when video_id % 6 = 0 then null when video_id % 2 = 0 then 'new' else title end").replace("where video_id % 3 <> 0 or true", "union all select source, external_id || 'n', 'fresh', 'discovered', false from vi where video_id % 50 = 0"), "vi"))
def upsert_web_videos(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    old = v.select("source", "external_id", "title", "status", "excluded")
    batch = v.filter("video_id % 2 = 0").select("source", "external_id", F.when(F.col("video_id") % 6 != 0, "new").alias("title"), F.lit("discovered").alias("status"), F.lit(False).alias("excluded"))
    fresh = v.filter("video_id % 50 = 0").select("source", F.concat("external_id", F.lit("n")).alias("external_id"), F.lit("fresh").alias("title"), F.lit("discovered").alias("status"), F.lit(False).alias("excluded"))
    return store.upsert_items(old, batch.unionByName(fresh), ["title"])


@query(f"select event_id, value from events where ts >= {_NOW} - interval 10 day")
def searches_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge_older(T.read(spark, sf, "events"), "ts", now(), 10).select("event_id", "value")


# ---- catalogue and jobs -------------------------------------------------------------------------------------------------------------------
@query(T.sql("select video_id, source, title, coalesce(enabled, false) as enabled, coalesce(duration_ms, 0) as duration_ms from vi left join so using (source)", "vi", "so"))
def video_card(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).join(T.sources(spark, sf), "source", "left").select("video_id", "source", "title", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


@query(T.sql("select source, enabled, (row_number() over (order by source))::int as place from so", "so"))
def sources_listing(spark: SparkSession, sf: str) -> DataFrame:
    return T.sources(spark, sf).withColumn("place", F.row_number().over(Window.orderBy("source")))  # sources are few by contract


@query(T.sql("select source, status, count(*) as n from jo group by all", "jo"))
def jobs_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return T.jobs(spark, sf).groupBy("source", "status").agg(F.count("*").alias("n"))


@query(T.sql("select status, count(*) as n from jo group by all", "jo"))
def jobs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return T.jobs(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(T.sql("select status, count(*) as n from vi group by all", "vi"))
def videos_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(T.sql("select job_id, status, error from jo where status in ('failed', 'unavailable') and error is not null order by created_at desc, job_id limit 20", "jo"))
def recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    j = T.jobs(spark, sf).filter("status in ('failed', 'unavailable') and error is not null")
    return j.orderBy(F.desc("created_at"), "job_id").limit(20).select("job_id", "status", "error")


@query(T.sql("select video_id from vi join so using (source) where enabled and not excluded and status in ('indexed', 'failed') order by external_id, video_id limit 200", "vi", "so"))
def reindex_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf).join(T.sources(spark, sf).filter("enabled"), "source").filter("not excluded and status in ('indexed', 'failed') and external_id is not null")
    return v.orderBy("external_id", "video_id").limit(200).select("video_id")


@query(T.sql("""select r.video_id as request_id, case when s.source is null then 'source_missing' when not enabled then 'source_disabled' when v.video_id is null then 'video_missing' when excluded then 'video_excluded' when status not in ('indexed', 'failed') then 'video_ineligible' end as reason
    from (select video_id, case when video_id % 13 = 0 then 'none' else source end as source, case when video_id % 17 = 0 then 'none' else external_id end as external_id from vi) r left join so s on s.source = r.source left join vi v on v.source = r.source and v.external_id = r.external_id""", "vi", "so"))
def reindex_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    r = v.select(F.col("video_id").alias("request_id"), F.when(F.col("video_id") % 13 == 0, "none").otherwise(F.col("source")).alias("source"), F.when(F.col("video_id") % 17 == 0, "none").otherwise(F.col("external_id")).alias("external_id"))
    return jobs.eligibility(r, v, T.sources(spark, sf))


@query("""select count(*) filter (where s in ('view', 'click')) as pending, count(*) filter (where s = 'purchase' and k > 50) as completed, count(*) filter (where s = 'purchase' and k = 0) as skipped,
    count(*) filter (where s not in ('view', 'click') and not (s = 'purchase' and (k > 50 or k = 0))) as failed, coalesce(sum(k) filter (where s = 'purchase' and k > 50), 0)::bigint as frames
    from (select event_type as s, json_extract_string(props, '$.k')::bigint as k from events)""")
def reindex_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.when(k > 50, F.to_json(F.struct(F.lit("completed").alias("result_outcome"), k.cast("string").alias("result_frames")))).when(k == 0, '{"result_outcome":"skipped","result_frames":"0","result_reason":"none"}').otherwise('{"result_outcome":"skipped","result_frames":"0"}')
    e = T.read(spark, sf, "events").select(F.col("event_id"), payload.alias("payload"))
    return jobs.reindex_report(T.jobs(spark, sf).join(e, F.col("job_id") == e.event_id).select("job_id", "status", "payload"))


@query(T.sql(f"select job_id, (row_number() over (order by created_at, job_id))::int as place, ((row_number() over (order by created_at, job_id) - 1) % 4)::int as worker from jo where status = 'pending' and not_before <= {_NOW}", "jo"))
def claim_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.claim(T.jobs(spark, sf), now(), 4)


@query(T.sql(f"select job_id from jo where status = 'running' and locked_at <= {_NOW} - interval 300 second", "jo"))
def stale_leases(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.stale(T.jobs(spark, sf), now()).select("job_id")


@query(T.sql("""select r.job_id as request_id, a.id is not null or r.first <> r.job_id as reused, coalesce(a.id, r.first) as target_id from (select *, min(job_id) over (partition by job_type, dedupe_key) as first from jo where job_id % 2 = 1) r
    left join (select job_type, dedupe_key, min(job_id) as id from jo where job_id % 2 = 0 and status in ('pending', 'running') and job_id % 10 = 0 group by all) a using (job_type, dedupe_key)""", "jo"))
def enqueue_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    j = T.jobs(spark, sf)
    return jobs.enqueue(j.filter("job_id % 10 = 0"), j.filter("job_id % 2 = 1").select(F.col("job_id").alias("request_id"), "job_type", "dedupe_key")).select("request_id", "reused", "target_id")


@query()
def rate_limit_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("arrival_ms"))
    return jobs.rate_limit(e, 0.5, 2000)


@query("select user_id as job_id, case when s is null then l else s end as status from (select user_id, arg_min(event_type, event_id) filter (where event_type = 'purchase') as s0, arg_min(case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'unavailable' end, event_id) filter (where event_type in ('purchase', 'error', 'signup')) as s, arg_max(case event_type when 'view' then 'pending' else 'running' end, event_id) as l from events group by user_id)")
def job_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = T.jobs(spark, sf).join(T.read(spark, sf, "events").select(F.col("event_id").alias("job_id"), "user_id"), "job_id")
    return jobs.replay(e.select(F.col("user_id").alias("job_id"), F.col("job_id").alias("seq"), "status"))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def search_latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "events").groupBy("event_type").agg(E.nearest_rank("value", 0.5).alias("p50"), E.nearest_rank("value", 0.95).alias("p95"))


# ---- evaluation ---------------------------------------------------------------------------------------------------------------------------
@query(T.sql(f"""select count(*) as positives, round(avg((place <= 1)::int), 4) as top1, round(avg((place <= 5)::int), 4) as top5, round(avg((place <= 10)::int), 4) as top10, 0::bigint as negatives, 0.0::double as false_positive_rate
    from (select q.query_id, coalesce(min(r.rank), 99) as place from qu q left join (select *, row_number() over (partition by query_id order by match_score desc, best_distance, video_id) as rank from
    (select *, round((0.5 * visual + 0.3 * frames + 0.2 * phash) / 1.0, 6) as match_score from ({_scored(10)}))) r on r.query_id = q.query_id and r.video_id = q.expected group by 1)""", "fr", "qu"))
def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    q = T.queries(spark, sf)
    r = _ranked(search.rank_candidates(_grouped(spark, sf, 10), T.frames(spark, sf), q))
    return E.accuracy(q.select(F.col("query_id").alias("case_id"), "expected"), r.select(F.col("query_id").alias("case_id"), "video_id", "rank"))


@query(T.sql("select bucket, count(*) as n from (select case when duration_ms < 1 then null when duration_ms < 300000 then '<5m' when duration_ms <= 900000 then '5-15m' else '>15m' end as bucket from vi) group by all", "vi"))
def duration_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).groupBy(C.duration_bucket("duration_ms").alias("bucket")).agg(F.count("*").alias("n"))


@query(T.sql("""select policy, count(*) as cases, (select count(expected) from ca) as positives, round(count(*) filter (where hit1 and expected is not null) / (select count(expected) from ca), 4) as top1, round(count(*) filter (where hit5 and expected is not null) / (select count(expected) from ca), 4) as top5,
    count(err) as temporal_cases, quantile_disc(err, 0.5) as error_median, quantile_disc(err, 0.95) as error_p95, round(quantile_disc(err / (duration_ms / frame_count), 0.5), 4) as normalised_median,
    (max(frame_count) * count(distinct expected))::bigint as frames, count(distinct expected) as videos,
    round(quantile_disc(err / (duration_ms / frame_count), 0.5), 4) <= 0.5 and quantile_disc(err, 0.5) <= quantile_disc(duration_ms / frame_count / 2, 0.5) filter (where err is not null) as temporal_gate from ju group by policy""", "ca", "ob", "ju"))
def policy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.policy_metrics(T.cases(spark, sf), T.observations(spark, sf))


@query(T.sql("select policy, source || '/' || bucket as segment, count(*) as cases, round(avg(hit1::int), 4) as top1, round(avg(hit5::int), 4) as top5, quantile_disc(err, 0.5) as error_median from ju where expected is not null and bucket is not null group by all", "ca", "ob", "ju"))
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.segment_metrics(T.cases(spark, sf), T.observations(spark, sf))


@query(T.sql("select source || '/' || bucket as segment, round(avg(hit5::int) filter (where policy = 'dense'), 4) as one_top5, round(avg(hit5::int) filter (where policy = 'sparse'), 4) as other_top5 from ju where expected is not null and bucket is not null group by all", "ca", "ob", "ju"))
def segment_compare(spark: SparkSession, sf: str) -> DataFrame:
    return E.compare_segments(E.segment_metrics(T.cases(spark, sf), T.observations(spark, sf)), "dense", "sparse")


@query(T.sql("select count(distinct expected) as videos, round(1 - 8 / 30, 4) as reduction from ca", "ca"))
def frame_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return E.frame_reduction(T.cases(spark, sf), T.observations(spark, sf), "dense", "sparse")


@query()
def adoption_gates(spark: SparkSession, sf: str) -> DataFrame:
    c, o = T.cases(spark, sf), T.observations(spark, sf)
    return E.adoption(E.policy_metrics(c, o), E.frame_reduction(c, o, "dense", "sparse"), "dense", "sparse")


@query(T.sql("select policy, (select count(*) from ca where case_id::bigint % 6 = 1) as missing, 1::bigint as extra, (select count(*) from ca where case_id::bigint % 6 = 2) as duplicates from ob group by policy", "ca", "ob"))
def observation_integrity(spark: SparkSession, sf: str) -> DataFrame:
    o = T.observations(spark, sf)
    again = o.filter("position % 6 = 2")
    extra = o.filter("case_id = '6'").withColumn("case_id", F.lit("stranger"))
    return E.integrity(T.cases(spark, sf), o.filter("position % 6 <> 1").unionByName(again).unionByName(extra))


@query(T.sql("select count(*) as pairs, round(avg(case when s.err <= d.err then 100.0::double else 0 end), 4) as improved_or_equal from ju d join ju s using (case_id) where d.policy = 'dense' and s.policy = 'sparse' and d.err is not null and s.err is not null", "ca", "ob", "ju"))
def temporal_improvement(spark: SparkSession, sf: str) -> DataFrame:
    return E.improved_or_equal(T.cases(spark, sf), T.observations(spark, sf), "dense", "sparse")


# ---- refinement ---------------------------------------------------------------------------------------------------------------------------
@query(T.sql("select search_id, rank::int as rank, source from (select *, row_number() over (partition by search_id order by rank) as p from (select *, row_number() over (partition by search_id, source order by rank) as s from ra) where s <= case when source = 'src1' then 1 else 3 end) where p <= 3", "ra"))
def refinement_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return refine.candidate_prefix(T.ranked(spark, sf), 3, spark.createDataFrame([("src1", 1)], "source string, limit int")).select("search_id", "rank", "source")


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events")
    return e.select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "preview").otherwise("thumbnail").alias("kind"), F.concat(F.lit("u"), F.col("event_id") % 40).alias("url"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 20 * 1000).alias("timestamp_ms"), F.round("value", 3).alias("value"))


@query()
def byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    return refine.materialised_assets(_assets(spark, sf).withColumn("bytes", (F.col("value") * 1000).cast("long")), 6, 500_000)


@query()
def refine_assets(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf).withColumn("similarity", F.pmod("value", F.lit(1.0)))
    c = a.select("candidate_id").distinct().select("candidate_id", (F.col("candidate_id") % 20 * 1000).alias("base_timestamp_ms"), F.lit(0.5).alias("base_similarity"), F.when(F.col("candidate_id") % 3 != 0, F.lit(15_000)).alias("duration_ms"))
    return refine.refine(c, a)


@query("select user_id as search_id, count(*) as processed, count(*) filter (where event_type = 'error') as errors, case when bool_or(value > 400) then 'limited' when count(*) filter (where event_type = 'error') > 0 and not bool_or(event_id % 3 = 0) then 'failed' when bool_or(event_id % 3 = 0) then 'completed' else 'unavailable' end as status from events group by user_id")
def refinement_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("search_id"), (F.col("value") > 400).alias("limited"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 3 == 0).alias("evaluable"), F.lit(False).alias("improved"))
    return refine.summary(e).drop("improved")


@query("select user_id as search_id, min(event_id) as seq, 'sha256:' || sha256('u' || (event_id % 7)) as url_hash from events group by user_id, event_id % 7, event_id % 3")
def evidence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("search_id"), F.lit(1).alias("video_id"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("event_id") % 7).alias("url"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 3).cast("int")).alias("timestamp_ms"))
    return refine.first_evidence(e).select("search_id", "seq", "url_hash")


@query("select user_id as search_id, event_id as seq, (sum(event_id % 4000) over (partition by user_id order by event_id rows unbounded preceding))::bigint as spent_ms, sum(event_id % 4000) over (partition by user_id order by event_id rows unbounded preceding) > 10000 or event_id % 4000 > 3000 as limited from events")
def time_budget(spark: SparkSession, sf: str) -> DataFrame:
    return refine.within_budget(T.read(spark, sf, "events").select(F.col("user_id").alias("search_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 4000).alias("elapsed_ms")))


@query("select count(*) filter (where user_id > event_id) as processed_over_requested, 0::bigint as negative, count(*) filter (where value not between 0 and 1) as similarity_outside, count(*) filter (where event_type = 'click' and event_id % 9 = 0) as selected_without_time from events")
def telemetry_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events")
    return refine.telemetry_faults(e.select(F.col("user_id").alias("processed"), F.col("event_id").alias("requested"), F.col("value").alias("similarity"), (F.col("event_type") == "click").alias("selected"), F.when(F.col("event_id") % 9 != 0, F.lit(1)).alias("timestamp_ms")))


@query("select user_id as search_id, event_id as video_id, case when event_type = 'click' then 'asset' else 'frame' end as origin, case when event_type = 'click' then 'u' || event_id end as url from events")
def provenance_struct(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("search_id"), F.col("event_id").alias("video_id"), F.when(F.col("event_type") == "click", "improved").otherwise("unchanged").alias("status"), F.lit("s").alias("source"), F.lit("thumbnail").alias("kind"), F.concat(F.lit("u"), "event_id").alias("url"), F.lit(1).alias("position"))
    return refine.provenance(e).select("search_id", "video_id", "provenance.origin", "provenance.url")


# ---- sources and scalars ------------------------------------------------------------------------------------------------------------------
@query(r"""select page_id, case when url like '%@%' then null else lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) end as clean,
    regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) as host from pages""")
def sanitize_url(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", C.sanitize_url("url").alias("clean"), C.host_display("url").alias("host"))


@query(T.sql("select video_id, case when duration_ms is null or duration_ms < 0 then '—' else lpad((duration_ms // 1000 // 60)::varchar, greatest(2, length((duration_ms // 1000 // 60)::varchar))::int, '0') || ':' || lpad((duration_ms // 1000 % 60)::varchar, 2, '0') end as shown from vi", "vi"))
def format_position(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", C.format_position("duration_ms").alias("shown"))


@query("select page_id, nullif(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title, len(regexp_extract_all(coalesce(html, ''), '(?i)<a[^>]*href=\"([^\"]*)\"', 1)) as links, len(regexp_extract_all(coalesce(html, ''), '(?i)<p[ >]')) as paragraphs from pages")
def parse_page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_meta(T.read(spark, sf, "pages"))


@query("select page_id, count(distinct e) as ids from (select page_id, regexp_extract(h, '^/([^/?#]+)$', 1) as e from (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href=\"([^\"]*)\"', 1)) as h from pages)) where e <> '' group by page_id")
def parse_listing_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.listing_links(T.read(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("ids"))


@query("select p as page_no, coalesce(f, 0) as fresh, f is not null as goes_on from (select distinct event_id // 50 as p from events) left join (select p2, count(*) as f from (select min(event_id // 50) as p2 from events group by user_id) group by 1) on p2 = p")
def paging_antiloop(spark: SparkSession, sf: str) -> DataFrame:
    return pages.useless_pages(T.read(spark, sf, "events").select(F.expr("event_id div 50").alias("page_no"), F.col("user_id").alias("external_id")))


@query(T.sql("select source, external_id, n::int as n from (select *, row_number() over (partition by source order by video_id) as n from vi) where n <= 50 and video_id % 3 <> 0", "vi"))
def incremental_discover(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    return pages.discover(v.select("source", F.lit(0).alias("page_no"), F.col("video_id").alias("place"), "external_id"), v.filter("video_id % 3 = 0"), 50)


@query(T.sql("select video_id, sha256('{\"interval\":120,\"source\":\"' || source || '\"}') as hash from vi", "vi"))
def profile_hash(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", F.sha2(F.to_json(F.struct(F.lit(120).alias("interval"), "source")), 256).alias("hash"))


@query("select event_type, date_trunc('day', ts) as day, count(*) as n from events group by all")
def event_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


from . import details, more  # noqa: E402, F401  they register the other queries
