"""Queries of the rules, the benchmark inputs, refinement outcomes and catalogue writes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules as R
from ..operators import evaluation as E
from ..operators import jobs, outcome
from ..sources import benchmark
from . import tables as T
from .catalogue import now, query


def _pick(key: str, *values: object):
    """values[key % n], a null among them too; and the same in SQL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: object) -> str:
    shown = ["null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{', '.join(shown)}])[({key} % {len(values)} + 1)::int]"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "events")


_MESSAGES = ("Video REMOVED", "robots.txt forbids it", "against the Terms of Service", "ToS", "http 404 seen", "http 410, gone", "not found", "deleted", "time out")


@query(f"""select event_id, case when s in (404, 410) or m like '%removed%' or m like '%robots%' or m like '%terms of service%' or m like '%tos%' or m like '%404%' then 'terminal' else 'transient' end as class
    from (select event_id, {_pick_sql('event_id', 500, 410, 500, 404, None)} as s, lower({_pick_sql('event_id // 5', *_MESSAGES)}) as m from events)""")
def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("k", F.expr("event_id div 5"))
    return e.select("event_id", C.error_class(_pick("event_id", 500, 410, 500, 404, None), _pick("k", *_MESSAGES)).alias("class"))


@query(T.sql("""select job_id, attempts + 1 as attempts, case when dead then 'failed' else 'pending' end as status, case when not dead then least(pow(2, attempts), 3600)::double end as delay_s
    from (select *, coalesce(http_status = 404, false) or error like '%removed%' or attempts + 1 >= 3 as dead from jo)""", "jo"))
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.after_failure(T.jobs(spark, sf), now()).drop("not_before")


@query(f"""select c_custkey as source, list_aggregate(list_filter([case when not coalesce({_pick_sql('c_custkey', True, False, None)}, false) then 'robots_reviewed' end, case when c_custkey % 4 = 0 then 'terms_reviewed' end,
    case when c_custkey % 5 = 0 then 'review_date' end, case when c_custkey % 7 = 0 then 'enabled' end], lambda x: x is not null), 'string_agg', ',') as faults from customer""")
def compliance_gate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    s = T.read(spark, sf, "customer").select(k.alias("source"), _pick("c_custkey", True, False, None).alias("robots_reviewed"), (k % 4 != 0).alias("terms_reviewed"), F.when(k % 5 != 0, "2024-01-01").alias("review_date"), (k % 7 != 0).alias("enabled"))
    return jobs.compliance_faults(s).select("source", F.nullif(F.array_join("faults", ","), F.lit("")).alias("faults"))


def _faulty_cases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("case_id").cast("long")
    c = T.cases(spark, sf).withColumns({
        "source": F.when(k % 31 == 0, " ").otherwise(F.lit("local")), "timestamp_ms": F.when(k % 37 == 0, -1).when(k % 41 == 0, F.col("duration_ms")).when(k % 43 != 0, F.col("timestamp_ms")),
        "duration_ms": F.when(k % 47 == 0, None).when(k % 59 == 0, 0).when(k % 61 == 0, 200_000).otherwise(F.lit(600_000)),
    })
    return c.unionByName(c.filter(k % 53 == 0))


_FAULTY = """ca2 as (select case_id, expected, case when k % 31 = 0 then ' ' else 'local' end as source, case when k % 37 = 0 then -1 when k % 41 = 0 then duration_ms when k % 43 <> 0 then timestamp_ms end as t,
    case when k % 47 = 0 then null when k % 59 = 0 then 0 when k % 61 = 0 then 200000 else 600000 end as d from (select *, case_id::bigint as k from ca)), cf as (select * from ca2 union all select * from ca2 where case_id::bigint % 53 = 0),
    po as (select *, case when d < 1 then null when d < 300000 then '<5m' when d <= 900000 then '5-15m' when d > 900000 then '>15m' end as bucket from cf where expected is not null),
    er as (select 'invalid_source:' || case_id as error from po where trim(source) = '' union select 'invalid_timestamp:' || case_id from po where t < 0 or (bucket is not null and t >= d)
    union select 'invalid_truth:' || case_id from po where d is null or d <= 0 or t is null or t < 0 or t >= d union select 'invalid_duration:' || case_id from po where bucket is null
    union select 'duplicate_case_ids:' || case_id from cf group by case_id having count(*) > 1 union select 'missing_sources:web' where not exists (from po where source = 'web')
    union select 'missing_duration_buckets:' || string_agg(b, ',' order by p) from (values ('<5m', 1), ('5-15m', 2), ('>15m', 3)) x(b, p) where b not in (select bucket from po where bucket is not null) having count(*) > 0
    union select 'segment_too_small:' || source || '/' || bucket || ':' || count(*) || '<60' from po where bucket is not null group by source, bucket having count(*) < 60
    union select 'minimum_positive_cases:' || count(*) || '<100000000' from po having count(*) < 100000000)"""


@query(T.sql("select error from er", "ca").replace(" select error from er", f", {_FAULTY} select error from er"))
def coverage_errors(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage_errors(_faulty_cases(spark, sf), 100_000_000, 60)


@query(T.sql("X", "ca").replace(" X", f", {_FAULTY} select count(*) as cases, count(distinct case_id) as distinct_cases, count(expected) as positives, count(distinct case when expected is not null then case_id end) as distinct_positives, (select count(distinct source) from po) as sources, (select count(distinct bucket) from po) as buckets, (select count(*) from er) as errors, false as valid from cf"))
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage(_faulty_cases(spark, sf), 100_000_000, 60)


_SPRITES = ("https://h/a/160x160.50.s.jpg", "https://h/526x298.s.webp?x=1", "https://h/a.webp", "https://h/9.7.s.png#f", "https://h/160x90.12.s.webp", "//h/1.4.s.jpeg", "/x/2.s.jpg", "https://h/?q=1.9.s.jpg", None)


@query(f"""select event_id, case when regexp_matches(p, '[0-9]+x[0-9]+\\.s\\.webp$') then 20 else try_cast(nullif(regexp_extract(p, '\\.([0-9]+)\\.s\\.(?:jpe?g|webp|png)$', 1), '') as int) end as columns
    from (select event_id, regexp_replace(u, '[?#].*$', '') as p from (select event_id, {_pick_sql('event_id', *_SPRITES)} as u from events))""")
def sprite_grids(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", C.sprite_grid(_pick("event_id", *_SPRITES))["columns"].alias("columns"))


@query()
def rate_limit_accounting(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("user_id").cast("string").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("arrival_ms"))
    return jobs.rate_accounting(jobs.rate_limit(e, 0.5, 2000))


@query("select 'src' || c_custkey as source, case when c_custkey % 3 = 0 then 500 else 2000 end as min_interval_ms, case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 4.0::double else 0.5::double end as max_rps from customer")
def rate_overrides(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    d = T.read(spark, sf, "customer").select(F.concat(F.lit("src"), k).alias("source"), F.lit(2000).alias("min_interval_ms"), F.lit(0.5).alias("max_rps"), k.alias("k"))
    return jobs.rate_specs(d.drop("k"), d.filter("k % 3 = 0").select("source", F.lit(500).alias("min_interval_ms"), F.when(F.col("k") % 2 == 0, 4.0).alias("max_rps")))


# ---- benchmark inputs ---------------------------------------------------------------------------------------------------------------------
@query("""select p.i::int as position, coalesce(case when c % 3 <> 0 then 'c' || c end, 'case-' || lpad(p.i::varchar, 6, '0')) as case_id, case when c % 4 = 0 then 'crop' else 'exact' end as variant, case when c % 5 = 0 then 'web' else 'local' end as source,
    case when c % 2 = 0 then 'sidecar/' || coalesce(case when c % 3 <> 0 then 'c' || c end, 'case-' || lpad(p.i::varchar, 6, '0')) else 'q' || c end as path from (select c_custkey as c, c_custkey % 1000 as i from customer) p""")
def case_defaults(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = T.read(spark, sf, "customer").select((k % 1000).cast("int").alias("position"), F.when(k % 3 != 0, F.concat(F.lit("c"), k)).alias("case_id"), F.when(k % 4 == 0, "crop").alias("variant"), F.when(k % 5 == 0, "WEB").when(k % 5 == 1, " ").alias("source"), F.when(k % 2 != 0, F.concat(F.lit("q"), k)).alias("query_image_path"))
    return benchmark.with_defaults(c).withColumnRenamed("query_image_path", "path")


@query("select 'm' || (c_custkey // 20) as folder, 'c' || c_custkey as case_id, case when c_custkey % 3 = 0 then '/abs/' || c_custkey else 'm' || (c_custkey // 20) || '/' || c_custkey end as path from customer")
def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    case = F.struct(F.concat(F.lit("c"), k).alias("case_id"), F.when(k % 3 == 0, F.concat(F.lit("/abs/"), k)).otherwise(k.cast("string")).alias("query_image_path"))
    files = T.read(spark, sf, "customer").groupBy(F.concat(F.lit("m"), F.expr("c_custkey div 20")).alias("folder")).agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("content"))
    return benchmark.manifest_cases(files).select("folder", "case_id", F.col("query_image_path").alias("path"))


@query("""select 'c' || k as case_id, 'v' || k as predicted, case when k % 4 = 3 then 'v' || k else 'v' || k || ',w' end as ranked, case when k % 5 = 0 then 'predicted_timestamp_ms' end as fault from (select c_custkey as k from customer)""")
def observation_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    two = F.array(F.concat(F.lit("v"), k), F.lit("w"))
    o = F.struct(F.concat(F.lit("c"), k).alias("case_id"), F.concat(F.lit("v"), k).alias("predicted_video_ref"), F.when(k % 5 == 0, -1).otherwise(k).alias("predicted_timestamp_ms"), F.when(k % 4 < 2, two).alias("ranked_video_refs"), F.when(k % 4 == 2, two).alias("ranked_videos"))
    listed = F.collect_list(o)
    shape = F.col("policy") % 3
    files = T.read(spark, sf, "customer").groupBy(F.expr("c_custkey div 20").alias("policy")).agg(listed.alias("l"))
    files = files.select("policy", F.when(shape == 0, F.to_json("l")).when(shape == 1, F.to_json(F.struct(F.col("l").alias("observations")))).otherwise(F.to_json(F.struct(F.col("l").alias("results")))).alias("content"))
    return benchmark.observations(files).select("case_id", "predicted", F.array_join("ranked", ",").alias("ranked"), "fault")


@query("select variant, count(*) as n from (select unnest(['exact', 'crop', 'jpeg']) as variant, vec_id from embeddings) where vec_id % 3 <> 0 or variant <> 'crop' group by variant")
def count_by_variant(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, ("exact", "crop", "jpeg")))).alias("variant"))
    return e.filter("vec_id % 3 <> 0 or variant <> 'crop'").groupBy("variant").agg(F.count("*").alias("n"))


@query()
def sample_variants(spark: SparkSession, sf: str) -> DataFrame:
    variants = spark.createDataFrame([("exact",), ("crop",)], "variant string")
    return E.sample_per_variant(T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id")), variants, 5, 7)


@query(T.sql("select policy, sum(k % 30)::bigint as assets, sum(k * 10)::bigint as bytes, sum(k % 4)::bigint as embeddings, quantile_disc(k % 997, 0.5) as p50, quantile_disc(k % 997, 0.95) as p95 from (select policy, case_id::bigint as k from ob where case_id in (select case_id from ca where expected is not null)) group by policy", "ca", "ob"))
def policy_costs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("case_id").cast("long")
    o = T.observations(spark, sf).select("policy", "case_id", (k % 30).alias("assets"), (k * 10).alias("bytes"), (k % 4).alias("embeddings"), (k % 997).alias("elapsed_ms"))
    return E.costs(T.cases(spark, sf).filter("expected is not null"), o)


@query("select f as frames, t as threshold, f * 100 as budget from (select unnest([10, 30, 60]) as f), (select unnest([0.8, 0.9]) as t)")
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    values = lambda name, *v: F.explode(F.array(*map(F.lit, v))).alias(name)
    return spark.range(1).select(values("frames", 10, 30, 60)).select("frames", values("threshold", 0.8, 0.9)).withColumn("budget", F.col("frames") * 100)


# ---- refinement outcomes ------------------------------------------------------------------------------------------------------------------
def _searches(spark: SparkSession, sf: str) -> DataFrame:
    return T.ranked(spark, sf).select("search_id", F.col("event_id").alias("video_id"), "rank", (F.col("event_id") * 10).alias("timestamp_ms"))


@query(T.sql("select search_id, event_id as video_id, rank::int as rank, case when event_id % 3 = 0 then event_id else event_id * 10 end as timestamp_ms from ra", "ra"))
def rewrite_results(spark: SparkSession, sf: str) -> DataFrame:
    r = _searches(spark, sf)
    return outcome.rewrite(r, r.filter("video_id % 3 = 0").select("search_id", "video_id", F.col("video_id").alias("timestamp_ms")))


@query(T.sql("select search_id, event_id as video_id, rank::int as candidate_rank, event_id % 4 = 0 as selected from ra where event_id % 2 = 0 and event_id % 5 <> 0", "ra"))
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("video_id")
    p = _searches(spark, sf).select("search_id", "video_id", F.when(v % 2 == 0, "refined_asset").otherwise("indexed_frame").alias("origin"), F.lit("thumbnail").alias("asset_kind"), F.when(v % 5 != 0, "u").alias("asset_url"), F.when(v % 4 == 0, "improved").otherwise("unchanged").alias("status"))
    return outcome.evidence(_searches(spark, sf), p).select("search_id", "video_id", "candidate_rank", "selected")


@query("select event_id, event_id % 7 + event_id % 3 as assets_requested, case when event_id % 2 = 0 then case when event_id % 11 > 5 then 'candidate_limit' when event_id % 13 * 1000 >= 10000 then 'search_timeout' else 'budget_exhausted' end end as limit_reason from events")
def refinement_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    s = _events(spark, sf).select("event_id", F.when(k % 2 == 0, "limited").otherwise("completed").alias("status"), (k % 11).alias("ranked"), F.lit(5).alias("requested"), (k % 7).alias("evaluated"), (k % 3).alias("discarded"), (k % 13 * 1000).alias("elapsed_ms"))
    return outcome.telemetry(s, 10_000).select("event_id", "assets_requested", "limit_reason")


@query(T.sql("select search_id, event_id as video_id, rank::int as rank, event_id * 10 as timestamp_ms, 'failed' as refinement_status, false as improved, 'indexed_frame' as origin from ra", "ra"))
def fallback_results(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.fallback(_searches(spark, sf), "failed")


@query("""select event_id, case when event_id % 7 not between 1 and 5 then 'candidate_limit' when event_id % 33 not between 1 and 30 then 'max_assets_per_candidate' when event_id % 12 * 1000 not between 1 and 10000 then 'search_timeout_ms'
    when event_id % 5 * 1000 not between 1 and 3000 or event_id % 5 > event_id % 12 then 'candidate_timeout_ms' when event_id % 19 < 1 then 'max_asset_bytes' when event_id % 17 = 0 then 'policy_version' end as fault from events""")
def policy_bounds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select("event_id", R.policy_error(k % 7, k % 33, k % 12 * 1000, k % 5 * 1000, k % 19, F.when(k % 17 == 0, " ").otherwise("v1")).alias("fault"))


# ---- rules --------------------------------------------------------------------------------------------------------------------------------
@query("select event_id, event_id % 3 <> 0 and event_id % 4 <> 0 and event_id % 5 <> 0 and (event_id % 7 = 0 or event_id % 11 <> 0) as refinable from events")
def refinable_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select("event_id", R.refinable(F.when(k % 3 != 0, "s"), F.when(k % 4 != 0, "a").otherwise(""), F.when(k % 5 != 0, "x"), F.when(k % 7 == 0, None).when(k % 11 == 0, -1).otherwise(5)).alias("refinable"))


@query("""select event_id, a = 10 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or a = 127 or (a = 169 and b = 254) or a = 0 or a > 255 as private from
    (select event_id, [10, 172, 192, 127, 169, 0, 8, 172, 192, 300, 11][event_id % 11 + 1] as a, [254, 16, 168, 31, 32, 15, 169][event_id % 7 + 1] as b from events)""")
def private_addresses(spark: SparkSession, sf: str) -> DataFrame:
    ip = F.concat(F.when(F.col("event_id") % 2 == 0, "::ffff:").otherwise(""), F.concat_ws(".", _pick("event_id", 10, 172, 192, 127, 169, 0, 8, 172, 192, 300, 11), _pick("event_id", 254, 16, 168, 31, 32, 15, 169), F.lit(1), F.lit(2)))
    return _events(spark, sf).select("event_id", R.private_ip(ip).alias("private"))


_PROFILES = ('{"mode":"adaptive","target_interval_seconds":120,"max_frames":8}', '{"mode":"uniform","target_interval_seconds":120,"max_frames":8}', '{"mode":"adaptive","target_interval_seconds":"120","max_frames":8}', '{"mode":"adaptive","target_interval_seconds":120,"max_frames":true}', '{"mode":"adaptive","max_frames":8}', '{"mode":"adaptive","target_interval_seconds":120,"max_frames":8,"x":1}', '[]', '{"mode":"adaptive","target_interval_seconds":60,"max_frames":8}', None)


@query(f"select event_id, {_pick_sql('event_id', None, 'mode', 'target_interval_seconds', 'max_frames', 'keys', 'keys', 'keys', 'target_interval_seconds', 'keys')} as fault from events")
def reindex_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", R.profile_error(_pick("event_id", *_PROFILES)).alias("fault"))


@query("""select event_id, d > 0 and t >= 0 and t < d as truth, event_id % 4 not in (0, 3) as ranking, case when event_id % 3 = 0 then 'assets' else '' end || case when event_id % 3 = 0 and event_id % 5 = 0 then ',' else '' end || case when event_id % 5 = 0 then 'bytes' else '' end as failures
    from (select event_id, event_id % 6 - 1 as d, event_id % 5 - 1 as t from events)""")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, sf).select("event_id", (k % 6 - 1).alias("d"), (k % 5 - 1).alias("t"), F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("a"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit(" "))).alias("r"), F.when(k % 3 == 0, -1).otherwise(1).alias("assets"), F.when(k % 5 != 0, 1).alias("bytes"))
    return e.select("event_id", R.inside_duration("t", "d").alias("truth"), R.valid_ranking("r", F.lit("a")).alias("ranking"), R.negative_counters("assets", "bytes").alias("failures"))


@query(f"select event_id, case when s = 404 then 'removed' when s between 200 and 299 and event_id % 2 = 0 then 'available' else 'unavailable' end as state from (select event_id, {_pick_sql('event_id', 404, 200, 204, 500, None, 301, 200)} as s from events)")
def availability_states(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", R.availability(_pick("event_id", 404, 200, 204, 500, None, 301, 200), F.col("event_id") % 2 == 0).alias("state"))


@query("select event_id, case when event_id % 5 < 4 then '6d9f0c0e-2c4a-4b7e-8f1a-3d5b7c9e0f2a' end as id from events")
def uuid_shapes(spark: SparkSession, sf: str) -> DataFrame:
    x = _pick("event_id", "6D9F0C0E-2c4a-4b7e-8f1a-3d5b7c9e0f2a", "{6d9f0c0e-2c4a-4b7e-8f1a-3d5b7c9e0f2a}", "urn:uuid:6d9f0c0e-2c4a-4b7e-8f1a-3d5b7c9e0f2a", "6d9f0c0e2c4a4b7e8f1a3d5b7c9e0f2a", "6d9f0c0e-2c4a-4b7e-8f1a-3d5b7c9e0f2")
    return _events(spark, sf).select("event_id", R.canonical_uuid(x).alias("id"))


@query("select event_id, 'discover:src' || (event_id % 3) || ':' || case when event_id % 4 = 0 then 'None' else event_id::varchar end || ':full' as key from events")
def composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select("event_id", R.composite_key(F.lit("discover"), F.concat(F.lit("src"), k % 3), F.when(k % 4 != 0, k), F.lit("full")).alias("key"))


@query("select event_id, case when event_id % 3 < 2 then 'https://h/p/xv_' || event_id || '_t.jpg' || case when event_id % 3 = 1 then '?a=xv_1_t.jpg' else '' end end as url from events")
def thumbnail_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", R.thumbnail_variant(_pick("event_id", "https://h/p/xv_15_t.jpg", "https://h/p/xv_2_t.jpg?a=xv_1_t.jpg", "https://h/p.jpg?xv_1_t.jpg"), F.col("event_id")).alias("url"))


@query("select event_id, case event_id % 5 when 0 then timestamp '2024-03-01 10:00:00' when 1 then timestamp '2024-03-01 08:30:00' when 2 then timestamp '2024-03-01 00:00:00' when 3 then timestamp '2024-03-01 10:00:00.25' end as at from events")
def iso_instants(spark: SparkSession, sf: str) -> DataFrame:
    t = _pick("event_id", "2024-03-01T10:00:00", "2024-03-01T10:00:00+01:30", "2024-03-01", "2024-03-01T10:00:00.25Z", "yesterday")
    return _events(spark, sf).select("event_id", F.to_timestamp_ntz(F.date_format(R.iso_instant(t), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("at"))


@query("select event_id, printf('%.3f', round((event_id % 1000 / 999.0::double)::decimal(30, 15), 3)::double) as shown from events")
def score_display(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", R.fixed3(F.col("event_id") % 1000 / F.lit(999.0)).alias("shown"))


@query()
def stamp_colours(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("external_id", R.stamp_colour("external_id").alias("colour"))


@query(T.sql("select video_id, round_even(i * duration_ms::double / 6, 0)::bigint as at from vi, range(6) r(i) where duration_ms > 0", "vi"))
def uniform_grid(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", F.explode(R.uniform_timestamps("duration_ms", F.lit(6))).alias("at"))


_SHA = "sha1(unhex('6d9f0c0e2c4a4b7e8f1a3d5b7c9e0f2a') || external_id::blob)"


@query(T.sql(f"select video_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::int & 3) + 1, 1) || h[18:20] || '-' || h[21:32] as id from (select video_id, {_SHA} as h from vi)", "vi"))
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return T.videos(spark, sf).select("video_id", C.uuid5(C.VIDEO_NAMESPACE, "external_id").alias("id"))


@query("select event_id, case when event_id % 7 > 0 then timestamp '1970-01-01' + to_seconds(event_id % 7 * 100000) end as at from events")
def epoch_to_ts(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", C.epoch_to_timestamp(F.col("event_id") % 7 * 100_000).cast("timestamp_ntz").alias("at"))


@query("select event_id, case event_id % 3 when 0 then 'a,b' when 1 then '' else 'x' end as tags from events")
def tags_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", F.array_join(C.clean_tags(_pick("event_id", " a, b ,,a", " , ", "x")), ",").alias("tags"))


@query("select page_id, nullif(regexp_extract(lower(url), '^https?://([^/:?#@]+)', 1), '') as host from pages where url not like '%@%' and regexp_matches(url, '^https?://[^/:?#]')")
def hosts_shown(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", C.host_display("url").alias("host")).filter("host <> '—'")


# ---- catalogue writes ---------------------------------------------------------------------------------------------------------------------
@query(T.sql("select source, source in ('src1', 'src2', 'src3') or enabled as enabled, source in ('src1', 'src2', 'src3') and not enabled as changed from so", "so"))
def set_source_enabled(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.set_if_different(T.sources(spark, sf), spark.createDataFrame([("src1",), ("src2",), ("src3",), ("none",)], "source string"), "source", "enabled", F.lit(True))


@query(T.sql("select video_id, case when source not in ('src1', 'src3') then source end as source from vi", "vi"))
def delete_sources(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.delete_source(T.sources(spark, sf), T.videos(spark, sf).select("video_id", "source"), spark.createDataFrame([("src1",), ("src3",)], "source string"))[1]


@query(T.sql("select source, case when source in ('src1', 'new') then 'http://m' else 'http://' || source end as base_url, coalesce(enabled, false) as enabled from (select * from so union all select 'new', null)", "so"))
def register_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).withColumn("base_url", F.concat(F.lit("http://"), "source"))
    return outcome.register_sources(s, spark.createDataFrame([("src1", "http://m"), ("new", "http://m")], "source string, base_url string"))


@query(T.sql("select video_id, case when video_id % 2 = 0 then 'removed' else status end as status, video_id % 2 = 0 as changed from vi", "vi"))
def set_video_status(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf).select("video_id", "status")
    return outcome.set_if_different(v, v.filter("video_id % 2 = 0"), "video_id", "status", F.lit("removed"))


@query(T.sql("select video_id, case when video_id % 4 = 0 and video_id % 8 < 7 then video_id % 9 else 0 end as frame_count, case when video_id % 4 = 0 and video_id % 3 = 0 then 77 else duration_ms end as duration_ms, status from vi", "vi"))
def reconcile_metadata(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf).select("video_id", F.lit(0).cast("long").alias("frame_count"), "duration_ms", "status")
    k = F.col("video_id")
    return outcome.reconcile(v, v.select(k, F.when(k % 4 == 0, k % 9).otherwise(-1).alias("frame_count"), F.when(k % 3 == 0, 77).alias("duration_ms")))


@query(T.sql("""select job_id, case when job_type = 'REINDEX' and job_id % 2 = 0 then '{"a":"1","result_frames":"' || job_id || '","result_outcome":"completed","result_reason":null}' else '{"a":"1","result_frames":"0"}' end as payload from jo""", "jo"))
def set_reindex_result(spark: SparkSession, sf: str) -> DataFrame:
    j = T.jobs(spark, sf).select("job_id", "job_type", F.lit('{"a":"1","result_frames":"0"}').alias("payload"))
    r = j.filter("job_id % 2 = 0").select("job_id", F.lit("completed").alias("outcome"), F.col("job_id").alias("frames"), F.lit(None).cast("string").alias("reason"))
    return outcome.merge_result(j, r).select("job_id", "payload")


@query(T.sql("select v.video_id, v.source, enabled from vi v join so using (source) where external_id = 'x' || (video_id // 10 * 10)", "vi", "so"))
def web_video_lookup(spark: SparkSession, sf: str) -> DataFrame:
    v = T.videos(spark, sf)
    asked = v.select("source", F.concat(F.lit("x"), F.expr("video_id div 10 * 10")).alias("external_id")).distinct()
    return v.join(T.sources(spark, sf), "source").join(asked, ["source", "external_id"], "left_semi").select("video_id", "source", "enabled")


@query(T.sql("select event_id % 10 as shard, to_json(map_from_entries(list((t, n) order by t)))::varchar as stats from (select event_id, event_type as t, count(*) over (partition by event_id % 10, event_type) as n, row_number() over (partition by event_id % 10, event_type) as p from events) where p = 1 group by 1", "jo"))
def stats_json(spark: SparkSession, sf: str) -> DataFrame:
    counts = _events(spark, sf).groupBy((F.col("event_id") % 10).alias("shard"), "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("shard").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("stats"))


@query(T.sql("select job_id from jo where status = 'pending' and not_before <= timestamp '2024-01-20 00:00:00'", "jo"))
def dispatchable_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.dispatchable(T.jobs(spark, sf), now()).select("job_id")


@query(T.sql("select video_id, count(*) as frames from fr group by video_id", "fr"))
def frames_per_video(spark: SparkSession, sf: str) -> DataFrame:
    return T.frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("frames"))


@query(T.sql("select query_id, frame_id, bit_count(xor(phash, query_phash))::int as bits from fr, qu where bit_count(xor(phash, query_phash)) <= 20", "fr", "qu"))
def hamming_to_query(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set, broadcast (a hundredth of the frames), against all frames."""
    q = T.queries(spark, sf).select("query_id", F.col("phash").alias("query_phash"))
    return T.frames(spark, sf).select("frame_id", "phash").join(q, C.hamming("phash", "query_phash") <= 20).select("query_id", "frame_id", C.hamming("phash", "query_phash").alias("bits"))
