"""The reference model's tables, derived from the driver's: frames, items, sources, jobs, cases and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

# The same derivations in SQL, for DuckDB.
SQL = {
    "fr": """select vec_id as frame_id, vec_id // 10 as video_id, embedding::double[] as v, case when vec_id % 17 = 0 then null else (vec_id % 10) * 12000 end as timestamp_ms,
        list_reduce(list_prepend(0::bigint, list_transform(embedding, lambda x, i: case when x > 0 then (case when i = 64 then -9223372036854775808 else (1::bigint << (i - 1)::int) end) else 0::bigint end)), lambda a, b: a | b) as phash from embeddings""",
    "qu": "select frame_id as query_id, v as qv, phash as query_phash, video_id as expected from fr where frame_id % 100 = 0",
    "vi": """select d.doc_id as video_id, 'src' || (d.doc_id % 5) as source, 'x' || d.doc_id as external_id, n_chars * 100 as duration_ms, substr(text, 1, 40) as title, d.doc_id % 7 = 0 as excluded,
        case when d.doc_id % 3 = 0 then 'indexed' when d.doc_id % 3 = 1 then 'failed' else 'discovered' end as status, case when d.doc_id % 4 = 0 then 'timeout ' || d.doc_id end as error from documents d""",
    "so": "select distinct 'src' || (doc_id % 6) as source, doc_id % 6 % 3 <> 0 as enabled from documents",
    "jo": """select event_id as job_id, case when event_id % 3 = 0 then 'REINDEX' else 'DISCOVER' end as job_type, ts as created_at, ts as not_before, ts as locked_at, 'src' || (user_id % 6) as source,
        case event_type when 'view' then 'pending' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'unavailable' end as status,
        (event_id % 5)::bigint as attempts, 'key' || (user_id % 50) as dedupe_key, case when event_id % 5 = 0 then 404 when event_id % 5 = 1 then 503 end as http_status,
        case when event_id % 4 = 0 then 'item removed' else 'time out' end as error, value from events""",
    "ra": "select user_id as search_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank, case when event_id % 11 = 0 then null else 'src' || (event_id % 4) end as source from events",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    ts = F.when(F.col("vec_id") % 17 != 0, (F.col("vec_id") % 10) * 12000)
    return e.select(F.col("vec_id").alias("frame_id"), F.expr("vec_id div 10").alias("video_id"), ts.alias("timestamp_ms"), "embedding", C.sign_signature("embedding").alias("phash"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every frame whose id is divisible by 100."""
    return frames(spark, sf_dir).filter("frame_id % 100 = 0").select(F.col("frame_id").alias("query_id"), "embedding", "phash", F.col("video_id").alias("expected"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    status = F.when(d % 3 == 0, "indexed").when(d % 3 == 1, "failed").otherwise("discovered")
    return read(spark, sf_dir, "documents").select(
        d.alias("video_id"), F.concat(F.lit("src"), d % 5).alias("source"), F.concat(F.lit("x"), d).alias("external_id"), (F.col("n_chars") * 100).alias("duration_ms"), F.substring("text", 1, 40).alias("title"),
        (d % 7 == 0).alias("excluded"), status.alias("status"), F.when(d % 4 == 0, F.concat(F.lit("timeout "), d)).alias("error"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 6
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("src"), n).alias("source"), (n % 3 != 0).alias("enabled")).distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    status = F.when(t == "view", "pending").when(t == "click", "running").when(t == "purchase", "done").when(t == "error", "failed").otherwise("unavailable")
    return read(spark, sf_dir, "events").select(
        e.alias("job_id"), F.when(e % 3 == 0, "REINDEX").otherwise("DISCOVER").alias("job_type"), F.col("ts").alias("created_at"), F.col("ts").alias("not_before"), F.col("ts").alias("locked_at"), F.concat(F.lit("src"), F.col("user_id") % 6).alias("source"),
        status.alias("status"), (e % 5).alias("attempts"), F.concat(F.lit("key"), F.col("user_id") % 50).alias("dedupe_key"), F.when(e % 5 == 0, 404).when(e % 5 == 1, 503).alias("http_status"),
        F.when(e % 4 == 0, "item removed").otherwise("time out").alias("error"), "value",
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("search_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"), F.when(e % 11 != 0, F.concat(F.lit("src"), e % 4)).alias("source"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark cases from the customers: expected item, true time and duration."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.cast("string").alias("case_id"), F.when(k % 9 != 0, F.concat(F.lit("v"), k % 40)).alias("expected"), F.when(k % 2 == 0, "local").otherwise("web").alias("source"),
        (k % 40 * 31_000 + 60_000).alias("duration_ms"), (k % 40 * 15_500 + 30_000).alias("timestamp_ms"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies' answers to the cases: the dense one is always right, the sparse one off by a bit and sometimes wrong."""
    k = F.col("c_custkey")
    base = read(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("v"), k % 40).alias("right"), F.concat(F.lit("v"), (k + 1) % 40).alias("wrong"), (k % 40 * 15_500 + 30_000).alias("truth"))
    dense = base.select(F.lit("dense").alias("policy"), F.col("k").cast("string").alias("case_id"), F.col("k").alias("position"), F.col("right").alias("predicted"), F.array("right", "wrong").alias("ranked"), F.col("truth").alias("predicted_timestamp_ms"), F.lit(30).alias("frame_count"))
    miss = F.col("k") % 10 == 0
    sparse = base.select(F.lit("sparse").alias("policy"), F.col("k").cast("string").alias("case_id"), F.col("k").alias("position"), F.when(miss, F.col("wrong")).otherwise(F.col("right")).alias("predicted"), F.when(miss, F.array("wrong", "right")).otherwise(F.array("right", "wrong")).alias("ranked"), (F.col("truth") + F.col("k") % 7 * 500).alias("predicted_timestamp_ms"), F.lit(8).alias("frame_count"))
    return dense.unionByName(sparse)


SQL["ca"] = """select c_custkey::varchar as case_id, case when c_custkey % 9 <> 0 then 'v' || (c_custkey % 40) end as expected, case when c_custkey % 2 = 0 then 'local' else 'web' end as source,
    c_custkey % 40 * 31000 + 60000 as duration_ms, c_custkey % 40 * 15500 + 30000 as timestamp_ms from customer"""
SQL["ob"] = """select 'dense' as policy, c_custkey::varchar as case_id, 'v' || (c_custkey % 40) as predicted, ['v' || (c_custkey % 40), 'v' || ((c_custkey + 1) % 40)] as ranked, c_custkey % 40 * 15500 + 30000 as pts, 30 as frame_count from customer
    union all select 'sparse', c_custkey::varchar, case when c_custkey % 10 = 0 then 'v' || ((c_custkey + 1) % 40) else 'v' || (c_custkey % 40) end,
    case when c_custkey % 10 = 0 then ['v' || ((c_custkey + 1) % 40), 'v' || (c_custkey % 40)] else ['v' || (c_custkey % 40), 'v' || ((c_custkey + 1) % 40)] end, c_custkey % 40 * 15500 + 30000 + c_custkey % 7 * 500, 8 from customer"""
SQL["ju"] = """select o.*, c.expected, c.source, c.duration_ms, c.timestamp_ms, coalesce(ranked[1] = expected, false) as hit1, coalesce(list_contains(ranked[1:5], expected), false) as hit5,
    case when predicted = expected then abs(pts - timestamp_ms) end as err, case when duration_ms < 1 then null when duration_ms < 300000 then '<5m' when duration_ms <= 900000 then '5-15m' else '>15m' end as bucket from ob o join ca c using (case_id)"""


def sql(body: str, *names: str) -> str:
    """A query over derived tables: ``names`` in an order in which each uses only earlier ones."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + body
