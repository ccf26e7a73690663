"""Queries of detail pages, asset routing, worker outcomes and scalar rules, with their SQL.

Captured pages are made from the customers' keys; the SQL states the expected fields from those keys, without any page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import jobs
from ..sources import details as D
from . import tables as T
from .catalogue import now, query
from .more import _pick, _pick_sql


def _k() -> Column:
    return F.col("c_custkey")


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _if(test: Column, text: Column | str) -> Column:
    return F.when(test, F.lit(text) if isinstance(text, str) else text).otherwise("")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "customer")


def _detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    meta = lambda name, value: _say(f'<meta property="og:{name}" content="', value, '">')
    linked = (
        _say('{"uploadDate": "2024-01-02T03:04:05", "keywords": "a, b,,a , c', _k() % 3, '"}'),
        F.lit('[1, {"uploadDate": "2024-01-02T03:04:05+02:00", "keywords": ["x", "", 5, "x", "y"]}, {"keywords": "z"}]'), F.lit("{bad"), F.lit('{"uploadDate": 7, "keywords": {"a": 1}}'),
    )
    block = F.element_at(F.array(*linked), (_k() % 4 + 1).cast("int"))
    heading = _say('<h2 class="big page-title"> Item ', _k(), ' <span class="duration">14 min</span></h2>')
    html = F.concat(
        F.lit("<html><head>"), _if(_k() % 3 != 0, meta("title", _say("Item ", _k(), " &amp; co"))), _if(_k() % 5 != 0, meta("url", _say("https://h.example/video.a", _k(), "/slug"))),
        _if(_k() % 4 != 3, meta("duration", _pick("c_custkey", "120", "-5", "abc", "7"))), _if(_k() % 2 == 0, meta("image", _say("https://cdn.example/", _k(), ".jpg"))),
        _say('<script type="application/ld+json">', block, "</script></head><body>"), _if((_k() % 3 == 0) & (_k() % 4 != 0), heading), F.lit("</body></html>"),
    )
    return _customers(spark, sf).select(_k().alias("page_id"), F.when(_k() % 7 == 0, "https://h.example/other").otherwise(_say("https://h.example/video.b", _k())).alias("page_url"), F.when(_k() % 13 != 0, html).alias("html"))


@query("""select page_id, error, case when error is null then id end as external_id, case when error is null then title end as title, case when error is null and k % 2 = 0 then 'https://cdn.example/' || k || '.jpg' end as thumbnail_url,
    case when error is null and k % 4 = 0 then 120000::bigint end as duration_ms, case when error is null then case k % 4 when 0 then 1704164645::bigint when 1 then 1704157445::bigint end end as published_s,
    case when error is null then case k % 4 when 0 then 'a|b|c' || (k % 3) when 1 then 'x|y' else '' end end as tags
    from (select c_custkey as page_id, c_custkey as k, id, title, case when own is null and title is null then 'no_signal' when id is null then 'no_id' end as error
        from (select *, coalesce(own, case when c_custkey % 7 <> 0 then 'video.b' || c_custkey end) as id
            from (select c_custkey, case when c_custkey % 13 <> 0 and c_custkey % 5 <> 0 then 'video.a' || c_custkey end as own,
                case when c_custkey % 13 = 0 then null when c_custkey % 3 <> 0 then 'Item ' || c_custkey || ' & co' when c_custkey % 4 <> 0 then 'Item ' || c_custkey end as title from customer)))""")
def parse_details(spark: SparkSession, sf: str) -> DataFrame:
    return D.item_details(_detail_pages(spark, sf)).withColumns({"tags": F.array_join("tags", "|"), "published_s": F.col("published_at").cast("long")}).drop("published_at")


@query("""select c_custkey as page_id, case c_custkey % 6 when 0 then 't0' when 1 then 't1' when 2 then 't2' when 3 then 't1' end as template from customer""")
def sprite_templates(spark: SparkSession, sf: str) -> DataFrame:
    bodies = (
        '{"spriteLoader": {"template": "t0"}, "videoModel": {"spriteURL": "t2"}}', '{"spriteLoader": [1], "xplayerPluginSettings": {"spriteLoader": {"template": "t1"}}}', '{"videoModel": {"spriteURL": "t2"}}',
        '{"spriteLoader": {"template": ""}, "xplayerPluginSettings": {"spriteLoader": {"template": "t1"}}}', '{"spriteLoader": {"template": 5}}', "{bad}",
    )
    html = _say("<script id='initials-script'>window.initials=", _pick("c_custkey", *bodies), ";</script><img data-sprite='other'>")
    return _customers(spark, sf).select(_k().alias("page_id"), D.sprite_template(html).alias("template"))


def _numbered(links: int) -> Column:
    """A paging list of ``links`` pages for key k and page number ``at``; every third link names its host."""
    k, at = _k(), F.col("at")
    href = lambda i: _say("/tags/", k) if i == 0 else _say("https://h.example/tags/" if i % 3 == 2 else "/tags/", k, f"/{i}", "?x=1" if i % 3 == 2 else "")
    one = lambda i: F.when(at == i, f'<li><a class="active" href="">{i + 1}</a></li>').otherwise(_say('<li><a href="', href(i), f'">{i + 1}</a></li>'))
    return F.concat(F.lit('<a href="/before">b</a><div class="pagination "><ul>'), *[one(i) for i in range(links)], _say('<li><a class="no-page next-page" href="/tags/', k, '/99">Next</a></li></ul></div><a href="/after">a</a>'))


@query("""select c_custkey as page_id, case when c_custkey % 11 <> 0 and onward < 5 then '/tags/' || c_custkey || '/' || onward end as cursor
    from (select c_custkey, c_custkey % 5 + case when c_custkey % 6 = 0 then 2 else 1 end as onward from customer)""")
def next_cursors(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).withColumn("at", (_k() % 5).cast("int"))
    here = _say("/tags/", _k(), F.when(_k() % 6 == 0, _say("/", F.col("at") + 1)).otherwise(_if(F.col("at") > 0, _say("/", F.col("at")))))
    return c.select(_k().alias("page_id"), D.next_cursor(F.when(_k() % 11 != 0, _numbered(5)).otherwise("<p>none</p>"), here).alias("cursor"))


@query("""select c_custkey as source, i as place, '/tags/' || c_custkey || case when i = 0 then '' else '/' || i end as path
    from customer, range(4) t(i) where c_custkey % 10 = 0 and (c_custkey % 20 = 0 or i < 2)""")
def discover_chain(spark: SparkSession, sf: str) -> DataFrame:
    """At most four of five pages a source; half of the sources lost their third page."""
    c = _customers(spark, sf).filter("c_custkey % 10 = 0")
    pages = c.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("c_custkey % 20 = 0 or at <> 2")
    pages = pages.select(_k().alias("source"), _say("/tags/", _k(), _if(F.col("at") > 0, _say("/", F.col("at")))).alias("path"), _numbered(5).alias("html"))
    return D.page_chain(pages, c.select(_k().alias("source"), _say("/tags/", _k()).alias("path")), 4)


def _gallery_pages(spark: SparkSession, sf: str) -> DataFrame:
    base = _say(r"cdn.x\/", _k(), r"\/(1)\/xv_")
    html = F.concat(F.lit("<script>a='"), *[_say(r"https:\/\/", base, n, r"_t.jpg','") for n in ("1", "3", "01", _k() % 5 + 6)], _say(r"https:\/\/cdn.x\/other\/xv_25_t.jpg'</script>"))
    thumbnail = F.when(_k() % 8 == 7, None).when(_k() % 4 == 3, _say("https://cdn.x/", _k(), "/only.jpg")).otherwise(_say("https://cdn.x/", _k(), "/(1)/xv_3_t.jpg"))
    return _customers(spark, sf).select(_k().alias("page_id"), html.alias("html"), thumbnail.alias("thumbnail_url"), F.when(_k() % 3 != 0, _k() * 1000 + 1).alias("duration_ms"))


@query("""select c_custkey as page_id, p::int as position, 'https://cdn.x/' || c_custkey || '/(1)/xv_' || p || '_t.jpg' as url,
        case when c_custkey % 3 <> 0 then greatest(0, least(round_even(p::double / (c_custkey % 5 + 6) * (c_custkey * 1000 + 1), 0)::bigint, c_custkey * 1000)) end as timestamp_ms
        from (select c_custkey, unnest([1, 3, c_custkey % 5 + 6]) as p from customer where c_custkey % 4 <> 3)
    union all select c_custkey, null, 'https://cdn.x/' || c_custkey || '/only.jpg', null from customer where c_custkey % 8 = 3""")
def thumbnail_galleries(spark: SparkSession, sf: str) -> DataFrame:
    return D.gallery_or_thumbnail(_gallery_pages(spark, sf))


@query("""with i as (select c_custkey as k, case when c_custkey % 5 <> 0 then 't' || c_custkey end as t, case when c_custkey % 4 <> 0 then 'p' || c_custkey end as p from customer)
    select k as item_id, 'storyboard' as kind, p as url, null::int as position from i where k % 3 = 0 and p is not null
    union all select k, 'thumbnail', t, null from i where k % 3 in (0, 1) and t is not null
    union all select k, 'thumbnail', p, null from i where k % 3 = 1 and p is not null
    union all select k, case when pos = 1 then 'thumbnail' else 'storyboard' end, urls[pos], pos - 1 from (select k, urls, unnest(range(1, len(urls) + 1))::int as pos
        from (select k, list_filter([t, p, case when p is not null then 'q' || k end], lambda x: x is not null) as urls from i where k % 3 = 2))""")
def declared_assets(spark: SparkSession, sf: str) -> DataFrame:
    poster = _say("p", _k())
    posters = F.when(_k() % 4 == 0, F.expr("cast(null as array<string>)")).otherwise(F.array(poster, _say("q", _k()), poster))
    items = _customers(spark, sf).select(_k().alias("item_id"), _pick("c_custkey", "sprite", "pair", "album").alias("shape"), F.when(_k() % 5 != 0, _say("t", _k())).alias("thumbnail"), posters.alias("posters"))
    return D.declared_assets(items)


@query("""select c_custkey as item_id, case when c_custkey % 5 = 0 or c_custkey % 200 > 120 then null when c_custkey % 4 = 0 then '' else array_to_string(list_transform(range(c_custkey % 4), lambda i: round_even(i * 2500.5, 0)::bigint), ',') end as grid from customer""")
def preview_grids(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select(_k().alias("item_id"), F.array_join(D.preview_grid(F.when(_k() % 5 != 0, _k() % 200), 2.5005, (_k() % 4).cast("int")), ",").alias("grid"))


@query(T.sql("""select job_id, case when stale then 'pending' else status end as status, case when not stale then locked_at end as locked_at
    from (select *, status = 'running' and locked_at <= timestamp '2024-01-19 23:55:00' as stale from jo)""", "jo"))
def lease_reset(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.reset_stale(T.jobs(spark, sf), now()).select("job_id", "status", "locked_at")


_ERRORS = (None, "HTTPError", "Timeout", "ValueError")


@query(T.sql(f"""select job_id, case when job_type = 'REINDEX' and job_id % 2 = 0 then 'failed' when c is null then 'done' when dead then 'failed' else 'pending' end as status,
        case when job_type = 'REINDEX' and job_id % 2 = 0 then 'no handler: REINDEX2' when c is not null then e end as error,
        case when not (job_type = 'REINDEX' and job_id % 2 = 0) and c is not null and not dead then 1000.0::double * pow(2, attempts) end as delay_ms
    from (select *, coalesce(http_status = 404, false) or e like '%removed%' or attempts >= 2 as dead from (select *, c || case when error = 'time out' then '' else ': ' || error end as e
        from (select *, {_pick_sql('job_id', *_ERRORS)} as c from jo where status = 'running')))""", "jo"))
def worker_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    j = T.jobs(spark, sf).filter("status = 'running'").withColumns({
        "error_class": _pick("job_id", *_ERRORS), "error": F.when(F.col("error") == "time out", " ").otherwise(F.col("error")), "job_type": F.when((F.col("job_type") == "REINDEX") & (F.col("job_id") % 2 == 0), "REINDEX2").otherwise(F.col("job_type")),
    })
    return jobs.settle(j, ("DISCOVER", "REINDEX"), now())


@query(T.sql("""select video_id, case when gone = 'r' then 'removed' when gone = 'u' then 'unavailable' else status end as status, excluded or gone <> '' as excluded, case when gone = '' then coalesce(n, 0) else 0 end as frames
    from (select *, case when video_id % 2 = 1 then '' when video_id % 10 = 0 then 'r' when video_id % 10 = 4 then 'u' when video_id % 10 = 6 or video_id % 3 = 0 then 'u' else '' end as gone from vi)
    left join (select video_id, count(*) as n from fr group by video_id) using (video_id)""", "vi", "fr"))
def availability_sweep(spark: SparkSession, sf: str) -> DataFrame:
    v, k = T.videos(spark, sf), F.col("video_id")
    checks = v.filter(k % 2 == 0).select(k, F.when(k % 10 == 0, 404).when(k % 10 == 4, 503).when(k % 10 != 6, 200).alias("http_status"), (k % 3 != 0).alias("readable"))
    kept, frames = jobs.sweep(v.select("video_id", "status", "excluded"), T.frames(spark, sf).select("video_id"), checks)
    return kept.join(frames.groupBy("video_id").agg(F.count("*").alias("frames")), "video_id", "left").fillna(0, ["frames"])


@query(T.sql("select video_id as request_id, 'check_availability:' || source || ':' || external_id as dedupe_key, video_id % 4 = 0 as reused, case when video_id % 4 = 0 then -video_id else video_id end as target_id from vi", "vi"))
def sweep_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    v, k = T.videos(spark, sf), F.col("video_id")
    batch = v.select(k.alias("request_id"), F.lit("CHECK_AVAILABILITY").alias("job_type"), F.concat_ws(":", F.lit("check_availability"), "source", "external_id").alias("dedupe_key"))
    there = batch.select((-F.col("request_id")).alias("job_id"), "job_type", "dedupe_key", F.when(F.col("request_id") % 4 == 0, "running").otherwise("done").alias("status"))
    return jobs.enqueue(there, batch).drop("job_type")


@query(T.sql("select source, external_id from (select *, row_number() over (partition by source order by external_id) as n from vi where external_id > 'x1') where n <= 50", "vi"))
def external_ids_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 ids of each source behind a cursor: a page of a listing, the limit is the feature."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("external_id"))
    return T.videos(spark, sf).filter("external_id > 'x1'").withColumn("n", n).filter("n <= 50").select("source", "external_id")


@query(f"""select c_custkey as k, {_pick_sql('c_custkey', 'image/jpeg', 'image/png', 'image/webp', None, None, None)} as mime from customer""")
def mime_sniff(spark: SparkSession, sf: str) -> DataFrame:
    content = F.unhex(_pick("c_custkey", "FFD8FFE000", "89504E470D0A1A0A0000", "52494646AABBCCDD5745425056", "524946461122334455", "", None))
    return _customers(spark, sf).select(_k().alias("k"), C.sniff_image(content).alias("mime"))


@query("select c_custkey as k, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as slug from customer union all select 0, 'item'")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf).select(_k().alias("k"), "c_name")
    return rows.unionByName(rows.sparkSession.createDataFrame([(0, "_ !?.")], "k bigint, c_name string")).select("k", C.slug("c_name").alias("slug"))


@query(f"""select c_custkey as k, {_pick_sql('c_custkey', 'https://h.example/a?b', 'https://h.example/c', 'https://h.example/d', None, None, None, None)} as url from customer""")
def absolute_urls(spark: SparkSession, sf: str) -> DataFrame:
    href = _pick("c_custkey", "/a?b", "http://www.h.example/c", "https://h.example/d", "https://hxexample/e", "//h.example/f", "ftp://h.example/g", "https://h.example.org/h")
    return _customers(spark, sf).select(_k().alias("k"), C.absolute_url(href, "h.example").alias("url"))


@query(f"""select c_custkey as k, {_pick_sql('c_custkey', 7, -3, 12, None, None, None)}::bigint as whole, {_pick_sql('c_custkey', 25.0, None, 23.976023976023978, None, 1.0, 30.0)}::double as rate,
    round_even(c_custkey * 0.0005::double * 1000, 0)::bigint as rounded, floor(c_custkey * 0.25 * 1000)::bigint as cut, greatest(2, 2 * round_even((c_custkey % 700 + 1) * 160 / 320.0::double / 2, 0)::bigint) as height from customer""")
def media_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Integers, frame rates, milliseconds and even heights as probes of media files give them."""
    whole, rate = _pick("c_custkey", " 7 ", "-3", "12.0", "1.5", "x", None), _pick("c_custkey", "25/1", "1/0", "24000/1001", "x", "1", "30")
    return _customers(spark, sf).select(
        _k().alias("k"), C.lenient_int(whole).alias("whole"), C.frame_rate(rate).alias("rate"), C.milliseconds(_k() * F.lit(0.0005)).alias("rounded"), C.milliseconds(_k() * F.lit(0.25), "truncate").alias("cut"),
        C.even_height(F.lit(320), _k() % 700 + 1, 160).alias("height"),
    )


@query(T.sql("""select frame_id, round(greatest(0, least(1, list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)))), 6) as similarity, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first
    from (select *, list_transform(v, lambda x, i: x + i) as w from fr)""", "fr"))
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    other = F.transform("embedding", lambda x, i: x.cast("double") + i + 1)
    return T.frames(spark, sf).select("frame_id", F.round(C.cosine_similarity_strict("embedding", other), 6).alias("similarity"), F.round(C.l2_normalise("embedding")[0], 6).alias("first"))


@query("""select k, round(v[1] / n, 9) as first, round(v[40] / n, 9) as last from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n
    from (select c_custkey as k, list_transform(range(40), lambda i: ('0x' || substr(sha256(encode(c_name || '') || from_hex(case when i < 32 then '00000000' else '00000001' end)), 2 * (i % 32)::int + 1, 2))::int / 255.0::double) as v from customer))""")
def fake_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf).select(_k().alias("k"), C.fake_embedding(F.col("c_name").cast("binary"), 40).alias("v"))
    return rows.select("k", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[39], 9).alias("last"))
