"""Order-dependent and non-SQL operators against folds in plain Python, and the reference's numeric examples."""

import hashlib
import random
import uuid
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelight.functions import columns as C
from framelight.operators import folds, jobs, refine, search, store
from framelight.sources import pages
from framelight.sources.paged import PagedCatalogue
from framelight.streaming import events


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_rank_example(spark):
    """Distance 0.2, all frames, 16 differing bits: 0.5 * 0.8 + 0.3 * 1 + 0.2 * 0.75 = 0.85."""
    c = spark.createDataFrame([(1, 5, 4, 0.2, 9, None)], "query_id long, video_id long, matching_frames long, best_distance double, best_frame_id long, best_timestamp_ms long")
    f = spark.createDataFrame([(9, 0xFFFF)], "frame_id long, phash long")
    q = spark.createDataFrame([(1, 0)], "query_id long, phash long")
    assert search.rank_candidates(c, f, q).first().match_score == pytest.approx(0.85)
    assert search.rank_candidates(c, f.limit(0), q).first().match_score == pytest.approx(0.7)
    assert search.rank_candidates(c, f, q, min_score=0.86).count() == 0
    with pytest.raises(ValueError):
        search.RankingWeights(0, 0, 0)


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)] + [(300, [0.0] * 6), (301, None)]
    f = spark.createDataFrame(vectors, "frame_id long, embedding array<double>").repartition(5)
    q = f.filter("frame_id % 50 = 0 and frame_id < 301").select(F.col("frame_id").alias("query_id"), "embedding")
    for block in (2, 4096):
        got = {(r.query_id, r["rank"]): r.frame_id for r in search.knn(f, q, 7, block).collect()}
        for qid, v in [x for x in vectors if x[0] % 50 == 0 and x[0] < 301]:
            d = search.distances(np.array([x[1] for x in vectors[:301]]), np.array([v]))[:, 0].round(12)
            assert [got[qid, k + 1] for k in range(7)] == sorted(range(301), key=lambda i: (d[i], i))[:7]


def test_greedy_dedupe(spark):
    rng = random.Random(1)
    rows = [(v, i, rng.getrandbits(64) - (1 << 63) if rng.random() < 0.3 else (1 << rng.randrange(60)) * rng.randrange(8) % (1 << 62)) for v in range(8) for i in range(30)]
    kept = set()
    for v in range(8):
        have = []
        for _, i, p in sorted(r for r in rows if r[0] == v):
            if all(((p ^ x) & (2**64 - 1)).bit_count() > 10 for x in have):
                have.append(p)
                kept.add((v, i))
    got = folds.greedy_phash_dedupe(spark.createDataFrame(rows, "video_id long, position long, phash long"))
    assert {(r.video_id, r.position) for r in got.collect()} == kept


def test_multi_key_dedupe(spark):
    rng = random.Random(4)
    rows = [(v, i, rng.randrange(9), rng.choice([None, rng.randrange(9)]), rng.randrange(9)) for v in range(9) for i in range(14)]
    kept = set()
    for v in range(9):
        p, t, h = set(), set(), set()
        for _, i, a, b, c in (r for r in rows if r[0] == v):
            if a not in p and (b is None or b not in t) and c not in h:
                p.add(a), h.add(c), b is not None and t.add(b)
                kept.add((v, i))
    got = folds.multi_key_dedupe(spark.createDataFrame(rows, "video_id long, seq long, position long, timestamp_ms long, phash long"))
    assert {(r.video_id, r.seq) for r in got.collect()} == kept


def fold_representative(frames, duration, most, interval):
    timed, untimed, seen = [], [], set()
    known = duration is not None and duration > 0
    for i, t in frames:
        t = t if t is not None and t >= 0 and (not known or t < duration) else None
        if t is None:
            untimed.append((t, i))
        elif t not in seen:
            seen.add(t)
            timed.append((t, i))
    wanted = most if not known else min(most, max(1, ceil(duration / interval)))
    n = min(wanted, len(timed) + len(untimed))
    if known and len(timed) >= n:
        ideals = list(dict.fromkeys(max(0, min(round((k + 0.5) * duration / wanted), duration - 1)) for k in range(wanted)))
        left, out = list(timed), []
        for x in ideals:
            if left:
                best = min(left, key=lambda f: (abs(f[0] - x), f[0], f[1]))
                left.remove(best)
                out.append(best)
    else:
        out = (sorted(timed) + untimed)[:n] if not known else (timed + untimed)[:n]
    return sorted(out, key=lambda f: (f[0] is None, f[0] or 0, f[1]))


def test_select_representative(spark):
    rng = random.Random(7)
    items = {v: (rng.choice([None, 0, 5, 1000, 60_000]), [(i, rng.choice([None, rng.randrange(-50, 70_000), rng.randrange(0, 900)])) for i in range(rng.randint(1, 12))]) for v in range(60)}
    rows = [(v, d, i, t) for v, (d, frames) in items.items() for i, t in frames]
    got = {}
    for r in folds.select_representative(spark.createDataFrame(rows, "video_id long, duration_ms long, seq long, timestamp_ms long"), 5, 15_000).orderBy("video_id", "place").collect():
        got.setdefault(r.video_id, []).append((r.timestamp_ms, r.seq))
    assert got == {v: fold_representative(frames, d, 5, 15_000) for v, (d, frames) in items.items()}


def test_gallery_positions(spark):
    rows = [(1, [1, 2, 3], 30, 600_000), (2, [5], 3, 10_000_000), (3, [9, 1, 4, 30, 12, 20], 30, None), (4, list(range(1, 31)), 30, 480_000), (5, [28, 29, 30], 30, 10_000_000)]
    got = {r.video_id: r.chosen for r in folds.gallery_positions(spark.createDataFrame(rows, "video_id long, positions array<int>, gallery_max int, duration_ms long")).collect()}
    assert got[2] == [1, 2, 3] or len(got[2]) == 3
    assert got[3] == [1, 4, 9, 12, 20, 30] and got[4] == [4, 11, 19, 26]
    assert {1, 2, 3} <= set(got[1]) and len(got[1]) == 5 and {28, 29, 30} <= set(got[5]) and len(got[5]) == 8


def test_scalars(spark):
    assert one(spark, C.uuid5(C.FRAME_NAMESPACE, F.lit("añb:7"))) == str(uuid.uuid5(uuid.UUID(C.FRAME_NAMESPACE), "añb:7"))
    assert one(spark, C.sanitize_url(F.lit("HTTPS://Ex.ORG:81/A?b#c"))) == "https://ex.org:81/A"
    assert one(spark, C.sanitize_url(F.lit("http://u:p@ex.org/"))) is None and one(spark, C.host_display(F.lit("x"))) == "—"
    assert one(spark, C.format_position(F.lit(7_265_000))) == "121:05" and one(spark, C.format_position(F.lit(-1))) == "—"
    assert one(spark, C.slug(F.lit("  a b/c. "))) == "a_b_c" and one(spark, C.slug(F.lit("??"))) == "item"
    assert one(spark, C.clean_tags(F.lit(" a, b,,a ,c"))) == ["a", "b", "c"]
    assert [one(spark, C.milliseconds(F.lit(1.2345), r)) for r in ("round", "truncate", "whole")] == [1234, 1234, 1000]
    assert one(spark, C.error_class(F.lit(500), F.lit("metadatos"))) == "terminal" and one(spark, C.error_class(F.lit(500), F.lit("metadatos"), True)) == "transient"
    assert one(spark, C.sniff_image(F.lit(bytes.fromhex("ffd8ffe000")))) == "image/jpeg" and one(spark, C.sniff_image(F.lit(b"RIFF0000WEBPVP8 "))) == "image/webp"
    assert [one(spark, C.lenient_int(F.lit(x))) for x in (" 7 ", "7.0", "7.5", "x")] == [7, 7, None, None]
    assert one(spark, C.to_signed(C.to_unsigned(F.lit(-5)))) == -5
    assert one(spark, C.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0
    assert one(spark, C.sprite_grid(F.lit("a.9.s.jpg"))).columns == 9 and one(spark, C.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert one(spark, folds.gallery_timestamp(F.lit(9), F.lit(30), F.lit(1_516_000))) == 454_800


def test_rate_limit(spark):
    rows = [("a", float(t)) for t in (0, 10, 20, 9000)]
    got = jobs.rate_limit(spark.createDataFrame(rows, "source string, arrival_ms double"), 2.0, 400).orderBy("i").collect()
    assert [r.start_ms for r in got] == [0, 400, 800, 9000]
    slow = jobs.rate_limit(spark.createDataFrame([("a", 0.0)] * 5 + [("b", 7.0)], "source string, arrival_ms double"), 0.5, 2000).orderBy("source", "i").collect()
    assert [round(r.start_ms) for r in slow] == [1000, 4000, 7000, 10000, 13000, 1007]
    counted = {r.source: tuple(r)[1:] for r in jobs.rate_accounting(spark.createDataFrame(slow)).collect()}
    assert counted == {"a": (5, 5, 35000), "b": (1, 1, 1000)}


def test_refine_rules(spark):
    c = spark.createDataFrame([(i, 5, 0.5, 100) for i in range(1, 6)], "candidate_id long, base_timestamp_ms long, base_similarity double, duration_ms long")
    a = [(1, 0, "u", 7, 0.9), (1, 1, "v", 8, 0.8), (2, 0, "u", 7, 0.9), (2, 1, "v", 8, 0.9), (3, 0, "u", 5, 0.9), (4, 0, "u", 100, 0.9), (4, 1, "u", None, 0.9), (4, 2, "w", 1, 0.4)]
    got = {r.candidate_id: (r.timestamp_ms, r.status, r.evaluated, r.discarded) for r in refine.refine(c, spark.createDataFrame(a, "candidate_id long, seq long, url string, timestamp_ms long, similarity double")).collect()}
    assert got == {1: (7, "improved", 2, 0), 2: (5, "unchanged", 2, 0), 3: (5, "unchanged", 1, 0), 4: (5, "unchanged", 1, 2), 5: (5, "unchanged", 0, 0)}


def test_byte_budget(spark):
    a = [(1, i, k, u, t, b) for i, (k, u, t, b) in enumerate([("thumbnail", "a", 1, 40), ("preview", "b", 1, 40), ("thumbnail", "a", 1, 40), ("storyboard", "c", 2, 50), ("thumbnail", "d", 3, 20), ("thumbnail", "e", 4, 1)])]
    got = [r.fate for r in refine.materialised_assets(spark.createDataFrame(a, "candidate_id long, seq long, kind string, url string, timestamp_ms long, bytes long"), 30, 100).orderBy("seq").collect()]
    assert got == ["accepted", "kind", "duplicate", "accepted", "bytes", "bytes"]


def test_store(spark, tmp_path):
    f = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c")], "video_id long, frame_id long, x string")
    b = spark.createDataFrame([(1, 10, "z", 2), (1, 10, "y", 1), (3, 30, "n", 1)], "video_id long, frame_id long, x string, seq int")
    once = store.upsert(f, b, ["video_id", "frame_id"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, 10, "z"), (1, 11, "b"), (2, 20, "c"), (3, 30, "n")]
    assert sorted(map(tuple, store.upsert(once, b, ["video_id", "frame_id"], "seq").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, store.insert_missing(f, b, ["video_id", "frame_id"], "seq").collect())) == [(1, 10, "a"), (1, 11, "b"), (2, 20, "c"), (3, 30, "n")]
    faults = store.replacement_faults(spark.createDataFrame([(1, 1, 5), (1, 1, 5), (9, 2, None)], "video_id long, frame_id long, timestamp_ms long"), spark.createDataFrame([(1,), (2,)], "video_id long"))
    assert {tuple(r) for r in faults.collect()} == {(1, "duplicate_id"), (1, "duplicate_position"), (2, "empty"), (9, "foreign")}
    store.publish(f, str(tmp_path / "t"))
    store.publish(once, str(tmp_path / "t"))
    assert store.current(spark, str(tmp_path / "t")).count() == 4
    log = spark.createDataFrame([(1, 1, "indexing", 3, 50, None), (1, 2, "failed", None, None, "x"), (1, 3, "indexing", None, None, None), (2, 1, "indexed", 4, 9, "old")], "video_id long, seq long, status string, frame_count long, duration_ms long, error string")
    assert {tuple(r) for r in store.states_after(log).collect()} == {(1, "indexing", 3, 50, None), (2, "indexed", 4, 9, None)}


def test_compliance(spark):
    rows = [("a", True, True, "2024", True), ("b", False, True, None, False), ("c", None, False, "2024", None)]
    got = {r.source: r.faults for r in jobs.compliance_faults(spark.createDataFrame(rows, "source string, robots_reviewed boolean, terms_reviewed boolean, review_date string, enabled boolean")).collect()}
    assert got == {"a": [], "b": ["robots_reviewed", "review_date", "enabled"], "c": ["robots_reviewed", "terms_reviewed", "enabled"]}



def test_sources(spark):
    body = '{"gifs":[{"id":"Ab","duration":1.5,"createDate":10,"urls":{"thumbnail":"t"}},{"id":null},{"id":"aB","duration":9}]}'
    rows = pages.json_items(spark.createDataFrame([(1, body), (2, "broken")], "page_id long, body string")).collect()
    assert [(r.external_id, r.duration_ms, r.tags) for r in rows] == [("ab", 1500, [])]
    g = pages.gallery(spark.createDataFrame([(1, "t", ["p", "t", "q"]), (2, None, None)], "item_id long, thumbnail string, posters array<string>")).orderBy("position").collect()
    assert [(r.kind, r.url) for r in g] == [("thumbnail", "t"), ("storyboard", "p"), ("storyboard", "q")]
    assert pages.storyboard_assets(pages.synthetic_catalogue(spark, 50)).count() == 240
    spark.dataSource.register(PagedCatalogue)
    assert spark.read.format("paged_catalogue").option("total", 23).option("size", 5).load().select("external_id").distinct().count() == 23


def test_streams(spark, tmp_path):
    rows = [(j, s, x) for j in range(20) for s, x in enumerate(["pending", "running", "done" if j % 2 else "pending", "running"])]
    spark.createDataFrame(rows, "job_id long, seq long, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, seq long, status string").parquet(str(tmp_path / "in"))
    q = events.job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.job_id: r.status for r in spark.sql("select job_id, max_by(status, events) as status from states group by job_id").collect()}
    assert got == {j: "done" if j % 2 else "running" for j in range(20)}


def test_windows_of_events(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "e"))
    for name, f in (("tumble", events.tumbling), ("session", events.sessions)):
        q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and spark.table(name).count() > 0


def test_rules(spark):
    from framelight.functions import rules as R

    private = {"::1": True, "fd00::1": True, "fe80::2": True, "2001:db8::1": False, "::ffff:10.0.0.1": True, "8.8.8.8": False, "008.8.8.8": True, "x": True, "": True, "1.2.3": True}
    for ip, want in private.items():
        assert one(spark, R.private_ip(F.lit(ip))) is want, ip
    assert one(spark, R.private_ip(F.lit(None).cast("string"))) is True
    import zlib

    assert one(spark, R.stamp_colour(F.lit("x7"))) == f"#{zlib.crc32(b'x7') & 0xFFFFFF:06x}"
    assert one(spark, R.uniform_timestamps(F.lit(0), F.lit(3))) == [] and one(spark, R.uniform_timestamps(F.lit(10), F.lit(4))) == [0, 2, 5, 8]


def test_iso_instants_in_any_zone(spark):
    from framelight.functions import rules

    texts = {"2024-01-02": 1704153600, "2024-01-02T03:04": 1704164640, "2024-01-02 03:04:05.5+0200": 1704157445, "2024-01-02T03:04Z": 1704164640, "2024-13-02": None, "soon": None, None: None}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.iso_instant("t").cast("long").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {r["t"]: r["s"] for r in rows} == texts


def test_tables_are_published_together(spark, tmp_path):
    one, two, root = spark.range(3), spark.range(5), str(tmp_path / "index")
    store.publish_all({"videos": one, "frames": one}, root)
    broken = two.selectExpr("if(id = 4, raise_error('lost'), id) as id")
    with pytest.raises(Exception, match="lost"):
        store.publish_all({"videos": two, "frames": broken}, root)
    assert [store.current(spark, root, t).count() for t in ("videos", "frames")] == [3, 3]
    store.publish_all({"videos": two, "frames": one}, root)
    assert [store.current(spark, root, t).count() for t in ("videos", "frames")] == [5, 3]


def test_detail_pages_with_nothing_in_them(spark):
    from framelight.sources import details

    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "https://h/video.a/", "<meta property='og:title'>")], "page_id long, page_url string, html string")
    rows = {r["page_id"]: r for r in details.item_details(pages).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {1: "no_signal", 2: "no_signal", 3: "no_signal"}
    assert details.thumbnail_gallery(pages.selectExpr("page_id", "html", "page_url as thumbnail_url", "cast(null as bigint) as duration_ms")).count() == 0
    odd = spark.createDataFrame([(1, r"https:\/\/c\/a\Eb(\/xv_2_t.jpg", r"https://c/a\Eb(/xv_1_t.jpg", 10)], "page_id long, html string, thumbnail_url string, duration_ms long")
    assert [(r["position"], r["url"], r["timestamp_ms"]) for r in details.thumbnail_gallery(odd).collect()] == [(2, r"https://c/a\Eb(/xv_2_t.jpg", 9)]
    assert details.page_chain(pages.selectExpr("'s' as source", "page_url as path", "html"), spark.createDataFrame([("s", "/x")], "source string, path string"), 3).count() == 0


def test_fake_embedding_works_each_row_out_once(spark):
    """Pixels drawn at random at every evaluation: a vector of several draws is that of neither value, or not of unit length."""

    def expected(pixels, n):
        raw = b"".join(hashlib.sha256(pixels + block.to_bytes(4, "big")).digest() for block in range((n + 31) // 32))
        v = np.frombuffer(raw[:n], np.uint8) / 255
        return v / np.linalg.norm(v)

    for n in (1, 31, 32, 33, 40, 768):
        assert np.allclose(one(spark, C.fake_embedding(F.lit(b"pixels"), n)), expected(b"pixels", n), rtol=0, atol=1e-12)
    assert one(spark, C.fake_embedding(F.lit(None).cast("binary"), 40)[39]) is None
    drawn = F.when(F.rand(7) < 0.5, F.lit(b"a")).otherwise(F.lit(b"b"))
    rows = spark.range(20).select(C.fake_embedding(drawn, 32).alias("v")).collect()
    assert all(any(np.allclose(r.v, expected(p, 32), rtol=0, atol=1e-12) for p in (b"a", b"b")) for r in rows)
    units = spark.range(20).select(C.l2_normalise(F.array(*[F.rand(i) for i in range(8)])).alias("v")).collect()
    assert all(np.linalg.norm(r.v) == pytest.approx(1) for r in units)
    with pytest.raises(Exception, match="zero vector"):
        one(spark, C.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))))
