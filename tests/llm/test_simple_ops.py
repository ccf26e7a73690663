"""Operators that look at one document at a time, against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelight.llm import decontaminate as D
from framelight.llm import exact_dedup as X
from framelight.llm import language_id as L
from framelight.llm import packing as P
from framelight.llm import quality as Q
from framelight.llm import tokens as T
from framelight.llm import url_filter as U
from framelight.llm.common import read_table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, False) for i, t in enumerate(texts)], schema)


ODD = [None, "", "   ", "a", "a ", " a\n", "b c", "b\tc", "é", "日本 語", "\x1f x", "word " * 4000, "x" * 30_000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").cache()


def check_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    got = {r.doc_id: r for r in X.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup(spark, documents):
    check_dedup(documents)
    check_dedup(frame(spark, ODD))
    check_dedup(frame(spark, [str(i % 3) + " " * (i % 5) for i in range(3000)]).repartition(7))
    check_dedup(frame(spark, ["copy "] * 2000 + [str(i // 2) for i in range(4000)]).repartition(40))
    assert X.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  b"), (7, "a b"), (7, "a b"), (8, "a  b"), (None, None)], "doc_id bigint, text string")
    rows = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in X.exact_dedup(docs).collect())
    assert rows == [("7", "8", 5, False)] * 2 + [("8", "8", 5, True)] + [("None", "8", 5, False)] * 2 + [("None", "None", 1, True)]


def test_merge_of_sorted_runs():
    """A digest that goes on over batches is one row; equal digests of other length or check stay apart."""
    import pyarrow as pa

    names = [*X.KEYS, "keep_id", "chars", "node", "group_size"]
    rows = [("a", 1, 1, 5, 9, 0, 2), ("a", 1, 1, 3, 4, 0, 1), ("a", 1, 1, 8, 4, 0, 4), ("a", 2, 1, 1, 4, 0, 1), ("a", 2, 2, 2, 4, 0, 1), ("b", 1, 1, 4, 4, 0, 1)]
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names=names) for i in range(0, len(rows), size)]
        got = pa.Table.from_batches(X.merge_sorted(iter(batches))).to_pylist()
        assert [(r["text_sha256"], r["norm_bytes"], r["norm_check"], r["keep_id"], r["group_size"]) for r in got] == [("a", 1, 1, 5, 7), ("a", 2, 1, 1, 1), ("a", 2, 2, 2, 1), ("b", 1, 1, 4, 1)]


def test_quality_held_out(spark, documents, sf_dir):
    rows = Q.quality_classifier(read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")).collect()
    quality = {r.doc_id: r.quality for r in read_table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) >= 0.95


def test_quality_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = Q.quality_classifier(frame(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(r.score is not None for r in rows)
    assert Q.quality_classifier(frame(spark, []), labels).count() == 0
    assert Q.quality_classifier(frame(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.train(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9 and model.pairs[0] == (0, 1)


def test_encoder_equals_whole_text(documents):
    encoder = T.WordEncoder()
    for text in [*(t or "" for t in ODD), "Don't we'll #foo ##  <|endoftext|> x", "It'S a1b22 É'll ßÿ× ÷ x\u0301 \u212b <|x a'veb !!'re~ ÀÖØ ñ5é ¡hé", *(r.text for r in documents.collect())]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def check_packing(docs, padding):
    encoder = T.WordEncoder()
    want = {r.doc_id: encoder.encode(r.text or "") + (2).to_bytes(4, "little") for r in docs.select("doc_id", "text").collect()}
    pieces = P.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0 and p.doc_tokens * 4 == len(want[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {i: b"".join(x for _, x in sorted(v)) for i, v in by_doc.items()} == want
    used = total = 0
    for v in by_sequence.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
        used, total = used + at, total + (at if at & (at - 1) == 0 else P.CAPACITY)
    assert total - used <= padding * total + P.CAPACITY


def test_packing(spark, documents):
    check_packing(documents, 0.02)
    check_packing(frame(spark, ODD), 0.02)
    assert P.pack(frame(spark, [])).count() == 0


def test_packing_merges_open_bins(spark, documents):
    """However many workers leave bins open, the last class takes less than one bin of each class."""
    many = documents.select("doc_id", "text").unionByName(documents.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    for parts in (2, 24):
        pieces = P.pack(many.repartition(parts, "doc_id")).select("length", "sequence_id").collect()
        last = [p.length for p in pieces if p.sequence_id >= P._REST_SEQUENCES]
        assert sum(last) <= P.CAPACITY * len({P.CAPACITY // p.length for p in pieces})
        assert any(P._MERGED_SEQUENCES <= p.sequence_id < P._REST_SEQUENCES for p in pieces)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 819, 1366, 2048, 2049, 4095, 4096, 4097, 12_000])
def test_cut(n):
    parts = P.cut(n)
    assert sum(parts) == n and all(0 < p <= P.CAPACITY for p in parts) and len(parts) <= n // P.CAPACITY + 8
    assert all((P.CAPACITY // p) * p >= P.CAPACITY * 0.98 for p in parts)


def test_token_counts(spark, documents):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (documents, frame(spark, ODD), frame(spark, [])):
        want = sorted(len(model.encode(r.text or "")) for r in docs.select("text").collect())
        for block in (7, T.BLOCK_TOKENS):
            if block == 7 and docs is documents:
                continue
            rows = T.token_counts(docs, block).collect()
            assert sorted(r.n_tokens for r in rows) == want and all(r.complete for r in rows)


def test_separator_scan_cut_off_document(spark):
    ids = np.array([5, 6, 2, 2, 7, 8, 9, 9, 2, 4], "<u2").tobytes()
    blocks = spark.createDataFrame([("f", k, bytearray(ids[k * 6 : k * 6 + 6])) for k in range(4)] + [("empty", 0, bytearray())], "file string, block bigint, data binary")
    rows = sorted((r.document, r.start, r.n_tokens, r.complete) for r in T.separator_scan(blocks, block_tokens=3).collect())
    assert rows == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 4, True), (3, 9, 1, False)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_contamination(docs, benchmark):
    windows = {}
    for r in benchmark.collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(r.item_id))
    lengths = {len(w) for w in windows}
    rows = {r.doc_id: r for r in D.decontaminate(docs, benchmark).collect()}
    for r in docs.select("doc_id", "text").collect():
        w, hit, items = words(r.text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        got = rows[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert got.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert sum(s.last_word - s.first_word + 1 for s in got.spans) == len(hit)


def test_decontamination(spark, documents, sf_dir):
    benchmark = read_table(spark, sf_dir, "benchmark")
    check_contamination(documents, benchmark)
    short = spark.createDataFrame([(1, "One two"), (2, "a"), (3, None), (4, "..."), (5, "x y z a b c d e f g h"), (2, "a")], "item_id bigint, text string")
    check_contamination(frame(spark, [*ODD, "one TWO one two", "x y z a b c d e f g h x y z a b c d e f g h", "one", "two. one? Two", "é a b"]), short)
    assert D.decontaminate(frame(spark, ODD), short.limit(0)).filter("contaminated").count() == 0
    assert D.decontaminate(frame(spark, []), short).count() == 0


def test_decontamination_in_blocks(spark, documents, sf_dir, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 500)
    check_contamination(documents, read_table(spark, sf_dir, "benchmark"))


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 500)
    index = D.FmIndex(text, 3)
    phrases = rng.integers(1, 4, (200, 4))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_language_held_out(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r for r in L.language_id(docs).collect()}
    pairs = [(r.lang, rows[r.doc_id]) for r in docs.select("doc_id", "lang").collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1 for _, g in pairs)
    assert np.mean([want == g.lang_pred for want, g in pairs if g.held_out]) >= 0.97


def test_language_odd_inputs(spark):
    rows = {r.doc_id: r for r in L.language_id(frame(spark, [*ODD, "123 !!", "١٢٣"])).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, len(ODD), len(ODD) + 1)] == ["und"] * 5
    assert {rows[i].lang_pred for i in (3, 8, 9)} == {"en"}
    assert L.language_id(frame(spark, [])).count() == 0
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert L.language_id(nothing).first().lang_pred == "und"
    unnamed = spark.createDataFrame([(None, "text", "en"), (None, None, "fr"), (1, "text", "de"), (1, "text", "de")], "doc_id bigint, text string, lang string")
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in L.language_id(unnamed).collect()) == [("1", False, "de")] * 2 + [("None", False, "de"), ("None", False, "und")]


def test_host_words_of_all_pages(spark):
    """A word behind 30,000 commoner ones, and one of the urls alone, still split hosts."""
    letters = "bcdfghjklmnpqrstvwxz"
    common = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:30_500]
    html = " ".join([*common, *common, "violet", "harbour"])
    pages = spark.createDataFrame([(1, "http://x.net/", html), (2, "http://y.net/", ""), (3, "http://x.net/lantern", None)], "page_id bigint, url string, html string")
    hosts = spark.createDataFrame([("violetharbour.net", 1), ("lanternharbour.net", 1), ("", 1)], "host string, size bigint")
    got = {r.host: r.named for r in U.host_tokens(pages, hosts).collect()}
    assert got == {"violetharbour.net": ["h:violet", "h:harbour", "h:net"], "lanternharbour.net": ["h:lantern", "h:harbour", "h:net"], "": []}


def check_urls(spark, pages, rules):
    """The whole operator against a plain one: counts of all words, Viterbi of each host, naive Bayes of what the rules decide."""
    rows = pages.collect()
    counts = Counter(w for r in rows for t in (r.url, r.html) for w in re.findall("[a-z]+", (t or "").lower()))
    segmenter = U.Segmenter.fit({w: n for w, n in counts.items() if len(w) > 1}, sum(counts.values()))
    tokens, labels, fold = {}, {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        rest = (r.url or "").partition("://")[2]
        host, path = re.match(r"[^/?#]*", rest)[0].translate(fold), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        tokens[r.page_id] = [t for h, x in (("h:", host), ("p:", path.lower())) for m in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", x) for t in ([f"{h}#{len(m)}"] if m[0].isdigit() else [h + w for w in (segmenter.split(m) if h == "h:" else [m])])]
        fits = [(len(rule), verdict) for verdict, rule in rules if ("." + host).endswith("." + rule.partition("/")[0]) and path.startswith("".join(rule.partition("/")[1:]))]
        labels[r.page_id] = max(fits)[1] if fits else None
    bags = {v: Counter(t for i, x in tokens.items() if labels[i] == v for t in x) for v in ("allow", "block")}
    types = len({t for x in tokens.values() for t in x})
    seen = Counter(labels.values())
    got = {r.page_id: r for r in U.url_filter(pages, rules).collect()}
    assert got.keys() == tokens.keys()
    for i, x in tokens.items():
        odds = math.log((seen["block"] + 1) / (seen["allow"] + 1))
        for t in x:
            allow, block = ((bags[v][t] + U.SMOOTHING) / (sum(bags[v].values()) + U.SMOOTHING * types) for v in ("allow", "block"))
            odds += math.log(block / allow)
        assert got[i].block_score == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, odds)))), rel=1e-6)
        assert got[i].verdict == (labels[i] or ("block" if odds > 0 else "allow")) or abs(odds) < 1e-9


def test_url_filter_whole(spark, sf_dir):
    check_urls(spark, read_table(spark, sf_dir, "pages"), U.RULES)
    long = "http://" + "meadow" * 60 + ".com/de/"
    urls = ["http://casino.org/x", "http://garden.org/y/y", "http://casinogarden.com/de/x", "http://gardencasino.net/q", long, "http://" + "z" * 80 + ".net/", None, "http://12.ÉÉ.net/Ä/٣", "http://garden.org/y/y"]
    check_urls(spark, spark.createDataFrame([(i, u, "casino garden meadow " + "w" * 40) for i, u in enumerate(urls) if u != long], "page_id bigint, url string, html string"), U.RULES)
    pages = spark.createDataFrame([(i, u, None, "v", "h") for i, u in enumerate([*urls, long])], "page_id bigint, url string, html string, verdict string, host string")
    rows = {r.page_id: r for r in U.url_filter(pages).collect()}
    assert len(rows) == len(urls) + 1 and rows[4].host == "meadow" * 60 + ".com" and rows[4].verdict == "block"


def test_url_filter_without_labels(spark, sf_dir):
    rows = U.url_filter(read_table(spark, sf_dir, "pages"), rules=()).collect()
    assert {(r.rule, r.verdict) for r in rows} == {(None, "allow")} and all(abs(r.block_score - 0.5) < 1e-9 for r in rows)


def test_url_filter_held_out(spark):
    """Urls that rules decide, a fifth of them kept from learning: naive Bayes agrees with the rules on most."""
    held = F.crc32(F.concat("host", "path")) % 5 == 0
    rows = U.url_filter(read_table(spark, "/root/testdata/sf0.1", "pages"), learn_from=~held).filter(held & F.col("rule").isNotNull()).collect()
    share = np.mean([(r.block_score > 0.5) == (r.verdict == "block") for r in rows])
    common = max(np.mean([r.verdict == v for r in rows]) for v in ("allow", "block"))
    print(f"urls {len(rows)}, agreement {share:.4f}, commonest verdict {common:.4f}")
    assert len(rows) > 100 and share > common + 0.05


def test_url_filter(spark, sf_dir):
    urls = [None, "", "no scheme", "https://A.Example.ORG/es/1?x", "http://example.org/en/15", "http://x.org", "http://x.org/", "ftp://a.com/fr/z#f", "http://b.COM/de/", "http://cheap-pills.example.net/en/1", "http://theren.example.net/en/2", "://h/p", "http://h?q/://z", "http://org/x", "http://notorg/x"]
    pages = spark.createDataFrame([(i, u, "the ren cheap casino words the ren") for i, u in enumerate([*urls, *(["http://cheappills.example.net/en/1", "http://theren.example.net/en/2"] * 20)])], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in U.url_filter(pages).collect()}
    want = {0: ("", "", None), 2: ("", "", None), 3: ("a.example.org", "/es/1", "example.org/es/"), 4: ("example.org", "/en/15", "example.org/en/1"), 5: ("x.org", "", None), 6: ("x.org", "/", "org/"), 7: ("a.com", "/fr/z", "com/fr/"), 8: ("b.com", "/de/", "com/de/"), 11: ("h", "/p", None), 12: ("h", "", None), 13: ("org", "/x", "org/"), 14: ("notorg", "/x", None)}
    for i, w in want.items():
        assert (rows[i].host, rows[i].path, rows[i].rule) == w, urls[i]
    assert rows[3].verdict == rows[4].verdict == rows[8].verdict == "block"
    assert rows[6].verdict == rows[7].verdict == "allow"
    assert U.url_filter(pages.limit(0)).count() == 0
    assert all(r.verdict in ("allow", "block") for r in U.url_filter(read_table(spark, sf_dir, "pages")).collect())


def test_viterbi_is_the_best_split():
    s = U.Segmenter.fit({"the": 50, "rest": 20, "there": 5, "st": 4, "a": 9}, 88)

    def cost(parts):
        return sum(s.cost.get(p, s.unknown + 2.5 * len(p)) for p in parts)

    def splits(name):
        return [[name]] + [[name[:i], *rest] for i in range(1, len(name)) for rest in splits(name[i:])]

    for name in ("therest", "theresta", "zzthe", "thereast"):
        assert cost(s.split(name)) == pytest.approx(min(map(cost, splits(name))))
