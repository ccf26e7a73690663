"""Every stage against a brute-force version on its own input, and the whole run."""

import re

import corpus_pipeline as P
from framelight.llm import packing, quality
from framelight.llm.common import read_table

from .test_jaccard import brute
from .test_simple_ops import words


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        seen.append((name, docs, out))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), (_, i, j) = seen
    model = quality.fit_quality(a, read_table(spark, sf_dir, "labels"))
    want = {r.doc_id for r in quality.score_quality(a, model).collect() if r.score >= 0.3}
    assert set(rows(b)) == want and len(want) < a.count()
    best = {}
    for k, t in rows(c).items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(t or ""), k))
    assert set(rows(d)) == {k for _, k in best.values()}
    linked = brute(list(rows(e).items()), 5, 80)
    assert set(rows(f)) == {k for k, (_, component, _) in linked.items() if k == component}
    windows = {tuple(w[k : k + 10]) for r in read_table(spark, sf_dir, "benchmark").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9)) if w}
    clean = {k for k, t in rows(g).items() if not any(tuple(w[x : x + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for x in range(len(w) - n + 1))}
    assert set(rows(h)) == clean
    pieces = j.collect()
    assert {p.doc_id for p in pieces} == set(rows(i))
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert all(p.offset + p.length <= packing.CAPACITY for p in pieces)


def test_run_and_empty(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = docs if name == "packing" else out
    odd = spark.createDataFrame([(None, None, None), (1, None, "en"), (1, None, "en"), (2, "", None), (3, "a  b", "x"), (4, "a b", "x")], "doc_id bigint, text string, lang string")
    for name, stage in P.STAGES[1:4]:
        odd = stage(spark, odd, sf_dir)
        assert odd.columns == ["doc_id", "text", "lang"]
        odd = spark.createDataFrame(odd.collect(), odd.schema)
    assert 3 in {r.doc_id for r in odd.collect()}


def test_null_and_repeated_ids(spark, sf_dir):
    long = [f"w{i}" for i in range(80)]
    rows = [(None, "a b"), (None, "a b"), (None, "c d"), (5, "x y"), (5, "x y"), (None, " ".join(long)), (None, " ".join([*long[:-1], "z"])), (7, " ".join(["y", *long[1:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    exact = P.exact_duplicates(spark, docs, sf_dir)
    assert sorted(exact.collect(), key=str) == sorted(spark.createDataFrame([*rows[1:4], *rows[5:]], docs.schema).collect(), key=str)
    near = P.near_duplicates(spark, exact, sf_dir).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in near))) == sorted(map(str, [*rows[1:4], rows[7]]))
