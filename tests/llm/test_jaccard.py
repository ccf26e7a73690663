"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from framelight.llm import common
from framelight.llm import ngram_jaccard as J
from framelight.llm.common import connected_components, read_table


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), links[i]) for i in sets}


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], ["new%d" % rng.randrange(9999)], [w[k], "more"]))
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = [None, "", " \t", "one two", "One two", "a b c", "a b c d", "a  b c\nd", "x " * 50, "x " * 51]
    common = [rng.choice(vocabulary) for _ in range(60)]
    for n in (8, 12, 25, 60, 150, 400):
        texts += family(rng, [rng.choice(vocabulary) for _ in range(n)], 25, max(1, n // 20))
        texts += [" ".join([rng.choice(vocabulary) for _ in range(n)] + common) for _ in range(15)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent", "queries"), [(4, 85, 512), (5, 80, 512), (4, 85, 10), (5, 80, 7)])
def test_all_pairs(spark, monkeypatch, words, percent, queries):
    monkeypatch.setattr(J, "QUERIES", queries)
    monkeypatch.setattr(J, "HOT", queries)
    rows = corpus(words)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.ngram_jaccard(docs, words, percent, count_links=True).collect()}
    assert got == brute(rows, words, percent)
    plain = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard(docs, words, percent).collect()}
    assert plain == {i: x[:2] for i, x in got.items()}


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard(docs, 4, 85).collect()}
    assert got == {i: x[:2] for i, x in brute(rows, 4, 85).items()}


def test_empty(spark):
    assert J.ngram_jaccard(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(4000):
        n = int(rng.integers(4, 120))
        base = rng.integers(0, 1 << 63, n + 40).astype(np.uint64)
        cut, more = int(rng.integers(0, 1 + n // 5)), int(rng.integers(0, 1 + n // 5))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n : n + more]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and both < len(np.union1d(a, b)):
            tried += 1
            left, right = ({k: (need, set(x.tolist())) for k, need, x in J.signatures(s, percent)} for s in (a, b))
            assert any(len(left[k][1] & right[k][1]) >= min(left[k][0], right[k][0]) for k in left.keys() & right.keys())
    assert tried > 300


@pytest.mark.parametrize("task_edges", [100, 1_000_000])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: label[x] for x in touched}


def test_null_and_repeated_ids(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    rows = [(7, text), (7, near), (7, "quite another text of seven words"), (None, near + " x"), (None, "alone among all the rows here"), (None, "alone among all the rows here"), (3, None), (None, None)]
    got = sorted(J.ngram_jaccard(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80, count_links=True).collect(), key=str)
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id) == [(3, 3, 0), (7, 7, 0), (7, 7, 2), (7, 7, 2)]
    assert sorted((str(r.component_id), r.n_links) for r in got if r.doc_id is None) == [("7", 2), ("None", 0), ("None", 1), ("None", 1)]


def test_chained_family(spark, monkeypatch):
    """5,000 texts, each linked with its neighbours only, and a passage that all share: one component, and few texts shipped."""
    shipped = []
    compare = J.compare

    def counted(units, *a, **b):
        shipped.append(units.count())
        return compare(units, *a, **b)

    monkeypatch.setattr(J, "compare", counted)
    n, long = 5000, 100
    rows = [(i, " ".join(["s%d" % j for j in range(20)] + ["c%d" % (2 * i + j) for j in range(long)])) for i in range(n)]
    got = J.ngram_jaccard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 5, 80)
    assert [tuple(r) for r in got.select("component_id").distinct().collect()] == [(0,)]
    assert sum(shipped) < 20 * n
