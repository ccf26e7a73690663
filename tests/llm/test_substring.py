"""Substring removal against all windows of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framelight.llm import substring_dedup as S
from framelight.llm.common import read_table


def brute(rows, n=200):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest())
    return out


def got(docs, **more):
    rows = S.substring_dedup(docs, **more).collect()
    assert all(sum(s.high - s.low for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 260, 420, 900)]
    out = [None, "", "a" * 199, "a" * 200, "b" * 201, "b" * 450, "ab" * 300, "xyz" * 90, passages[4], passages[4]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 60) if rng.random() < 0.5 else 0
            parts += [text(rng.randint(0, 150)), p[a:] if rng.random() < 0.8 else p[:-a or None]]
        out.append("".join(parts))
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "group_rows", "bits"), [(1, 50_000, 64), (2, 50_000, 64), (3, 5, 64), (4, 5, 2), (5, 2, 0)])
def test_all_windows(spark, seed, group_rows, bits):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_removed int").repartition(3)
    assert got(docs, group_rows=group_rows, hash_bits=bits) == brute(rows)


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffix_sort_even_if_hashes_collide():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    group = np.sort(np.array([rng.randrange(9) for _ in parts]))
    first = np.searchsorted(group, group)
    size = np.bincount(group)[group]
    for broken in (False, True):
        strings = S.Strings(parts)
        if broken:
            strings.prefix = np.zeros_like(strings.prefix)
        order = S.suffix_sort(strings, first, size)
        assert [parts[i] for i in order] == [p for g in range(9) for p in sorted(parts[i] for i in np.flatnonzero(group == g))]
        assert strings.exact == broken
