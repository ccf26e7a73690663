"""Language-model scores against counts in plain Python, and the model as a distribution."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from framelight.llm import lm_scoring as M
from framelight.llm.common import crc_fold, read_table


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    count = Counter(t for r in train for t in tokens(r.text))
    total, types = sum(count.values()), len(count)
    got = {r.doc_id: r for r in M.lm_score(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(t), sum(count[x] > 0 for x in t), total)
        assert g.base_score == pytest.approx(sum(log10((count[x] + 1) / (total + types + 1)) for x in t), rel=1e-9)
        assert g.score <= 0
    held = [g for g in got.values() if g.held_out]
    return sum(g.score for g in held), sum(g.base_score for g in held)


def test_documents(spark, sf_dir):
    score, base = check(read_table(spark, sf_dir, "documents"))
    assert score > base


def test_odd_texts(spark):
    texts = [None, "", " ", "A a b", "a", "x" * 9000, "w " * 5000, "é ñ"] * 6
    check(spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, score double").repartition(3))
    assert M.lm_score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert M.lm_score(spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")).count() == 1


def test_probabilities_add_up(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", crc_fold("doc_id", 7).cast("int").alias("fold"))
    model = M.fit_lm(docs)
    v = model.vocabulary
    rare = v.tokens - v.counts.sum() - v.ends
    rare_types = v.types - len(v.counts) - 1
    seen = model.head[:, 1:].sum(1) + model.a * rare + model.b * (rare_types + 1)
    assert np.allclose(seen, 1, atol=1e-6)
    assert 0 < model.weights[0] < 1 and all((w >= 0).all() and (w < 1).all() for w in model.weights[1:])


def test_word_ngrams(spark):
    """Scores against word uni-, bi- and trigrams counted in plain Python; nearly all words here are rare."""
    texts = [f"w{i % 37} x{i % 5} y{i % 41} x{(i + 1) % 5} y{i % 41} w{i % 37} z{i}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    _, w2, w3 = (weights := M.fit_lm(docs.withColumn("fold", crc_fold("doc_id", 7).cast("int"))).weights)
    count, context = Counter(), Counter()
    for i, text in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            t = ["<s>", "<s>", *tokens(text)]
            for k in range(2, len(t)):
                for n in (1, 2, 3):
                    count[tuple(t[k - n + 1 : k + 1])] += 1
                    context[tuple(t[k - n + 1 : k])] += 1
    types = sum(len(g) == 1 for g in count)

    def p(gram):
        if not gram:
            return 1 / (types + 1)
        n = context[gram[:-1]]
        w = weights[0] if len(gram) == 1 else (0, w2, w3)[len(gram) - 1][1 + int(np.log2(n)) if n else 0]
        return w * count[gram] / max(n, 1) + (1 - w) * p(gram[1:])

    for r in M.lm_score(docs).collect():
        t = ["<s>", "<s>", *tokens(texts[r.doc_id])]
        assert r.score == pytest.approx(sum(log10(p(tuple(t[k - 2 : k + 1]))) for k in range(2, len(t))), rel=1e-9)
    assert w3[1:6].max() > 0.5
