"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically from shallow trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, text_slices

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: At most so many labelled rows are learned from, by the order of a hash of their id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 60, 30, 0.12, 4
_LINE = re.compile(r"[^\n]+")

#: Bytes whose share of the text is a feature each, and the features that follow them.
MARKS = "!|#$%&*+.,:;?-_/=<>@\"'()[]{}\n"
FEATURES = [f"share of {m!r}" for m in MARKS] + [
    "log bytes", "upper", "lower", "digits", "spaces", "other ascii", "not ascii", "log words", "word length", "distinct words", "distinct pairs",
    "longest word", "distinct lines", "line length", "share of the commonest word", "words ending in a mark", "letters a word", "byte entropy",
]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for every whole text; null and empty texts give zeros."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    marks = np.frombuffer(MARKS.encode(), np.uint8)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        count = np.bincount(raw, minlength=256).astype(np.float64)
        n = len(raw)
        share = count / n
        words = text.split()
        m = max(1, len(words))
        lines = text.split("\n")
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        upper, lower, digits = share[65:91].sum(), share[97:123].sum(), share[48:58].sum()
        spaces = share[[32, 9, 10, 11, 12, 13]].sum()
        positive = share[share > 0]
        k = len(marks)
        out[i, :k] = share[marks]
        out[i, k:] = (
            np.log1p(n), upper, lower, digits, spaces, max(0.0, share[:128].sum() - upper - lower - digits - spaces), share[128:].sum(), np.log1p(len(words)), n / m,
            len(seen) / m, pairs, max(map(len, words), default=0), len(set(lines)) / len(lines), n / len(lines), max(seen.values(), default=0) / m,
            sum(not w[-1].isalnum() for w in words) / m, (upper + lower + share[128:].sum()) * n / m, -(positive * np.log2(positive)).sum(),
        )
    return out


@dataclass
class Gam2:
    """Lookup tables: score = sigmoid(bias + sum of a bin value for each feature and for each chosen pair of features)."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        coarse = [np.searchsorted(cut, x[:, j], side="right") for j, cut in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree over ordered bins, grown best split first; returns the value of each bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        s = np.arange(a + 1, b)
        gain = gain_of(a, s) + gain_of(s, b) - gain_of(a, b)
        k = int(gain.argmax())
        return float(gain[k]), int(s[k])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, s = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(a, s, *best(a, s)), (s, b, *best(s, b))]
    out = np.zeros(len(grad))
    for a, b, *_ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of depth two over a grid: one cut of the first feature and, on either side, one of the second."""
    n, m = grad.shape
    best, out = 0.0, np.zeros((n, m))
    for flip in (False, True):
        G, H = (grad.T, hess.T) if flip else (grad, hess)
        cg, ch = np.cumsum(np.cumsum(G, 0), 1), np.cumsum(np.cumsum(H, 0), 1)
        for r in range(1, len(G)):
            value = np.zeros_like(G)
            gain = 0.0
            for lo, hi in ((0, r), (r, len(G))):
                g = cg[hi - 1] - (cg[lo - 1] if lo else 0)
                h = ch[hi - 1] - (ch[lo - 1] if lo else 0)
                left = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
                k = int(left.argmax())
                gain += float(left[k])
                value[lo:hi, : k + 1] = g[k] / (h[k] + 1)
                value[lo:hi, k + 1 :] = (g[-1] - g[k]) / (h[-1] - h[k] + 1)
            if gain > best:
                best, out = gain, value.T.copy() if flip else value.copy()
    return out


def train(x: np.ndarray, y: np.ndarray) -> Gam2:
    """Cyclic boosting of logistic loss: every round visits each feature once, then pairs are boosted on what is left."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam2(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    width = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(width)]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            if len(model.cuts[j]) == 0:
                continue
            g, h = gradient()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(fine[j], g, n), np.bincount(fine[j], h, n), LEAVES)
            model.tables[j] += step
            total += step[fine[j]]
    g, h = gradient()
    shape = [len(c) + 1 for c in model.pair_cuts]
    ranked = []
    for a in range(width):
        for b in range(a + 1, width):
            if shape[a] > 1 and shape[b] > 1:
                cell = coarse[a] * shape[b] + coarse[b]
                G, H = np.bincount(cell, g, shape[a] * shape[b]), np.bincount(cell, h, shape[a] * shape[b])
                ranked.append((float((G**2 / (H + 1)).sum()) / (shape[a] * shape[b]) ** 0.5, a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradient()
            cell = coarse[a] * shape[b] + coarse[b]
            size = shape[a] * shape[b]
            step = RATE * _tree2(np.bincount(cell, g, size).reshape(shape[a], shape[b]), np.bincount(cell, h, size).reshape(shape[a], shape[b]))
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def _features_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        x = features(column.to_pylist())
        flat = pa.array(x.ravel(), pa.float32())
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam2:
    """Learns from documents with a quality label outside the held-out fold.

    Null labels are ignored; of several labels of one id the highest counts. At most ``sample_rows`` labelled ids, by the order
    of a hash, are looked up (by broadcast, their number being bounded) and only their features reach the driver.
    """
    chosen = (
        labels.filter("quality is not null and doc_id is not null").filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    column = F.arrow_udf(_features_column, "array<float>")
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", column("text").alias("x")).toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return train(x.astype(np.float64), np.asarray(got.column("quality")).astype(np.float64))


def score_quality(docs: DataFrame, model: Gam2, column: str = "score") -> DataFrame:
    """``docs`` with the model's probability of quality 1 added as ``column``; null and empty texts are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts_ in texts:
            out = np.zeros(len(texts_))
            for a, b, _, _ in text_slices(texts_, 4 << 20):
                out[a:b] = shared.value.score(features(texts_.slice(a, b - a).to_pylist()).astype(np.float64))
            yield pa.array(out)

    return docs.withColumn(column, F.arrow_udf(score, "double")("text"))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (row for row; repeated rows score alike; an empty table gives no rows).

    Only the text is an input of the score. Without usable labels every text gets the prior.
    """
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
