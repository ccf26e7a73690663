"""Benchmark decontamination by an FM-index per training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_words, prefix_hash, span_hash, text_slices

WINDOW = 10
#: Words of benchmark text that one broadcast block of test phrases holds; larger benchmarks are searched block by block.
BLOCK_WORDS = 1_000_000
SAMPLE_EVERY = 8
#: Bytes of text that one FM-index covers, or one document if that is longer.
SHARD_BYTES = 2 << 20
IN_WORD = np.ones(256, bool)
IN_WORD[0x00:0x30] = False
IN_WORD[0x3A:0x61] = False
IN_WORD[0x7B:0x80] = False


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start, end, row, hash) of the words of each slice of a column."""
    for a, b, data, offsets in text_slices(column, SHARD_BYTES):
        low = LOWER[data]
        start, end, row = byte_words(low, offsets, IN_WORD)
        yield a, b, low, start, end, row, span_hash(prefix_hash(low), start, end)


class Wavelet:
    """A wavelet matrix over small integers: rank(symbol, i) for arrays of queries, one bit level after another."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FmIndex:
    """Full-text index of a sequence of small integers above 0; backward search, and location by sampled suffix positions."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = len(text) + 1
        text = np.concatenate([text, [0]]).astype(np.int64)
        order, rank = np.argsort(text, kind="stable"), None
        rank = np.zeros(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(text[order][1:] != text[order][:-1])])
        step = 1
        while rank[order[-1]] < n - 1:  # prefix doubling
            second = np.full(n, -1, np.int64)
            second[:-step] = rank[step:]
            key = rank * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            step *= 2
        bwt = text[order - 1]
        self.n, self.bwt = n, bwt
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = Wavelet(bwt, max(1, int(sigma).bit_length()))
        self.sampled = order % SAMPLE_EVERY == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, the rows of a matrix; all are searched at once, last symbol first."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to sampled ones."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.full(len(row), -1, np.int64)
        left = np.arange(len(row))
        while len(left):
            hit = self.sampled[row[left]]
            done = left[hit]
            out[done] = self.samples[self.sample_rank[row[done]]] + steps[done]
            left = left[~hit]
            c = self.bwt[row[left]]
            row[left] = self.first[c] + self.tree.rank(c, row[left])
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, by length, with the items that each window is of."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        hashes: list[int] = []
        for item, text in items:
            ids = []
            for _, _, data, start, end, _, h in words_of(pa.array([text or ""], pa.string())):
                for s, e, x in zip(start, end, h, strict=True):
                    word = data[s:e].tobytes()
                    if word not in vocabulary:
                        vocabulary[word] = len(vocabulary) + 1
                        hashes.append(int(x))
                    ids.append(vocabulary[word])
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.words = [b"", *vocabulary]
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.ids = np.array(hashes, np.uint64)[order], order + 1
        self.matrices = {n: np.array(list(w), np.int64) for n, w in by_length.items()}
        self.items = {n: [sorted(x) for x in w.values()] for n, w in by_length.items()}
        self.shortest = min(by_length, default=0)

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed words; 0 for words that no item has."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], 0)


def _search_shard(phrases: Phrases, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, h: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> None:
    """Marks hit words of a shard and adds the items found to each row's set.

    A phrase can only lie in a run of words that items have, within one row and as long as the shortest phrase: only such runs are indexed.
    """
    if not phrases.shortest or not len(h):
        return
    ids = phrases.encode(h)
    starts = np.flatnonzero((ids > 0) & np.concatenate([[True], (ids[:-1] == 0) | (row[1:] != row[:-1])]))
    stops = np.flatnonzero((ids > 0) & np.concatenate([(ids[1:] == 0) | (row[1:] != row[:-1]), [True]])) + 1
    keep = stops - starts >= phrases.shortest
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return
    sizes = stops - starts + 1  # a separator follows each run
    base = np.cumsum(sizes) - sizes
    separator = len(phrases.words)
    text = np.full(int(sizes.sum()), separator, np.int64)
    run = np.repeat(np.arange(len(starts)), sizes - 1)
    within = np.arange(len(run)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
    text[base[run] + within] = ids[starts[run] + within]
    index = FmIndex(text, separator)
    for n, matrix in phrases.matrices.items():
        lo, hi = index.search(matrix)
        which = np.repeat(np.arange(len(matrix)), hi - lo)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at = index.locate(rows)
        r = np.searchsorted(base, at, side="right") - 1
        word = starts[r] + at - base[r]
        for w, p in zip(word, which, strict=True):
            if all(data[start[w + i] : end[w + i]].tobytes() == phrases.words[c] for i, c in enumerate(matrix[p])):  # the hash is not trusted
                hit[w : w + n] = True
                items[row[w]].update(phrases.items[n][p])


def _benchmark_blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcast handles of blocks of items, each of at most about BLOCK_WORDS words; built one after another on the driver."""
    sc, held, size, out = benchmark.sparkSession.sparkContext, [], 0, []
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id").toLocalIterator():
        if item is None:
            continue
        held.append((item, text))
        size += len(text or "") // 2
        if size >= BLOCK_WORDS:
            out.append(sc.broadcast(Phrases(held, window)))
            held, size = [], 0
    return [*out, sc.broadcast(Phrases(held, window))] if held else out


_RESULT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,spans:array<struct<first_word:bigint,last_word:bigint>>,items:array<string>>"


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, column: str = "contamination") -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, n_items, items_sha256, merged spans of hit words, items.

    A shard is a batch of documents within one task: no exchange. Null texts have no words; items without words, or without an id,
    have no windows; an empty benchmark hits nothing; repeated items count once by id. Several windows over one word count once.
    """
    blocks = _benchmark_blocks(benchmark, window)

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts_ in texts:
            out: list[dict] = []
            for a, b, data, start, end, row, h in words_of(texts_):
                hit, items = np.zeros(len(h), bool), [set() for _ in range(b - a)]
                for block in blocks:
                    _search_shard(block.value, data, start, end, row, h, hit, items)
                    if len(blocks) > 1:
                        block._value = None  # one block in memory at a time
                        del block._value
                first = np.searchsorted(row, np.arange(b - a + 1))
                total = np.concatenate([[0], np.cumsum(hit)])
                for i in range(b - a):
                    lo, hi = first[i], first[i + 1]
                    spans = []
                    if n := int(total[hi] - total[lo]):
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8)))
                        spans = [{"first_word": int(x), "last_word": int(y) - 1} for x, y in edges.reshape(-1, 2)]
                    names = sorted(items[i])
                    out.append({"n_words": int(hi - lo), "n_hit": n, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "spans": spans, "items": names})
            yield pa.array(out, _ARROW)

    return docs.withColumn(column, F.arrow_udf(scan, _RESULT)("text"))


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))), ("items", pa.list_(pa.string()))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every row of ``docs``."""
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark, window, "c")
    return marked.select("doc_id", "c.n_words", "c.n_hit", "c.n_items", "c.items_sha256", (F.col("c.n_hit") > 0).alias("contaminated"), "c.spans")
