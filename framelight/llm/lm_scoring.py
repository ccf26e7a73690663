"""Language-model scoring by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, blob_shuffle, byte_words, crc_fold, materialise, mix, prefix_hash, shuffle_width, span_hash, text_slices

FOLDS, HELD_OUT = 7, 2
#: The fold of the training documents whose counts the mixture weights are fitted to.
TUNING_FOLD = 3
BUCKETS = 40
EM_ROUNDS = 30
#: Text whose different n-grams are counted together before they are dealt out; a longer text is a block alone.
BLOCK_BYTES = 1 << 23
#: Steps an octave to which the ratios of two estimates are rounded where the weights are learned.
STEPS = 64
U64 = np.uint64
END, START = U64(0x5EED0E2D), U64(0x57A27ED0)
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_ZSTD = pa.Codec("zstd", compression_level=3)
_BLOBS = "part int, key binary, kind int, payload binary"
#: Kinds of blobs: counts asked for or told, texts, totals, and what the tuning fold's tokens tell about the weights.
_COUNTS, _TEXTS, _TOTALS, _TUNING = range(4)


def _blobs(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
    part, key, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(key, pa.binary()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["part", "key", "kind", "payload"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: the upper bytes of small numbers take no room."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        packed = _ZSTD.compress(raw, asbytes=True) if raw else b""
        out += [np.array([len(raw), len(packed)], np.int64).tobytes(), packed]
    return b"".join(out)


def _unpack(payload: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size, packed = (int(x) for x in np.frombuffer(payload, np.int64, 2, at))
        raw = _ZSTD.decompress(payload[at + 16 : at + 16 + packed], size, asbytes=True) if size else b""
        at += 16 + packed
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(t).reshape(-1))
    return out


def _part(h: np.ndarray, width: int) -> np.ndarray:
    """Ranges of hashes, so that sorted hashes stay in order and lie close to each other."""
    return ((h >> U64(32)) * U64(width) >> U64(32)).astype(np.int64)


def token_slices(texts: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, row of each token): words with A-Z lower-cased, and one end after each row's words."""
    for a, b, data, offsets in text_slices(texts, max_bytes):
        low = LOWER[data]
        start, end, row = byte_words(low, offsets, NOT_SPACE)
        h = span_hash(prefix_hash(low), start, end)
        at = np.searchsorted(row, np.arange(b - a), side="right")
        yield a, b, np.insert(h, at, END), np.insert(row, at, np.arange(b - a))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row of each token, whether it is the row's first, and the hashes of the uni-, bi- and trigram that end in it; rows begin with two starts."""
    got = [(h, a + row) for a, _, h, row in token_slices(texts)]
    h, row = (np.concatenate(x) for x in zip(*got, strict=True))
    first = np.concatenate([[True], row[1:] != row[:-1]])
    grams = [h]
    for k in _MIX:
        before = np.concatenate([[START], grams[-1][:-1]])
        before[first] = START
        grams.append(mix(before * k + h))
    return row, first, grams


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, np.ndarray, int, int, pa.RecordBatch]]:
    """(key, texts, folds, first row, end row, batch) of blocks of rows (text, fold, ...). Blocks with equal keys have equal texts and folds, so equal counts."""
    for batch in batches:
        fold = np.asarray(batch.column(1).fill_null(-1), np.int64)
        for a, b, data, offsets in text_slices(batch.column(0), BLOCK_BYTES):
            texts = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            key = hashlib.blake2b(digest_size=16)
            for x in (np.ascontiguousarray(data), offsets, fold[a:b]):
                key.update(x.tobytes())
            yield key.digest(), texts, fold[a:b], a, b, batch


def count_grams(docs: DataFrame, width: int) -> DataFrame:
    """Blobs of every token's counts of its uni-, bi- and trigram in the training documents; of totals; and of the tuning fold's counts.

    Each block's different n-grams go by hash to the tasks that count them, and the counts come back to the block's texts. All n-grams are
    counted, as words are; an n-gram in all texts is one entry a block. ``docs``: text, fold, doc_id.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, fold, *_ in _blocks(batches):
            row, _, grams = _grams(texts)
            use = fold[row]
            train, tune = use != HELD_OUT, use == TUNING_FOLD
            orders = []
            for h in grams:
                names, at = np.unique(h, return_inverse=True)
                counts = [np.bincount(at[chosen], minlength=len(names)).astype(np.uint32) for chosen in (train, tune)]
                orders.append((names, counts, np.searchsorted(_part(names, width), np.arange(width + 1))))
            for p in range(width):
                parts = []
                for names, counts, cuts in orders:
                    part = slice(cuts[p], cuts[p + 1])
                    parts += [np.diff(names[part], prepend=U64(0)), *(c[part] for c in counts)]
                if any(len(x) for x in parts):
                    yield _blobs([(p, key, _COUNTS, _pack(*parts))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = list(_rows(batches))
        if not asked:
            return
        told: list[list[np.ndarray]] = [[] for _ in asked]
        for order in range(3):
            got = [_unpack(x[3], *("<u8", "<u4", "<u4") * 3)[3 * order : 3 * order + 3] for x in asked]
            names, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=U64) for x in got]), return_inverse=True)
            total, tune = (np.bincount(at, np.concatenate([x[i] for x in got]), len(names)).astype(np.int64) for i in (1, 2))
            if order == 0:
                end = names == END
                level, place = np.unique(_level(total - tune), return_inverse=True)
                totals = np.array([total.sum(), tune.sum(), (total > 0).sum(), total[end].sum(), tune[end].sum()], np.int64)
                yield _blobs([(asked[0][0], b"", _TOTALS, _pack(totals, level, np.bincount(place, tune, len(level)).astype(np.int64)))])
            begin = 0
            for out, x in zip(told, got, strict=True):
                mine = at[begin : begin + len(x[0])]
                begin += len(mine)
                out += [total[mine], tune[mine]]
        for (part, key, _, _), out in zip(asked, told, strict=True):
            yield _blobs([(int.from_bytes(key[:4], "little") % width, key, _COUNTS, np.int64(part).tobytes() + _pack(*out))])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, fold, a, b, batch in _blocks(batches):
            ids = batch.column(2).slice(a, b - a)
            offsets, data = (np.frombuffer(x, t) for x, t in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
            packed = _pack(data, np.diff(offsets), fold, np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.uint8))
            yield _blobs([(int.from_bytes(key[:4], "little") % width, key, _TEXTS, packed)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[bytes, dict[int, bytes]] = {}
        texts: dict[bytes, list[bytes]] = {}
        for _, key, kind, payload in _rows(batches):
            if kind == _TOTALS:
                yield _blobs([(0, b"", kind, payload)])
            elif kind == _COUNTS:
                told.setdefault(key, {})[int(np.frombuffer(payload, np.int64, 1)[0])] = payload[8:]
            else:
                texts.setdefault(key, []).append(payload)
        if told.keys() != texts.keys():
            raise ValueError("the documents came in other blocks when they were read again")
        for key, same in texts.items():
            got = [_unpack(x, *("<i8",) * 6) for _, x in sorted(told.pop(key).items())]
            for payload in same:
                data, sizes, fold, ids, null = _unpack(payload, "u1", "<i8", "<i8", "<i8", "u1")
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                row, first, grams = _grams(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
                tuning = fold[row] == TUNING_FOLD
                every, main = [], []
                for order, h in enumerate(grams):
                    at = np.unique(h, return_inverse=True)[1]
                    total, tune = (np.concatenate([x[2 * order + i] for x in got])[at] for i in (0, 1))
                    every.append(total)
                    main.append(total - tune)
                contexts = [np.where(first, -1, np.concatenate([[0], x[:-1]]))[tuning] for x in main[:2]]
                yield _blobs([(0, b"", _TEXTS, _pack(ids, null, fold, np.bincount(row, minlength=len(fold)), *every)), (0, b"", _TUNING, _pack(*(x[tuning] for x in main), *contexts))])

    told = materialise(blob_shuffle(docs.select("text", "fold").mapInArrow(ask, _BLOBS), width).mapInArrow(count, _BLOBS))
    texts = docs.select("text", "fold", F.col("doc_id").cast("long")).mapInArrow(texts_of, _BLOBS)
    return materialise(blob_shuffle(told.unionByName(texts), width).mapInArrow(meet, _BLOBS))


def _level(count: np.ndarray) -> np.ndarray:
    """Counts to three significant digits, so that there are few different ones."""
    digits = 10 ** np.maximum(0, np.floor(np.log10(np.maximum(count, 1))).astype(np.int64) - 2)
    return count // digits * digits


def _bucket(context: np.ndarray) -> np.ndarray:
    """Contexts by the power of two of their frequency; contexts never seen are bucket 0."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def em_weight(high: np.ndarray, low: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Mixture weights of the higher estimate for each bucket, by expectation-maximisation on held-out counts; 0 for contexts never seen."""
    weight = np.full(BUCKETS, 0.5)
    total = np.bincount(bucket, count, BUCKETS)
    for _ in range(EM_ROUNDS):
        p = weight[bucket] * high
        share = p / np.maximum(p + (1 - weight[bucket]) * low, 1e-300)
        weight = np.where(total > 0, np.bincount(bucket, count * share, BUCKETS) / np.maximum(total, 1e-300), weight)
    weight[0] = 0
    return np.clip(weight, 0, 0.999999)


@dataclass
class Vocabulary:
    """Totals over the training documents. No word but the end has a count of its own here: the counts stay distributed."""

    tokens: int
    types: int
    counts: np.ndarray
    ends: int


@dataclass
class Interpolated:
    """The mixture. A word counted n times has probability a * n + b without a context, the end head[0, 1]; bigrams and trigrams add to it by weight."""

    vocabulary: Vocabulary
    head: np.ndarray
    a: np.ndarray
    b: np.ndarray
    #: The share of unigram counts, and for each bucket of contexts those of bigrams and trigrams.
    weights: tuple[float, np.ndarray, np.ndarray]

    def mixed(self, counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Probabilities from the counts of uni-, bi- and trigram and of the contexts of the latter two, as far as given."""
        p = self.a[0] * counts[0] + self.b[0]
        for n, context, weight in zip(counts[1:], contexts, self.weights[1:], strict=False):
            w = weight[_bucket(context)]
            p = w * n / np.maximum(context, 1) + (1 - w) * p
        return p


def _learn(table: DataFrame, model: Interpolated, starts: int, order: int) -> np.ndarray:
    """Weights of the n-grams of ``order``, from distributed sums of the tuning fold's tokens by bucket and rounded ratio to the lower estimate."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, payload in _rows(batches):
            *counts, one, two = _unpack(payload, *("<i8",) * 5)
            contexts = [np.where(x < 0, starts, x) for x in (one, two)]
            low = model.mixed(counts[: order - 1], contexts)
            high = counts[order - 1] / np.maximum(contexts[order - 2], 1)
            ratio = np.where(high > 0, np.rint(STEPS * np.log2(np.maximum(high, 1e-300) / low)), -(1 << 20)).astype(np.int64)
            cells, n = np.unique(np.stack([_bucket(contexts[order - 2]), ratio]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(n)], names=["bucket", "ratio", "n"])

    sums = table.filter(F.col("kind") == _TUNING).mapInArrow(ratios, "bucket bigint, ratio bigint, n bigint").groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).toArrow()
    bucket, ratio, n = (np.asarray(sums.column(c), np.int64) for c in ("bucket", "ratio", "n"))
    return em_weight(np.exp2(ratio / STEPS), np.ones(len(n)), n.astype(np.float64), bucket)


def fit_model(table: DataFrame) -> Interpolated:
    """P3 = w3 ML3 + (1 - w3) P2, P2 = w2 ML2 + (1 - w2) P1, P1 = u ML1 + (1 - u) / (words + 1), all of words.

    The one more word stands for all words never seen. The weights u, w2 and w3, the latter by frequency bucket of the context, are learned
    with counts that leave the tuning fold out, from the events of that fold; the model then uses the counts of all training documents.
    """
    totals, levels = np.zeros(5, np.int64), {}
    for r in table.filter(F.col("kind") == _TOTALS).select("payload").toLocalIterator():
        own, level, n = _unpack(bytes(r.payload), *("<i8",) * 3)
        totals += own
        for k, x in zip(level.tolist(), n.tolist(), strict=True):
            levels[k] = levels.get(k, 0) + x
    tokens, tune, types, ends, tune_ends = (int(x) for x in totals)
    level, n = np.array(sorted((k, n) for k, n in levels.items() if n), np.float64).reshape(-1, 2).T
    u = float(em_weight(level / max(tokens - tune, 1), np.full(len(level), 1 / (types + 1)), n, np.ones(len(level), np.int64))[1]) if tokens else 0.0

    def model(tokens: int, *weights: np.ndarray) -> Interpolated:
        a, b = u / max(tokens, 1), (1 - u) / (types + 1)
        return Interpolated(Vocabulary(tokens, types, np.zeros(0, np.int64), ends), np.array([[0, a * ends + b]]), np.array([a]), np.array([b]), (u, *weights))

    w2 = _learn(table, model(tokens - tune), ends - tune_ends, 2)
    w3 = _learn(table, model(tokens - tune, w2), ends - tune_ends, 3)
    return model(tokens, w2, w3)


def score_texts(table: DataFrame, model: Interpolated) -> DataFrame:
    """Scores every row; see lm_score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.vocabulary
        for _, _, _, payload in _rows(batches):
            ids, null, fold, tokens, *counts = _unpack(payload, "<i8", "u1", *("<i8",) * 5)
            row = np.repeat(np.arange(len(ids)), tokens)
            first = np.concatenate([[True], row[1:] != row[:-1]])
            contexts = [np.where(first, v.ends, np.concatenate([[0], x[:-1]])) for x in counts[:2]]
            p = np.log10(np.maximum(model.mixed(counts, contexts), 1e-300))
            base = np.log10((counts[0] + 1) / (v.tokens + v.types + 1))
            known, base, p = (np.bincount(row, x, len(ids)) for x in (counts[0] > 0, base, p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(fold == HELD_OUT), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), v.tokens, np.int64)), pa.array(base), pa.array(p)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return table.filter(F.col("kind") == _TEXTS).mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def fit_lm(docs: DataFrame) -> Interpolated:
    """Learns the model from the training folds of ``docs`` (columns doc_id, text, fold)."""
    return fit_model(count_grams(docs, shuffle_width(docs.sparkSession)))


def lm_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are white-space words with A-Z lower-cased and one end; a null or empty text is the end alone. Counts are of all training
    documents; a null doc_id counts as a training document. base_score is the add-one unigram, score the interpolated model of word
    uni-, bi- and trigrams. Repeated rows count and are scored as often as they occur. An empty table gives no rows. Without training
    documents all words are unknown. ``docs`` is read twice and has to give the same rows in the same order each time, as a scan does.
    """
    folded = docs.select("doc_id", "text", crc_fold("doc_id", FOLDS).cast("int").alias("fold"))
    table = count_grams(folded, shuffle_width(docs.sparkSession))
    return score_texts(table, fit_model(table))
