"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, text_slices

FOLDS, HELD_OUT = 4, 2
WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 256
#: At most so many documents of each language, by the order of a hash of their id, are learned from, whole; and none that takes their
#: sum beyond so many bytes.
DOCS_A_LANGUAGE, BYTES_A_LANGUAGE = 400, 1 << 21
EPOCHS, BATCH, STEP = 4, 64, 0.02
UNDETERMINED = "und"


@dataclass
class ByteCnn:
    """Filters over one-hot bytes (tables[width] is width x 256 x FILTERS), max pooling over a window, softmax over languages."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled activations of windows (n x LENGTH bytes) and, for each width, the positions they are from."""
        parts, places = [], []
        for width, table, bias in zip(WIDTHS, self.tables, self.biases, strict=True):
            y = table[0][x[:, : LENGTH - width + 1]]
            for k in range(1, width):
                y += table[k][x[:, k : LENGTH - width + 1 + k]]
            at = y.argmax(1)
            places.append(at)
            parts.append(np.maximum(np.take_along_axis(y, at[:, None], 1)[:, 0] + bias, 0))
        return np.concatenate(parts, 1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of every window; a narrower path than pooled(), without positions."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), 32):
            part, pools = x[a : a + 32], []
            for width, table, bias in zip(WIDTHS, self.tables, self.biases, strict=True):
                y = table[0][part[:, : LENGTH - width + 1]]
                for k in range(1, width):
                    y += table[k][part[:, k : LENGTH - width + 1 + k]]
                pools.append(np.maximum(y.max(1) + bias, 0))
            z = np.concatenate(pools, 1) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + 32] = z / z.sum(1, keepdims=True)
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all rows in windows of LENGTH, the last of a row filled up with 0; and each row's number of windows."""
    size = np.diff(offsets)
    count = -(-size // LENGTH)
    out = np.zeros(int(count.sum()) * LENGTH, np.uint8)
    first = (np.cumsum(count) - count) * LENGTH
    out[np.repeat(first - offsets[:-1], size) + np.arange(len(data))] = data
    return out.reshape(-1, LENGTH), count


def train(x: np.ndarray, y: np.ndarray, languages: list[str], weight: np.ndarray | None = None, seed: int = 7) -> ByteCnn:
    """Stochastic gradient descent with Adagrad steps on cross-entropy; gradients reach the filters through the pooled positions only.

    ``weight`` is that of each window among those of its language; all languages weigh the same.
    """
    rng = np.random.default_rng(seed)
    shape = [(w, 256, FILTERS) for w in WIDTHS]
    model = ByteCnn(languages, [rng.normal(0, 0.3, s).astype(np.float32) for s in shape], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if not len(x) or len(languages) < 2:
        return model
    weight = np.ones(len(y)) if weight is None else weight
    weight = (len(y) / (len(languages) * np.maximum(1e-9, np.bincount(y, weight, len(languages))))[y] * weight).astype(np.float32)
    held = [np.full_like(p, 1e-6) for p in (*model.tables, *model.biases, model.out, model.out_bias)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick = order[a : a + BATCH]
            xb, yb = x[pick], y[pick]
            pool, places = model.pooled(xb)
            z = pool @ model.out + model.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= weight[pick][:, None] / len(yb)
            back = (p @ model.out.T) * (pool > 0)
            grads = []
            for k, (width, at) in enumerate(zip(WIDTHS, places, strict=True)):
                g, part = np.zeros_like(model.tables[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                columns = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(width):
                    np.add.at(g[j], (np.take_along_axis(xb, at + j, 1), columns), part)
                grads.append(g)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [pool.T @ p, p.sum(0)]
            for value, h, g in zip((*model.tables, *model.biases, model.out, model.out_bias), held, grads, strict=True):
                h += g * g
                value -= (STEP * g / np.sqrt(h)).astype(np.float32)
    return model


def lowest_hashes(ids: DataFrame, count: int, size: int) -> DataFrame:
    """Of each language at most ``count`` ids (doc_id, lang, bytes), those with the lowest hashes, of no more than ``size`` bytes in sum.

    Rows are counted for each language first, and only those below a hash that about twice ``count`` rows of their language are below
    are moved to be ranked, so a common language brings no more rows into its task than a rare one. Rows of one id are one entry, made
    before anything is moved; ids of more than an eighth of ``size`` are passed over. What is looked up by broadcast is one row for each
    language.
    """
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    share = ids.groupBy("lang").agg((2.0 * count / F.count("*")).alias("share"))
    few = ids.withColumn("place", place).join(F.broadcast(share), "lang").filter("place <= share")
    few = few.groupBy("lang", "place", "doc_id").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= size // 8)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    ranked = few.withColumn("r", F.row_number().over(order)).withColumn("sum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("r") <= count) & (F.col("sum") <= size)).select("doc_id", "lang")


def fit_language(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, bytes_a_language: int = BYTES_A_LANGUAGE) -> ByteCnn:
    """Learns from documents with text and lang outside the held-out fold: a bounded number of each language, so that rare ones count.

    The ids are ranked first, without texts; the texts of the chosen few are looked up by broadcast of their ids. All windows of a
    chosen text are learned from; they share the weight of their document.
    """
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
    sized = usable.select("doc_id", "lang", F.octet_length("text").alias("bytes")).filter("bytes > 0")
    chosen = F.broadcast(lowest_hashes(sized, docs_a_language, bytes_a_language))
    got = usable.select("lang", "text", "doc_id").join(chosen, ["doc_id", "lang"]).select("lang", "text", "doc_id")
    got = got.toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    xs, ys, weights = [np.zeros((0, LENGTH), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b, data, offsets in text_slices(got.column("text")):
        x, count = windows(data, offsets)
        xs.append(x)
        ys.append(np.repeat([languages.index(n) for n in names[a:b]], count))
        weights.append(np.repeat(1 / np.maximum(count, 1), count))
    return train(np.concatenate(xs), np.concatenate(ys).astype(np.int64), languages, np.concatenate(weights))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_letter(raw: np.ndarray) -> bool:
    return bool(_LETTER[raw].any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace") if c > "\x7f")


def identify(docs: DataFrame, model: ByteCnn, column: str = "language") -> DataFrame:
    """``docs`` with a struct column lang_pred, score: mean log-probabilities over all windows of the whole text, as a distribution again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        names = np.array([*net.languages, UNDETERMINED], object)
        for texts_ in texts:
            which, score = np.full(len(texts_), len(net.languages)), np.zeros(len(texts_))
            for a, b, data, offsets in text_slices(texts_, 1 << 20):
                x, count = windows(data, offsets)
                if not len(x) or not net.languages:
                    continue
                logs = np.log(net.probabilities(x).astype(np.float64) + 1e-9)
                some = np.flatnonzero(count)
                mean = np.add.reduceat(logs, (np.cumsum(count) - count)[some], axis=0) / count[some][:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                letters = np.array([_has_letter(data[offsets[i] : offsets[i + 1]]) for i in some])
                which[a + some[letters]] = p[letters].argmax(1)
                score[a + some[letters]] = p[letters].max(1)
            yield pa.StructArray.from_arrays([pa.array(names[which], pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])

    return docs.withColumn(column, F.arrow_udf(predict, "struct<lang_pred:string,score:double>")("text"))


def language_id(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing can be learned. With one learned
    language every other text is of that. A null doc_id is of no fold: it is not held out, and not learned from. Repeated rows are judged
    alike; an empty table gives no rows; other columns are not looked at.
    """
    model = fit_language(docs.select("doc_id", "text", "lang"), docs_a_language)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
