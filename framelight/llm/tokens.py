"""Token ids by public tokenizers, flat token files and the counts of their documents."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_path

#: Entries that a worker's cache of words holds before it starts anew.
CACHE_WORDS = 500_000
#: The same for its cache of pieces, which most new words are made of.
CACHE_PIECES = 250_000
#: str.split takes these for white space, the tokenizer's pattern does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: Words of printable ASCII and Latin-1 letters: their pieces by the tokenizer's pattern, after lower-casing, need no Unicode tables.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: The short way through plain words holds for this normaliser alone; with any other, every word takes the tokenizer's own way.
_NORMALIZER = r'''{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\s+"},"content":" "},{"type":"Lowercase"}]}'''


class _Cache(dict):
    """A dict of at most ``size`` entries that computes what it lacks."""

    def __init__(self, compute: Callable[[str], bytes], size: int) -> None:
        self.compute, self.size = compute, size

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a tokenizer whose pieces never cross white space.

    Words are encoded once and then looked up; the ids equal those of the whole text, which tests check.
    """

    def __init__(self, path: str | None = None, special_as_text: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; its threads would only wait for each other
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model.encode_special_tokens = special_as_text
        self.merges = self.model.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the byte-level alphabet
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.pieces = _Cache(self._piece_ids, CACHE_PIECES)
        plain = json.loads(self.model.to_str())["normalizer"] == json.loads(_NORMALIZER)
        self.words = _Cache(self._plain_ids if plain else self._whole_ids, CACHE_WORDS)

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of one lower-case piece, by the merge table."""
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def _plain_ids(self, word: str) -> bytes:
        """Ids of a word; if it is plain, its pieces go to the merge table directly."""
        if word.isalpha() and word.isascii():
            return self.pieces[word.lower()]
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._whole_ids(word)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def _whole_ids(self, text: str) -> bytes:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, _ODD)):
            return self._whole_ids(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_encoder(path: str | None = None) -> WordEncoder:
    """The encoder of this process: tasks that a worker runs one after another share its caches."""
    return WordEncoder(path)


END_ID, WIDTH = 2, 2
BLOCK_TOKENS = 1 << 19
#: Rows of one flat file at most, so that a file stays far below what one row may hold.
FILE_ROWS = 5_000


def write_flat(docs: DataFrame, path: str, end_id: int = END_ID) -> None:
    """Writes documents as flat files of little-endian 16-bit ids, ``end_id`` after each document and nothing else.

    Ids are those of the public 32k piece vocabulary, in which ``end_id`` marks an end and is never the id of a text. The text writer
    puts them out as they are, with the end id as its line separator, so any store that Spark writes to will do.
    """

    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        for column in texts:
            out = []
            for a in range(0, len(column), 256):
                out += [np.array(x, "<u2").tobytes() for x in model.encode([t or "" for t in column.slice(a, 256).to_pylist()], num_threads=1)]
            yield pa.array(out, pa.binary())

    body = docs.select(F.arrow_udf(ids, "binary")("text").cast("string").alias("value"))
    body.write.option("lineSep", end_id.to_bytes(WIDTH, "little").decode("latin-1")).option("maxRecordsPerFile", FILE_ROWS).text(path)


def read_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, data) of at most ``block_tokens`` ids of every flat file below ``path``."""
    size = block_tokens * WIDTH
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length", "content")
    last = F.expr(f"greatest(cast(0 as bigint), (length - 1) div {size})")
    return files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "content").select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("data"))


def separator_scan(blocks: DataFrame, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of the documents of flat, unindexed token files: file, document (from 0), start, n_tokens (without the end id), complete.

    Every block is searched for the end id by one vectorised comparison. A block tells only where its ends are, how many they are and
    where the last one is; a prefix scan over a file's blocks (a running sum and a running maximum of those few numbers) then gives every
    block the number of documents and the last end before it, which stitches documents that reach over any number of blocks. Ids after
    the last end are a document with complete = false. Empty files give no rows; two ends in a row are a document of 0 ids.
    """
    name = "file string, block bigint, ends array<bigint>, size bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u2") if data.as_py() else np.zeros(0, "<u2")
                ends.append(np.flatnonzero(ids == end_id) + block * block_tokens)
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["file", "block", "ends", "size"])

    found = blocks.select("file", "block", "data").mapInArrow(search, name)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("file")
    stitched = found.select(
        "file", "ends", "size", "block",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last_before"),
        F.sum(F.size("ends")).over(file).alias("docs"), F.sum("size").over(file).alias("ids"), F.max(F.try_element_at("ends", F.lit(-1))).over(file).alias("last"), F.max("block").over(file).alias("last_block"),
    )
    closed = stitched.select("file", "docs_before", "last_before", F.col("ends"), F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("docs_before") + F.col("i")).alias("document"), (F.when(F.col("i") == 0, F.col("last_before")).otherwise(F.expr("try_element_at(ends, i)")) + 1).alias("start"), "end", F.lit(True).alias("complete")
    )
    cut_off = stitched.filter("block = last_block and ids > coalesce(last, -1) + 1").select("file", F.col("docs").alias("document"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), F.col("ids").alias("end"), F.lit(False).alias("complete"))
    return closed.unionByName(cut_off).select("file", "document", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "complete")


def token_counts(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes ``docs`` as flat token files in the work folder and counts them again from the files alone: one row per document.

    A null text counts as empty; an empty table gives no rows; other columns are not looked at.
    """
    path = work_path(docs.sparkSession)
    write_flat(docs, path)
    return separator_scan(read_blocks(docs.sparkSession, path, block_tokens), block_tokens=block_tokens)
