"""Pieces shared by the corpus operators: tables, the shared work folder, byte-level words and blob shuffles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
MAX_WORK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, folds: int):
    """crc32 of an id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % folds


def work_path(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; below the warehouse, which they share too, where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/framelight/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared work folder and reads it back: lineage ends there and survives lost executors.

    The shuffle files that led there are removed once the table is written, as nothing reads them again; else they would fill the disks
    until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(column: pa.Array, max_bytes: int = MAX_WORK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over whole rows of a text column, about ``max_bytes`` at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, rows = 0, len(column)
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(rows, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, MAX_WORK_BYTES + 4096)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (BASE, U64(pow(int(BASE), -1, 1 << 64))))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE^position modulo 2^64; entry i covers data[:i]."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of data[start:end], independent of the place."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes with in_word[byte]; runs never cross rows."""
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def blob_shuffle(df: DataFrame, width: int) -> DataFrame:
    """Rows (part int, payload binary) sent to the task ``part`` of ``width``: a shuffle of packed arrays, not of single entries."""
    return df.repartitionById(width, F.col("part"))


#: A key is hot when it has more than this share of the rows; fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with one row per key, where ``size`` is the key's number of rows.

    Hot keys, at most 1 / HOT_SHARE of them, are joined by broadcast, so none of them lands in one task; all others by a shuffle.
    """
    least = rows.count() * HOT_SHARE
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    rest = rows.join(F.broadcast(groups.filter(F.col(size) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        at = 0
        for cut in [*np.flatnonzero(change), batch.num_rows]:
            if cut in (0,) or change[at]:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if cut > at:
                held.append(batch.slice(at, cut - at))
            at = int(cut)
            if at == batch.num_rows:
                break
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected to by edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node, other node) that connect what the edges a-b connect; fewer than there are nodes."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = names[min_labels(len(names), at[: len(a)], at[len(a) :])]
    return low[low != names], names[low != names]


#: Edges that one task may join to components: 16 MB of packed pairs.
TASK_EDGES = 1_000_000


def components_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES edges, which travel as packed forests."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]) for batch in batches if batch.num_rows]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.stack(forest(*np.concatenate(pairs, 1))).tobytes()], pa.binary())], names=["part", "payload"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for batch in batches for x in batch.column(1)]
        if pairs:
            a, b = forest(*np.concatenate(pairs, 1))
            roots = np.unique(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b, roots])), pa.array(np.concatenate([a, roots]))], names=["node", "component"])

    return blob_shuffle(edges.select("a", "b").mapInArrow(pack, "part int, payload binary"), 1).mapInArrow(merge, "node bigint, component bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) is connected to.

    Alternating large and small stars: every round links each node's larger, then its smaller neighbours to its smallest one. The number
    of edges never grows, the number of rounds is logarithmic, and each step is written to the shared work folder. The centre of a large
    component is a key with a large share of the edges: such keys are joined by broadcast (``join_groups``). As soon as no more than TASK_EDGES
    edges are left, one task joins them.
    """

    def stars(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (u, v) with m, the smallest of u and its neighbours v; and one row (u, m, size) for each u."""
        least = materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size")))
        return join_groups(pairs, least, ["u"], "size"), least

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    seen = state(edges)
    while seen[0] > TASK_EDGES:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stars(both)[0].filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b")
        down, low = stars(materialise(large.distinct()).select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = down.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialise(small.filter("a < b").distinct())
        now = state(edges)
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen = now
    return materialise(components_in_one_task(edges))
