"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_groups, materialise, shuffle_width

FAN_IN = 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, and what verifies equality beside it: length and a second hash of the normalised text."""
    norm = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    return docs.select(
        "doc_id",
        F.sha2(norm, 256).alias("text_sha256"),
        F.octet_length(norm).alias("norm_bytes"),
        F.xxhash64(norm).alias("norm_check"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
    )


KEYS = ["text_sha256", "norm_bytes", "norm_check"]


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with equal keys as one: the first of them, with the sum of their sizes (last column).

    The rows come sorted, of equal digests the best row first; a digest may go on in the next batch.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        first = np.ones(batch.num_rows, bool)
        first[1:] = False
        for i in range(len(KEYS)):
            column = batch.column(i)
            first[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        sizes = np.add.reduceat(batch.column(batch.num_columns - 1).to_numpy(), starts)
        merged = batch.take(pa.array(starts))
        merged = pa.RecordBatch.from_arrays([*merged.columns[:-1], pa.array(sizes)], schema=batch.schema)
        yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Tree-merge of sorted digest runs: text_sha256, norm_bytes, norm_check, keep_id, group_size.

    Every partition sorts its digests and merges equal ones: its run. Workers are numbered in base ``fan_in``; in round r those whose
    numbers differ in digit r alone exchange their runs, each row going to the worker whose digit r is the digest's own. A worker sorts
    the runs that it got and merges equal digests, so a digest has at most ``fan_in`` rows there, however many copies it has. Digests are
    merged only if length and second hash agree too; the longest original text with the smallest identifier is retained at every level.
    After the last round a worker's number depends on the digest alone, so each digest is one row.
    """
    spark = rows.sparkSession
    rounds, width = 1, fan_in
    while width < shuffle_width(spark):
        rounds, width = rounds + 1, width * fan_in

    def merged(runs: DataFrame) -> DataFrame:
        ordered = runs.sortWithinPartitions(*KEYS, F.col("chars").desc(), F.col("keep_id").asc_nulls_last())
        return ordered.mapInArrow(merge_sorted, ordered.schema)

    runs = merged(rows.select(*KEYS, F.col("doc_id").alias("keep_id"), "chars", F.pmod(F.spark_partition_id(), F.lit(width)).alias("node"), F.lit(1).cast("long").alias("group_size")))
    place = 1
    for _ in range(rounds):
        own = F.expr(f"int(pmod(norm_check div {place}, {fan_in}))")
        digit = F.expr(f"int(node div {place} % {fan_in})")
        runs = merged(runs.withColumn("node", F.col("node") + (own - digit) * place).repartitionById(width, "node"))
        place *= fan_in
    return runs.drop("node", "chars")


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. A null text counts as empty, so nulls, empty and blank
    texts are one group. Of equal texts the one with most code points, then with the smallest doc_id, stays; rows that
    repeat a doc_id with its text stay or go together. A null doc_id loses every tie. Other columns are not looked at.
    An empty table gives an empty result. Hot digests, a bounded number, are joined by broadcast.
    """
    rows = materialise(digests(docs))
    groups = materialise(merge_runs(rows, fan_in))
    joined = join_groups(rows, groups, KEYS, "group_size")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
