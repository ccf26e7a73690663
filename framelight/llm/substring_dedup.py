"""Removal of repeated substrings by hash-compared suffix sorts around content-chosen anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import POWERS, blob_shuffle, join_groups, materialise, mix, prefix_hash, shuffle_width, sorted_runs, work_path

LENGTH, GRAM = 200, 32
#: Occurrences of one anchor that a task sorts; the windows of commoner anchors are counted one by one, wherever they are, and compared.
GROUP_ROWS = 50_000
BATCH_ROWS = 30_000
U64 = np.uint64


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last window, and hash of the anchor's gram, over a text of at least ``length`` bytes.

    A window is ``length`` bytes; its anchor is the position in it of the gram with the least hash, the first of equal ones. Equal windows
    have their anchors at equal offsets, so a repeated window is found among the occurrences of its anchor's gram.
    """
    n, width = len(data), length - gram + 1
    prefix = prefix_hash(data)
    _, down = POWERS.upto(n + 1)
    at = np.arange(n - gram + 1)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    key = (h & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    best = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    place = best[first].astype(np.int64)
    return place, first, np.append(first[1:], windows) - 1, h[place]


class Strings:
    """Strings in one buffer, compared by prefix hashes: the common extension is found by binary search, and verified byte by byte."""

    def __init__(self, parts: list[bytes]) -> None:
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = prefix_hash(self.data)
        _, self.down = POWERS.upto(len(self.data) + 1)
        self.exact = False

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b."""
        i, j = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        if self.exact:
            return self._extension_by_bytes(i, j, hi)
        pi, pj, di, dj = self.prefix[i], self.prefix[j], self.down[i], self.down[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[i + mid] - pi) * di == (self.prefix[j + mid] - pj) * dj
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _extension_by_bytes(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        out, live, t = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(live):
            live = live[most[live] > t]
            live = live[self.data[i[live] + t] == self.data[j[live] + t]]
            t += 1
            out[live] = t
        return out

    def verify(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
        """Whether the claimed common prefixes are common; if not, bytes decide from now on."""
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        if not (self.data[np.repeat(self.start[a], length) + step] == self.data[np.repeat(self.start[b], length) + step]).all():
            self.exact = True
        return not self.exact

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        t = self.extension(a, b)
        end_a, end_b = t == self.size[a], t == self.size[b]
        if not len(self.data):
            return or_equal
        last = len(self.data) - 1
        less = self.data[np.minimum(self.start[a] + t, last)] < self.data[np.minimum(self.start[b] + t, last)]
        return np.where(end_a & end_b, or_equal, np.where(end_a, True, np.where(end_b, False, less)))


def suffix_sort(strings: Strings, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Merge sort of the strings of every group (``first`` and ``size`` are each string's group's); groups stay in place.

    All groups are sorted at once. Runs double in every round; each string finds its rank in the neighbouring run by binary search, and
    every comparison takes a logarithmic number of hash comparisons. Sorted again by bytes if a hash was found to collide.
    """
    while True:
        order = np.arange(len(size))
        width = 1
        while len(size) and width < size.max():
            live = np.flatnonzero(size > width)
            base = first[live]
            r = live - base
            run = r // width
            other = (run ^ 1) * width
            lo, hi = np.minimum(other, size[live]), np.minimum(other + width, size[live])
            low = lo.copy()
            odd = run % 2 == 1
            while (lo < hi).any():
                todo = np.flatnonzero(lo < hi)
                mid = (lo[todo] + hi[todo]) >> 1
                # strings of the left run go before equal ones of the right run
                smaller = strings.before(order[base[todo] + mid], order[live[todo]], odd[todo])
                lo[todo] = np.where(smaller, mid + 1, lo[todo])
                hi[todo] = np.where(smaller, hi[todo], mid)
            new = order.copy()
            new[base + (run // 2) * 2 * width + (r - run * width) + (lo - low)] = order[live]
            order, width = new, width * 2
        a, b = order[:-1], order[1:]
        same = first[a] == first[b] if len(a) else np.zeros(0, bool)
        if strings.exact or strings.verify(a[same], b[same], strings.extension(a[same], b[same])):
            return order


def repeated_spans(contexts: list[bytes], place: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, bytes before the anchor, bytes from it) of spans of at least ``length`` bytes that another member of the group has too.

    ``place`` is the anchor's place in each context; members of a group are consecutive. Members are sorted by what follows the anchor and by
    what precedes it, reversed. For every length r at which members of a group agree to the right, taken from the longest down, the
    clusters that agree so far are put in the order to the left, where the neighbour has the longest common extension: no pair is missed
    and pairs are not enumerated.
    """
    n = len(contexts)
    right = Strings([c[p:] for c, p in zip(contexts, place, strict=True)])
    left = Strings([c[:p][::-1] for c, p in zip(contexts, place, strict=True)])
    new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    size = np.bincount(first, minlength=n)[first] if n else np.zeros(0, np.int64)
    by_right, by_left = suffix_sort(right, first, size), suffix_sort(left, first, size)
    left_rank = np.empty(n, np.int64)
    left_rank[by_left] = np.arange(n)
    agree = np.full(n, -1, np.int64)  # with the next in order
    inner = np.flatnonzero(first[:-1] == first[1:]) if n else np.zeros(0, np.int64)
    agree[inner] = right.extension(by_right[inner], by_right[inner + 1])
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1 if n else np.zeros(0, np.int64)
    level = np.full(len(starts), 1 << 40, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while n:
        below = np.where(agree < level[of], agree, -1)
        level = np.maximum.reduceat(below, starts)
        if (level < 0).all():
            break
        tied = (agree >= level[of]) & (level[of] >= 0)
        member = tied | np.concatenate([[False], tied[:-1]])
        cluster = np.cumsum(np.concatenate([[True], ~tied[:-1]]))
        x = np.flatnonzero(member)
        x = x[np.lexsort((left_rank[by_right[x]], cluster[x]))]
        who = by_right[x]
        pair = np.flatnonzero(cluster[x[:-1]] == cluster[x[1:]])
        common = left.extension(who[pair], who[pair + 1])
        best = np.full(len(x), -1, np.int64)
        np.maximum.at(best, pair, common)
        np.maximum.at(best, pair + 1, common)
        r = level[of[x]]
        good = (best >= 0) & (best + r >= length)
        found.append((who[good], best[good], r[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_ANCHOR = np.dtype([("h", "<u4"), ("place", "<u4"), ("back", "<u1"), ("more", "<u1"), ("text", "<u2")])


def shared_anchors(texts: DataFrame, width: int) -> DataFrame:
    """(t, gid, members, place, first, last) of the anchors whose gram occurs more than once; texts are (t, text), all different."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                ids = np.asarray(part.column(0))
                held, to = [], []
                for i, text in enumerate(part.column(1)):
                    place, first, last, h = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                    record = np.zeros(len(place), _ANCHOR)
                    record["h"], record["place"], record["back"], record["more"], record["text"] = h & U64(0xFFFFFFFF), place, place - first, last - first, i
                    held.append(record)
                    to.append(((h >> U64(32)) % U64(width)).astype(np.int64))
                if not held:
                    continue
                record, to_ = np.concatenate(held), np.concatenate(to)
                order = np.argsort(to_, kind="stable")
                record, cuts = record[order], np.searchsorted(to_[order], np.arange(width + 1))
                parts, blobs = [], []
                for p in range(width):
                    mine = record[cuts[p] : cuts[p + 1]]
                    if len(mine):
                        there, local = np.unique(mine["text"], return_inverse=True)
                        mine = mine.copy()
                        mine["text"] = local
                        parts.append(p)
                        blobs.append(np.int64(len(there)).tobytes() + ids[there].tobytes() + mine.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "payload"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        records, texts_ = [], []
        for batch in batches:
            for x in batch.column(1):
                raw = x.as_buffer()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                r = np.frombuffer(raw, _ANCHOR, offset=8 + 8 * n)
                records.append(r)
                texts_.append(np.frombuffer(raw, np.int64, n, 8)[r["text"]])
        if not records:
            return
        record, text = np.concatenate(records), np.concatenate(texts_)
        order = np.argsort(record["h"], kind="stable")
        record, text = record[order], text[order]
        new = np.concatenate([[True], record["h"][1:] != record["h"][:-1]])
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        keep = np.flatnonzero(count > 1)
        gid = (np.int64(TaskContext.get().partitionId()) << 40) + group
        for a in range(0, len(keep), 100_000):
            k = keep[a : a + 100_000]
            first = record["place"][k].astype(np.int64) - record["back"][k]
            columns = [text[k], gid[k], count[k].astype(np.int64), record["place"][k].astype(np.int64), first, first + record["more"][k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "gid", "members", "place", "first", "last"])

    blobs = texts.select("t", "text").mapInArrow(emit, "part int, payload binary")
    return blob_shuffle(blobs, width).mapInArrow(gather, "t bigint, gid bigint, members bigint, place bigint, first bigint, last bigint")


_SPANS = "t bigint, low bigint, high bigint"


def sorted_group_spans(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Repeated spans found by sorting the contexts of each anchor's occurrences."""
    lists = shared.groupBy("t").agg(F.collect_list(F.struct("gid", "place", "first", "last")).alias("at"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes()
                at = batch.column(2)[i].values
                gid, place, first, last = (at.field(k) for k in range(4))
                lo, hi = np.asarray(first), np.asarray(last) + LENGTH
                cut = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([gid, pa.array(np.full(len(lo), batch.column(0)[i].as_py())), place, first, cut], names=["gid", "t", "place", "first", "context"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for table in sorted_runs(batches, 1):
            held.append(table)
            rows += table.num_rows
            if rows >= BATCH_ROWS:
                yield of(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield of(pa.concat_tables(held))

    def of(table: pa.Table) -> pa.RecordBatch:
        gid, t, place, first = (np.asarray(table.column(i)) for i in range(4))
        who, before, after = repeated_spans(table.column(4).to_pylist(), place - first, gid)
        return pa.RecordBatch.from_arrays([pa.array(t[who]), pa.array(place[who] - before), pa.array(place[who] + after)], names=["t", "low", "high"])

    cut = texts.join(lists, "t").select("t", F.col("text").cast("binary"), "at").mapInArrow(contexts, "gid bigint, t bigint, place bigint, first bigint, context binary")
    return cut.repartition("gid").sortWithinPartitions("gid").mapInArrow(spans, _SPANS)


def counted_window_spans(texts: DataFrame, shared: DataFrame, hash_bits: int = 64) -> DataFrame:
    """The same for anchors with very many occurrences, whose groups are too large to sort: windows meet by hash, and are compared byte by byte.

    Each window is hashed and counted across all tasks; equal hashes take the least window (text, place) as their example. Neighbouring
    windows whose examples are neighbours too make one run, and each run is compared with its example's bytes. Windows that differ from their
    example (a collision) are counted by their bytes. Common windows and examples are joined by broadcast, so none meets in one task.
    """
    mask = np.int64(-1 if hash_bits == 64 else (1 << hash_bits) - 1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                at = batch.column(2)[i].values
                gid, place, first, last = (np.asarray(at.field(k)) for k in range(4))
                n = last - first + 1
                low = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                prefix = prefix_hash(data)
                _, down = POWERS.upto(len(data) + 1)
                h = mix((prefix[low + LENGTH] - prefix[low]) * down[low]).view(np.int64) & mask
                columns = [np.repeat(gid, n), np.repeat(place, n) - low, h, np.full(len(low), batch.column(0)[i].as_py()), low]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gid", "offset", "h", "t", "low"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view, asked = batch.column(1)[i].as_buffer().to_pybytes(), batch.column(2)[i].values
                low, size, n = (np.asarray(asked.field(k)) for k in range(3))
                cut = pa.array([view[a : a + b] for a, b in zip(low.tolist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), batch.column(0)[i].as_py())), low, size, n, cut], names=["rt", "rlow", "size", "n", "piece"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, data, runs = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8), batch.column(2)[i].values
                out: list[tuple[int, int, int, bytes | None]] = []
                low, rt, rlow = (np.asarray(runs.field(k)).tolist() for k in range(3))
                for a, other, b, piece in zip(low, rt, rlow, runs.field(3), strict=True):
                    there = np.frombuffer(piece.as_buffer(), np.uint8)
                    here = data[a : a + len(there)]
                    if np.array_equal(here, there):
                        out += [(t, a, a + len(there), None), (other, b, b + len(there), None)]
                        continue
                    wrong = np.concatenate([[0], np.cumsum(here != there)])
                    for k, equal in enumerate((wrong[LENGTH:] == wrong[:-LENGTH]).tolist()):
                        if equal:
                            out += [(t, a + k, a + k + LENGTH, None), (other, b + k, b + k + LENGTH, None)]
                        else:
                            out.append((t, a + k, a + k + LENGTH, here[k : k + LENGTH].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["t", "low", "high", "odd"])

    lists = shared.groupBy("t").agg(F.collect_list(F.struct("gid", "place", "first", "last")).alias("at"))
    binary = F.col("text").cast("binary").alias("text")
    cut = materialise(texts.join(lists, "t").select("t", binary, "at").mapInArrow(windows, "gid bigint, offset bigint, h bigint, t bigint, low bigint"))
    keys = ["gid", "offset", "h"]
    example = cut.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("t", "low")).alias("e")).filter("n > 1")
    example = materialise(example.select(*keys, "n", F.col("e.t").alias("rt"), F.col("e.low").alias("rlow")))
    met = join_groups(cut, example, keys, "n").filter("t <> rt or low <> rlow").select("t", "low", "rt", (F.col("low") - F.col("rlow")).alias("by"))
    run = F.col("low") - F.row_number().over(Window.partitionBy("t", "rt", "by").orderBy("low"))
    runs = met.withColumn("run", run).groupBy("t", "rt", "by", "run").agg(F.min("low").alias("low"), (F.max("low") - F.min("low") + LENGTH).alias("size"))
    runs = materialise(runs.select("t", "low", "rt", (F.col("low") - F.col("by")).alias("rlow"), "size"))
    parts = ["rt", "rlow", "size"]
    asked = runs.groupBy(*parts).agg(F.count("*").alias("n")).groupBy(F.col("rt").alias("t")).agg(F.collect_list(F.struct("rlow", "size", "n")).alias("asked"))
    found = materialise(texts.join(asked, "t").select("t", binary, "asked").mapInArrow(pieces, "rt bigint, rlow bigint, size bigint, n bigint, piece binary"))
    held = join_groups(runs, found, parts, "n").groupBy("t").agg(F.collect_list(F.struct("low", "rt", "rlow", "piece")).alias("runs"))
    checked = materialise(texts.join(held, "t").select("t", binary, "runs").mapInArrow(compare, f"{_SPANS}, odd binary"))
    odd = checked.filter("odd is not null")
    again = odd.groupBy("odd").agg(F.count("*").alias("n")).filter("n > 1").select("odd")
    return checked.filter("odd is null").select("t", "low", "high").distinct().unionByName(odd.join(again, "odd").select("t", "low", "high"))


def substring_dedup(docs: DataFrame, group_rows: int = GROUP_ROWS, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of ``docs``.

    A byte goes when a string of LENGTH bytes that covers it starts anywhere else too, in whichever text; spans are the maximal runs of such
    bytes. A null text is empty; texts under LENGTH bytes lose nothing; equal texts of at least that lose everything; rows that repeat a
    doc_id count as texts of their own. Other columns are not looked at; an empty table gives no rows. Different texts are kept once, by a
    hash that is checked to tell them apart, in a table bucketed by it, so later joins do not move texts again. ``hash_bits`` shortens the
    hashes by which windows of common anchors meet; as these are compared, the result is the same.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    rows = materialise(named.drop("text"))
    for salt in range(8):
        t = F.xxhash64("sha", F.lit(salt))
        n, other = rows.filter(f"n_bytes >= {LENGTH}").select(t.alias("t"), "sha").distinct().agg(F.count("*"), F.count_distinct("t")).first()
        if n == other:
            break
    rows = rows.withColumn("t", t)
    table = f"framelight_{work_path(spark).rpartition('/')[2]}"
    distinct = named.filter(f"n_bytes >= {LENGTH}").select(t.alias("t"), "text").groupBy("t").agg(F.first("text").alias("text"))
    distinct.write.bucketBy(width, "t").option("compression", "zstd").option("path", f"{work_path(spark)}/texts").saveAsTable(table)
    texts = spark.table(table)
    shared = materialise(shared_anchors(texts, width))
    spans = sorted_group_spans(texts, shared.filter(F.col("members") <= group_rows))
    hot = shared.filter(F.col("members") > group_rows)
    if not hot.isEmpty():
        spans = spans.unionByName(counted_window_spans(texts, hot, hash_bits))
    lists = materialise(spans).groupBy("t").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer()
                spans_ = batch.column(2)[i].values
                low, high = (np.asarray(spans_.field(k)) for k in range(2))
                order = np.argsort(low, kind="stable")
                low, reach = low[order], np.maximum.accumulate(high[order])
                new = np.concatenate([[True], low[1:] > reach[:-1]])
                low, high = low[new], np.append(reach[:-1][new[1:]], reach[-1])
                kept, at, view = hashlib.sha256(), 0, memoryview(raw)
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    kept.update(view[at:a])
                    at = b
                kept.update(view[at:])
                out.append((batch.column(0)[i].as_py(), int((high - low).sum()), len(low), kept.hexdigest(), [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["t", "n_removed", "n_spans", "kept_sha256", "spans"])

    cut = texts.join(lists, "t").select("t", F.col("text").cast("binary"), "spans").mapInArrow(remove, "t bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<low:bigint,high:bigint>>")
    copies = rows.filter(f"n_bytes >= {LENGTH}").groupBy("sha").agg(F.count("*").alias("copies")).filter("copies > 1")
    flagged = _flag_copies(rows, copies)
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    whole = flagged.filter("copied").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high"))).alias("spans"))
    single = flagged.filter("not copied").join(cut, "t", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"))
    return whole.unionByName(single)


def _flag_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows with ``copied``: whether the text is one of several equal ones of LENGTH bytes; hot texts by broadcast, as in join_groups."""
    from .common import HOT_SHARE

    least = rows.count() * HOT_SHARE
    hot = F.broadcast(copies.filter(F.col("copies") > least).select("sha", F.lit(True).alias("hot")))
    marked = rows.join(hot, "sha", "left")
    cold = copies.filter(F.col("copies") <= least).select("sha", F.lit(True).alias("cold"))
    rest = marked.filter("hot is null").join(cold, "sha", "left").select("doc_id", "n_bytes", "sha", "t", F.coalesce("cold", F.lit(False)).alias("copied"))
    return marked.filter("hot").select("doc_id", "n_bytes", "sha", "t", F.lit(True).alias("copied")).unionByName(rest)
