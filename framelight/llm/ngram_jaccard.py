"""N-gram Jaccard join over groups of similar documents, with a token-group matrix inside each group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, blob_shuffle, byte_words, connected_components, forest, join_groups, materialise, mix, prefix_hash, shuffle_width, sorted_runs, span_hash, text_slices

SHINGLE, PERCENT = 5, 80
#: Shingles of the members of a group, a row of the token-group matrix.
GROUP_TOKENS = 1 << 19
#: The pass that only prepares looks at one signature in so many.
FEW = 4
#: Queries that one opening of a group compares.
QUERIES = 512
#: Sets of one slice of input that may go to a signature's owner; a slice has at most about SLICE signatures.
HOT, SLICE, MANY = 64, 2_000_000, 1 << 30
#: Shared tokens of queries and members that are counted at once.
COUNTED = 4_000_000
#: Bytes of signatures that one task gathers, about.
PART_BYTES = 32 << 20
U64 = np.uint64


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of a text column.

    Shingles are ``words`` consecutive words [^ \\t-\\r]+ of the text with A-Z lower-cased; a text of fewer words is one shingle of all
    of them, a text without words has none.
    """
    for a, b, data, offsets in text_slices(column):
        low = LOWER[data]
        start, end, row = byte_words(low, offsets, NOT_SPACE)
        h = span_hash(prefix_hash(low), start, end)
        first = np.searchsorted(row, np.arange(b - a + 1))
        with np.errstate(over="ignore"):
            grams = h[: max(0, len(h) - words + 1)].copy()
            for k in range(1, words):
                grams = mix(grams) + h[k : len(h) - words + 1 + k]
            grams = mix(grams)
        out = []
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= words:
                out.append(np.unique(grams[lo : hi - words + 1]))
            elif hi > lo:
                x = U64(hi - lo)
                with np.errstate(over="ignore"):
                    for w in h[lo:hi]:
                        x = mix(np.array([x * U64(3) + w]))[0]
                out.append(np.array([x], U64))
            else:
                out.append(np.zeros(0, U64))
        yield a, out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles and two hashes of the whole set."""

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            n, h1, h2 = (np.zeros(len(column), t) for t in (np.int64, U64, U64))
            for a, sets in shingle_sets(column, words):
                for i, s in enumerate(sets, a):
                    if len(s):
                        n[i] = len(s)
                        h1[i], h2[i] = set_hash(s), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
            yield pa.StructArray.from_arrays([pa.array(n), *(pa.array(x.view(np.int64)) for x in (h1, h2))], names=["n", "h1", "h2"])

    udf = F.arrow_udf(of, "struct<n:bigint,h1:bigint,h2:bigint>")
    return docs.select("doc_id", F.xxhash64("text").alias("t"), udf("text").alias("s")).select("doc_id", "t", F.col("s.n").alias("n_shingles"), "s.h1", "s.h2")


def set_hash(s: np.ndarray) -> np.uint64:
    """The first hash of a set of shingles."""
    return mix(s).sum(dtype=U64)


@lru_cache(maxsize=8)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes, and for each class the most shingles in which a linked pair can differ whose smaller set is of it.

    A bound is at least 100 / percent times the one before, so linked sets are of one class or of neighbouring ones.
    """
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    low = np.array(bounds, np.int64)
    return low, (low[1:] - 1) * (100 - percent) // percent


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, need, hashes of parts of the set): two linked, different sets share, of one class, as many as the less demanding of them needs.

    Where linked sets differ in at most d shingles, the hash space is cut into d + 1 + extra parts, of which 1 + extra are then equal. Parts with
    fewer shingles than L are left out, with L as large as it may be while no more than half of the extra parts have fewer; empty parts are
    left out if there are no more than extra. Equal parts have equal loads, so of two sets' equal parts only those are left out that the one with
    the larger L leaves out: need = 1 + extra - parts left out. Passages that documents share do not make their parts equal: a whole part
    must be. A set is cut for its own class and, as the larger of two, for the class below.
    """
    bounds, differ = size_classes(percent)
    own = int(np.searchsorted(bounds, len(s), side="right")) - 1
    out = []
    for k in (own, own - 1):
        if k < 0 or differ[k] == 0:
            continue
        d = int(differ[k])
        extra = max(2, -(-(d + 1) * 3 // 10))
        parts = d + 1 + extra
        part = ((s >> U64(32)) * U64(parts)) >> U64(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        load = np.diff(np.append(at, len(s)))
        fewer = np.concatenate([[0], np.cumsum(np.bincount(load, minlength=8))])  # fewer[L]: present parts with load < L
        fewer = fewer + (parts - len(at)) * (np.arange(len(fewer)) > 0)
        least = int(np.flatnonzero(fewer <= extra // 2).max()) or int(fewer[1] <= extra)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(s), at)
            keep = load >= least
            sig = mix(total[keep] + part[at][keep] * U64(0x9E3779B97F4A7C15) + U64(k) * U64(0xC2B2AE3D27D4EB4F) + load[keep].astype(U64))
            if least == 0:  # empty parts count too
                empty = np.setdiff1d(np.arange(parts, dtype=U64), part[at])
                sig = np.concatenate([sig, mix(empty * U64(0x9E3779B97F4A7C15) + U64(k) * U64(0xC2B2AE3D27D4EB4F))])
        out.append((k, 1 + extra - int(fewer[least]), sig))
    return out


def shared_signatures(docs: DataFrame, words: int, percent: int, width: int) -> DataFrame:
    """(sig, h1, k, need, sets): the signatures, of class k, that at least two different sets have, with each set (h1) that has it.

    sets is the number of sets that came to the owner, or MANY for those that did not need to.

    Signatures travel as packed arrays to the task that owns their hash range; a set that a slice of the input holds several times is sent
    once. Of a signature with over HOT sets in one slice only two sets go to its owner, as a sign that it is shared; the others are known to
    be shared and are dealt to all tasks by their sets, so no owner gets all sets of a frequent signature.
    """

    def send(known: list[np.ndarray], owner: list[np.ndarray], table: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        sig, who, names = np.concatenate(known), np.concatenate(owner), np.array(table, np.int64)
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        bypass = (np.diff(np.append(at, len(sig)))[group] > HOT) & (np.arange(len(sig)) - at[group] >= 2)
        to = ((sig >> U64(32)) * U64(width)) >> U64(32)
        to = np.where(bypass, names[who, 0].view(U64) % U64(width), to).astype(np.int64) * 2 + bypass
        order = np.argsort(to, kind="stable")
        sig, who, cuts = sig[order], who[order], np.searchsorted(to[order], np.arange(2 * width + 1))
        parts, blobs = [], []
        for p in np.flatnonzero(np.diff(cuts)):
            there, local = np.unique(who[cuts[p] : cuts[p + 1]], return_inverse=True)
            parts.append(p // 2)
            blobs.append(np.array([p % 2, len(there)], np.int64).tobytes() + names[there].tobytes() + sig[cuts[p] : cuts[p + 1]].tobytes() + local.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "payload"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owner, table, seen, held = [], [], [], set(), 0
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), words):
                for s in sets:
                    h = int(set_hash(s).view(np.int64)) if len(s) else 0
                    if not len(s) or h in seen:
                        continue
                    seen.add(h)
                    for k, need, x in signatures(s, percent):
                        known.append(x)
                        owner.append(np.full(len(x), len(table), np.uint16))
                        table.append((h, k, need))
                        held += len(x)
                    if held > SLICE or len(table) > 65_000:
                        yield from send(known, owner, table)
                        known, owner, table, seen, held = [], [], [], set(), 0
        if held:
            yield from send(known, owner, table)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(sig: np.ndarray, name: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            columns = [sig.view(np.int64), name[:, 0], *(x.astype(np.int32) for x in (name[:, 1], name[:, 2], count))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "h1", "k", "need", "sets"])

        sigs, whose, names, base = [], [], [], 0
        for batch in batches:
            for x in batch.column(1):
                raw = x.as_buffer()
                kind, n = np.frombuffer(raw, np.int64, 2)
                m = (raw.size - 16 - 24 * n) // 10
                name = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(n, 3)
                sig, who = np.frombuffer(raw, U64, m, 16 + 24 * n), np.frombuffer(raw, "<u2", m, 16 + 24 * n + 8 * m)
                if kind:
                    yield rows(sig, name[who], np.full(len(sig), MANY))
                    continue
                sigs.append(sig)
                whose.append(who.astype(np.int32) + np.int32(base))
                names.append(name)
                base += int(n)
        if not sigs:
            return
        sig, who, name = np.concatenate(sigs), np.concatenate(whose), np.concatenate(names)
        del sigs, whose, names
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        same = sig[1:] == sig[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sig, who = sig[some], who[some]
        order = np.lexsort((name[who, 0], sig))
        sig, who = sig[order], who[order]
        once = np.ones(len(sig), bool)
        once[1:] = (sig[1:] != sig[:-1]) | (name[who[1:], 0] != name[who[:-1], 0])
        sig, who = sig[once], who[once]
        if len(sig):
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            some = count > 1
            yield rows(sig[some], name[who[some]], count[some])

    blobs = docs.select("text").mapInArrow(emit, "part int, payload binary")
    return blob_shuffle(blobs, width).mapInArrow(gather, "sig bigint, h1 bigint, k int, need int, sets int")


def open_group(members: list[np.ndarray], sets: list[np.ndarray], own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of all links between queries' sets and the members of one group.

    The group's row of the token matrix is the union of its members' shingles. A query's overlap with the union bounds that with every
    member; only if the bound allows a link are the members that have its shingles counted. own: the place of a query that is itself a member,
    which is compared with the members after it only; -1 for others.
    """
    m, size = len(members), np.array([len(s) for s in members], np.int64)
    tokens, owner = np.concatenate(members), np.repeat(np.arange(m), size)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    union, first = np.unique(tokens[order], return_index=True)
    first = np.append(first, len(owner))
    sizes = np.array([len(s) for s in sets], np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    asked = np.concatenate(sets)
    at = np.searchsorted(union, asked)
    at[at == len(union)] = 0
    inside = union[at] == asked
    bound = np.add.reduceat(np.append(inside, False).astype(np.int64), cuts[:-1])
    times = np.where(inside, first[at + 1] - first[at], 0)
    load = np.add.reduceat(np.append(times, 0), cuts[:-1])
    open_ = np.flatnonzero(bound * 100 >= percent * sizes)
    left, right = [], []
    while len(open_):
        some = open_[: max(1, int(np.searchsorted(np.cumsum(load[open_]), COUNTED, side="right")))]
        open_ = open_[len(some) :]
        pick = np.concatenate([np.arange(cuts[q], cuts[q + 1]) for q in some])
        pick = pick[inside[pick]]
        n, query = times[pick], np.repeat(np.arange(len(some)), bound[some])
        places = np.arange(n.sum()) + np.repeat(first[at[pick]] - (np.cumsum(n) - n), n)
        both = np.bincount(np.repeat(query, n) * m + owner[places], minlength=len(some) * m).reshape(len(some), m)
        good = 100 * both >= percent * (sizes[some, None] + size[None, :] - both)
        q, y = np.nonzero(good & (np.arange(m)[None, :] > own[some, None]))
        left.append(some[q])
        right.append(y)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))


def compare(units: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, inside: bool, count_links: bool = False) -> DataFrame:
    """(a, b, links): edges that connect linked nodes and, if asked for, (node, null, rows linked), of what units (pos, gid) find.

    A unit's node is compared with the members of the group and, if ``inside``, the members of all groups with each other. A group with many
    queries is opened several times, each time with about QUERIES of them.
    """
    sizes = units.groupBy("gid").agg(F.count("*").alias("asked"))
    if inside:
        alone = nodes.groupBy("gid").agg(F.count("*").alias("asked")).filter("asked > 1")
        sizes = alone.unionByName(sizes).groupBy("gid").agg(F.sum("asked").alias("asked"))
    sizes = materialise(sizes)
    turns = F.expr(f"cast(ceil(asked / {QUERIES}) as int)")
    turn = F.pmod(F.xxhash64("pos"), turns.cast("long")).cast("int")
    asking = join_groups(units, sizes, ["gid"], "asked").select("pos", "gid", turn.alias("turn"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    members = nodes.join(sizes, "gid").select("pos", "gid", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), F.lit(True).alias("member"), turn.alias("own"))
    members = members.select("pos", "gid", "turn", "member", (F.col("own") == F.col("turn")).alias("asks"))
    wanted = asking.unionByName(members).join(texts, "pos")
    full = wanted.select("gid", "turn", "pos", "member", "asks", "copies", "text").repartition("gid", "turn").sortWithinPartitions("gid", "turn", "pos")

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, 2):
            pos, member, asks, copies = (np.asarray(table.column(c)) for c in ("pos", "member", "asks", "copies"))
            column = table.column("text").combine_chunks()
            inner = [s for _, part in shingle_sets(column.filter(pa.array(member)), words) for s in part]
            name, weight = pos[member], copies[member]
            links: dict[int, int] = {}
            jobs = [(pos[~member], copies[~member], column.filter(pa.array(~member)), None)]
            some = np.flatnonzero(asks[member])
            if inside and len(some):
                jobs.append((name[some], weight[some], None, [inner[i] for i in some]))
            left, right = [], []
            for who, times, texts, known in jobs:
                for first, sets in [(0, known)] if known is not None else shingle_sets(texts, words):
                    if not sets:
                        continue
                    own = some if known is not None else np.full(len(sets), -1)
                    q, y = open_group(inner, sets, own, percent)
                    q = q + first
                    left.append(who[q])
                    right.append(name[y])
                    if count_links:
                        for i, j in zip(q.tolist(), y.tolist(), strict=True):
                            links[int(who[i])] = links.get(int(who[i]), 0) + int(weight[j])
                            links[int(name[j])] = links.get(int(name[j]), 0) + int(times[i])
            a, b = forest(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "links"])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.nulls(len(links), pa.int64()), pa.array(list(links.values()), pa.int64())], names=["a", "b", "links"])

    return materialise(full.mapInArrow(opening, "a bigint, b bigint, links bigint"))


def grouped(chosen: DataFrame) -> DataFrame:
    """``chosen`` in the order of lead, numbered (pos) and cut into groups (gid) of about GROUP_TOKENS shingles.

    Groups run on across the parts of the order: the parts' sums of shingles, one number a part, are added up in the driver.
    """
    spark = chosen.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, tokens = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ahead = np.cumsum(np.asarray(batch.column("n_shingles"))) + tokens
            pos = np.arange(rows, rows + batch.num_rows) + (np.int64(part) << 33)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(np.full(len(pos), part, np.int32)), pa.array(ahead)], names=[*batch.schema.names, "pos", "part", "ahead"])
            if batch.num_rows:
                rows, tokens = rows + batch.num_rows, int(ahead[-1])

    in_order = chosen.repartitionByRange("lead", "h1", "h2").sortWithinPartitions("lead", "h1", "h2").drop("lead")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in in_order.schema) + ", pos bigint, part int, ahead bigint"
    rows = materialise(in_order.mapInArrow(count, schema))
    before, sums = 0, []
    for part, tokens in sorted(rows.groupBy("part").agg(F.max("ahead")).collect()):
        sums.append((part, before))
        before += tokens
    offsets = spark.createDataFrame(sums, "part int, before bigint")
    return materialise(rows.join(F.broadcast(offsets), "part").withColumn("gid", F.expr(f"(before + ahead - 1) div {GROUP_TOKENS}")).drop("part", "ahead", "before"))


def enough(pairs: DataFrame, few: int = 1) -> DataFrame:
    """(pos, gid) of the rows (pos, gid, k, need), one for each shared signature in ``few``, that are as many as a link of class k needs."""
    counted = pairs.groupBy("pos", "gid", "k").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    return materialise(counted.filter(F.col("shared") * few >= F.col("need")).select("pos", "gid").distinct())


def ngram_jaccard(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and, if asked for, n_links for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id that links
    lead to, n_links the number of rows linked directly. Documents without words, null texts included, have an empty set and no link, not
    even with each other. Rows that repeat a doc_id are documents of their own. Rows with a null doc_id are compared like all others;
    their id is never the smallest, and component_id is null where links lead to no other. Other columns are not looked at.

    Equal sets (by number of shingles and 128 bits of hashes) are one node. Nodes that share a signature are sorted by the
    commonest one of theirs and cut into groups of similar ones. The matrix of the tokens (here the signatures) of groups' unions bounds what a node can share with
    any member: groups are opened for a node only if it has as many signatures in the union as a link needs. The result is exact, as
    signatures only choose what is compared, on the texts' own shingles.

    Without n_links, groups that components show to be connected with a node need not be opened for it: first each node asks, for one in FEW of its
    signatures, only the first group that has it, and a second pass opens those groups alone that have members of another component. So
    a family of near copies costs about as many comparisons as it has members. With n_links every qualifying group is opened.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    rows = materialise(sketch(docs, words))
    some = rows.filter("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "t")).alias("least")
    classes = materialise(some.groupBy("n_shingles", "h1", "h2").agg(least, F.count("*").alias("copies")).select("n_shingles", "h1", "h2", "copies", F.col("least.doc_id").alias("rep"), "least.t"))
    shingles = some.agg(F.sum("n_shingles")).first()[0] or 0
    found = materialise(shared_signatures(docs, words, percent, max(shuffle_width(spark), shingles * 6 // PART_BYTES)))
    lead = found.groupBy("h1").agg(F.max(F.struct("sets", "sig")).alias("lead"))
    nodes = grouped(classes.join(lead, "h1"))
    entries = materialise(found.join(nodes.select("h1", "pos", "gid"), "h1").select("sig", "k", "need", "pos", "gid"))
    # A text is found by its id and its own hash, and taken once, however many rows repeat both.
    key = ["t", "null_id", "id"]
    once = docs.groupBy(F.xxhash64("text").alias("t"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("doc_id", F.lit(0)).alias("id")).agg(F.first("text").alias("text"))
    texts = materialise(nodes.select("pos", "copies", "t", F.col("rep").isNull().alias("null_id"), F.coalesce("rep", F.lit(0)).alias("id")).join(once, key).select("pos", "copies", "text"))
    if count_links:
        held = entries.withColumn("component", F.col("pos"))
    else:
        part = entries.filter(F.pmod(F.xxhash64("sig"), F.lit(FEW)) == 0)
        first = part.groupBy("sig").agg(F.min("gid").alias("to"))
        asked = enough(part.join(first, "sig").filter("gid > to").select("pos", F.col("to").alias("gid"), "k", "need"), FEW)
        edges = connected_components(compare(asked, nodes, texts, words, percent, inside=True).select("a", "b"))
        held = materialise(entries.join(edges.withColumnRenamed("node", "pos"), "pos", "left").withColumn("component", F.coalesce("component", "pos")))
    matrix = held.groupBy("sig", F.col("gid").alias("to")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("need").alias("less"))
    pairs = held.join(matrix, "sig").filter("to > gid" if count_links else "to > gid and (low != component or high != component)")
    asked = enough(pairs.select("pos", F.col("to").alias("gid"), "k", F.least("need", "less").alias("need")))
    out = compare(asked, nodes, texts, words, percent, inside=count_links, count_links=count_links)
    links = out.filter("b is not null").select("a", "b")
    if not count_links:
        links = links.unionByName(edges.select(F.col("node").alias("a"), F.col("component").alias("b")))
    components = materialise(nodes.select("n_shingles", "h1", "h2", "pos", "rep").join(connected_components(links).withColumnRenamed("node", "pos"), "pos"))
    ids = materialise(components.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")))
    named = join_groups(components, ids, ["component"], "size").select("n_shingles", "h1", "h2", "pos", "component_id")
    if count_links:
        counted = out.filter("b is null").groupBy(F.col("a").alias("pos")).agg(F.sum("links").alias("links"))
        named = named.join(counted, "pos", "left")
    key = ["n_shingles", "h1", "h2"]
    known = materialise(classes.select(*key, "copies", "rep").join(named.drop("pos"), key, "left"))
    number = {"n_links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1} if count_links else {}
    full = join_groups(some.select("doc_id", *key), known, key, "copies").withColumns({"component_id": F.coalesce("component_id", "rep"), **number})
    empty = rows.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), **({"n_links": F.lit(0).cast("long")} if count_links else {})})
    columns = ["doc_id", "n_shingles", "component_id", *number]
    return full.select(columns).unionByName(empty.select(columns))
