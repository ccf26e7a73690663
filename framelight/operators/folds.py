"""Order-dependent folds over the frames of one media item, as higher-order functions. Frames of an item are few by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def greedy_phash_dedupe(frames: DataFrame, threshold: int = 10) -> DataFrame:
    """Keeps a frame if its signature differs in more than ``threshold`` bits from every kept one before it. frames: video_id, position, phash."""
    grouped = frames.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("position", "phash"))).alias("f"))
    empty = F.expr("cast(array() as array<struct<position:bigint,phash:bigint>>)")
    keep = F.aggregate("f", empty, lambda acc, x: F.when(F.forall(acc, lambda y: C.hamming(y["phash"], x["phash"]) > threshold), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select("video_id", F.explode(keep).alias("k")).select("video_id", "k.position", "k.phash")


def multi_key_dedupe(frames: DataFrame) -> DataFrame:
    """Drops a frame whose position, timestamp or signature a kept frame before it has. frames: video_id, seq, position, timestamp_ms, phash."""
    kind = "array<struct<seq:bigint,position:bigint,timestamp_ms:bigint,phash:bigint>>"
    grouped = frames.select("video_id", *(F.col(c).cast("long") for c in ("seq", "position", "timestamp_ms", "phash"))).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("seq", "position", "timestamp_ms", "phash"))).alias("f"))

    def clash(y: Column, x: Column) -> Column:
        same = F.lit(False)
        for c in ("position", "timestamp_ms", "phash"):
            same = same | F.coalesce(y[c] == x[c], F.lit(False))
        return same

    keep = F.aggregate("f", F.expr(f"cast(array() as {kind})"), lambda acc, x: F.when(F.exists(acc, lambda y: clash(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select("video_id", F.explode(keep).alias("k")).select("video_id", "k.*")


def target_count(duration_ms: Column | str, most: int = 8, interval_ms: int = 120_000) -> Column:
    """Frames wanted of an item: all allowed if its duration isn't known, else one per begun interval."""
    d = C.col(duration_ms)
    wanted = F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(d / interval_ms)))
    return F.when(d.isNull() | (d <= 0), F.lit(most).cast("long")).otherwise(wanted)


def ideal_timestamps(duration_ms: Column | str, count: Column | str) -> Column:
    """Centres of ``count`` equal parts, rounded half-even, within the item, each once."""
    d, n = C.col(duration_ms).cast("double"), C.col(count)
    at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.rint((i + 0.5) * d / n).cast("long"), d.cast("long") - 1)))
    return F.when((d > 0) & (n > 0), F.array_distinct(at)).otherwise(F.expr("cast(array() as array<bigint>)"))


def select_representative(frames: DataFrame, most: int = 8, interval_ms: int = 120_000) -> DataFrame:
    """Chooses frames near the ideal times of an item: video_id, seq, timestamp_ms in final order.

    frames: video_id, duration_ms, seq, timestamp_ms. Times outside the item count as unknown; of equal times the first frame stays. Each ideal
    time takes the nearest frame left (the earlier of two, then the first). Where timed frames are too few, or the duration isn't known, they
    come in order and frames without a time fill up.
    """
    ts = C.valid_timestamp("timestamp_ms", "duration_ms").cast("long")
    rows = frames.select("video_id", F.col("duration_ms").cast("long"), F.col("seq").cast("long"), ts.alias("ts"))
    first = F.row_number().over(Window.partitionBy("video_id", "ts").orderBy("seq"))
    rows = rows.withColumn("r", first).filter("ts is null or r = 1")
    grouped = rows.groupBy("video_id").agg(
        F.first("duration_ms").alias("duration_ms"),
        F.sort_array(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct(F.col("ts").alias("t"), F.col("seq").alias("i"))))).alias("timed"),
        F.sort_array(F.collect_list(F.when(F.col("ts").isNull(), F.struct(F.col("ts").alias("t"), F.col("seq").alias("i"))))).alias("untimed"),
    )
    wanted = F.least(target_count("duration_ms", most, interval_ms), (F.size("timed") + F.size("untimed")).cast("long"))
    grouped = grouped.withColumn("n", wanted)
    ideals = ideal_timestamps("duration_ms", target_count("duration_ms", most, interval_ms))
    state = F.struct(F.col("timed").alias("left"), F.slice("timed", 1, 0).alias("taken"))

    def take(acc: Column, ideal: Column) -> Column:
        best = F.element_at(F.array_sort(F.transform(acc["left"], lambda f: F.struct(F.abs(f["t"] - ideal).alias("d"), f["t"].alias("t"), f["i"].alias("i")))), 1)
        pick = F.struct(best["t"].alias("t"), best["i"].alias("i"))
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(F.array_except(acc["left"], F.array(pick)).alias("left"), F.concat(acc["taken"], F.array(pick)).alias("taken")))

    folded = grouped.withColumn("s", F.aggregate(ideals, state, take))
    enough = (F.col("duration_ms") > 0) & (F.size("timed") >= F.col("n"))
    chosen = F.when(enough, F.col("s.taken")).otherwise(F.slice(F.concat("timed", "untimed"), F.lit(1), F.col("n").cast("int")))
    out = folded.select("video_id", F.explode(chosen).alias("f")).select("video_id", F.col("f.i").alias("seq"), F.col("f.t").alias("timestamp_ms"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.asc_nulls_last("timestamp_ms"), "seq")))


def gallery_timestamp(position: Column | str, last: Column | str, duration_ms: Column | str) -> Column:
    """Time of a gallery position by its share of the item, within it."""
    d = C.col(duration_ms).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.rint(C.col(position) / C.col(last) * d).cast("long"), d - 1))


def storyboard_tiles(boards: DataFrame) -> DataFrame:
    """One row per tile, row by row: video_id, position, tile_row, tile_column, timestamp_ms. boards: video_id, columns, rows, duration_ms."""
    total = F.col("columns") * F.col("rows")
    tiles = boards.select("*", F.explode(F.sequence(F.lit(0), total - 1)).alias("position"))
    at = F.when(F.col("duration_ms") > 0, F.rint(F.col("position") / total * F.col("duration_ms")).cast("long"))
    return tiles.select("video_id", "position", F.expr("position div columns").alias("tile_row"), F.expr("position % columns").alias("tile_column"), at.alias("timestamp_ms"))


def gallery_positions(items: DataFrame, most: int = 8, interval_ms: int = 120_000) -> DataFrame:
    """Positions chosen of a gallery: video_id, chosen. items: video_id, positions (array<int>), gallery_max, duration_ms.

    Centred ideal positions, kept strictly increasing, each take the nearest observed one that is free. With fewer observed positions than
    wanted all of them stay and ideal ones are added, the farthest from what is chosen first; then the lowest that are free. Without a known
    duration only observed positions are taken, in order.
    """
    known = F.coalesce(F.col("duration_ms") > 0, F.lit(False))
    observed = F.array_sort(F.array_distinct(F.col("positions").cast("array<int>")))
    rows = items.filter((F.size("positions") > 0) & (F.col("gallery_max") > 0)).select("video_id", observed.alias("p"), known.alias("known"), F.col("gallery_max").cast("int").alias("g"), target_count("duration_ms", most, interval_ms).cast("int").alias("c"))
    rows = rows.withColumn("n", F.when(F.col("known"), F.least("c", "g")).otherwise(F.least("c", F.size("p"))))
    none = F.expr("cast(array() as array<int>)")

    def ideal(acc: Column, i: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        centre = F.rint((i + 0.5) * F.col("g") / F.col("n")).cast("int")
        return F.concat(acc, F.array(F.least(F.greatest(centre, last + 1), F.col("g") - (F.col("n") - i - 1))))

    def nearest(acc: Column, at: Column) -> Column:
        pick = F.array_sort(F.transform(acc["left"], lambda x: F.struct(F.abs(x - at).alias("d"), x.alias("x"))))
        chosen = F.element_at(pick, 1)["x"]
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(F.array_except(acc["left"], F.array(chosen)).alias("left"), F.concat(acc["taken"], F.array(chosen)).alias("taken")))

    def fill(acc: Column, candidates: Column, far: bool) -> Column:
        free = F.filter(candidates, lambda x: ~F.array_contains(acc, x))
        gap = F.transform(free, lambda x: F.struct((F.array_min(F.transform(acc, lambda y: F.abs(x - y))) if far else -x).alias("d"), x.alias("x")))
        return F.when((F.size(acc) >= F.col("n")) | (F.size(free) == 0), acc).otherwise(F.concat(acc, F.array(F.element_at(F.array_sort(gap), -1)["x"])))

    steps = F.sequence(F.lit(0), F.col("n") - 1)
    rows = rows.withColumn("ideal", F.aggregate(steps, none, ideal))
    dense = F.aggregate("ideal", F.struct(F.col("p").alias("left"), none.alias("taken")), nearest)["taken"]
    far = F.aggregate(steps, F.col("p"), lambda acc, _: fill(acc, F.col("ideal"), True))
    rows = rows.withColumn("far", far)
    sparse = F.aggregate(steps, F.col("far"), lambda acc, _: fill(acc, F.sequence(F.lit(1), F.col("g")), False))
    chosen = F.when(~F.col("known"), F.slice("p", F.lit(1), F.col("n"))).when(F.size("p") >= F.col("n"), dense).otherwise(sparse)
    return rows.select("video_id", F.array_sort(chosen).alias("chosen"))
