"""Interval operators: unions, islands, ordered folds over overlapping rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.storage import size


#: Bytes of input files for a partition of rows that one task sorts.
PART_BYTES = 4 << 20


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows parted by keys, in partitions whose number grows with the input files, so that a task's rows do not; as they are if the files are small or unknown."""
    n = -(-sum(map(size, df.inputFiles())) // PART_BYTES)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def union_length(df: DataFrame, keys: list[str], start: str, end: str, name: str = "matched_length") -> DataFrame:
    """Inclusive length of the union of [start, end] per keys: each interval adds what lies beyond the furthest end before it."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(before), F.col(start) - 1)
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(reach, F.col(start) - 1))
    rows = dealt(df.select(*keys, start, end), keys)
    return rows.select(*keys, new.cast("bigint").alias("_new")).groupBy(*keys).agg(F.sum("_new").alias(name))


#: Positions of a bin in which the islands of a long key are numbered by tasks of their own.
BIN = 1 << 16


def _binned(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> tuple[DataFrame, Window, Window]:
    """Rows dealt over bins of start with _carry, the furthest end before the bin; the windows of a bin and of the bins before one.

    Whole rows are moved once.  A bin's key is one struct, in which nulls are
    equal, so that joins with one row per bin keep the partitions; its hash,
    made after the move, is what rows are sorted by first.
    """
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.floor(F.col(start) / width).alias("bin"))
    rows = df.withColumn("_key", key)
    earlier = Window.partitionBy(*(f"_key.k{i}" for i in range(len(keys)))).orderBy("_key.bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_key").agg(F.max(end).alias("_top")).withColumn("_carry", F.max("_top").over(earlier)).drop("_top")
    rows = rows.repartition("_key").join(tops, "_key", "left").withColumn("_hash", F.xxhash64("_key"))
    return rows, Window.partitionBy("_hash", "_key"), earlier


def islands(df: DataFrame, keys: list[str], start: str, end: str, name: str = "island", touching: bool = True, width: int | None = None) -> DataFrame:
    """Numbers the groups of transitively overlapping intervals per keys.

    Rows of different islands can't overlap, so order-dependent folds run per
    island: their groups stay as small as the overlaps are, however many rows
    a key has.  With a width a key's rows are dealt over bins of start; what is
    carried over a bin's edge, the furthest end and the count of islands before
    it, comes from one row per bin.
    """
    rows, part = df, Window.partitionBy(*keys)
    if width is not None:
        rows, part, earlier = _binned(df, keys, start, end, width)
    order = part.orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    if width is not None:
        reach = F.greatest("_carry", reach)
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    rows = rows.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    number = F.sum("_new").over(order)
    if width is not None:
        counts = rows.groupBy("_key").agg(F.sum("_new").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        rows, number = rows.join(counts, "_key", "left"), number + F.col("_before")
    return rows.withColumn(name, number).select(*df.columns, name)


def islands_of_bins(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Adds bin, island and open: touching intervals of a bin in islands numbered within it, and whether others may belong to one.

    An island is open if it goes on from an earlier bin or is the last of its
    bin.  Rows of an island that is not open follow each other in one partition,
    and no other row touches it; islands of the open rows alone are whole ones too.
    """
    rows, part, _ = _binned(df, keys, start, end, width)
    order = part.orderBy(start, end)
    reach = F.greatest("_carry", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(order))
    last = F.max("island").over(part)
    return rows.withColumn("open", (F.col("island") == 0) | (F.col("island") == last)).select(*df.columns, F.col("_key.bin").alias("bin"), "island", "open")


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal regions of intervals that overlap by more than nothing (keys, start, end)."""
    held = islands(df.select(*keys, start, end), keys, start, end, "_i", touching=False)
    return held.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def merged_size(df: DataFrame, keys: list[str], start: str, end: str, name: str = "size") -> DataFrame:
    """Sum of end - start over the maximal regions of each key."""
    return merged(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def greedy_accept(df: DataFrame, keys: list[str], order: list[Column], start: str, end: str, passes: Column | None = None) -> DataFrame:
    """Rows kept by a greedy pass: in order, a row is dropped if it overlaps (both ends inclusive) a row kept before or fails passes.

    A failing row never stands in another's way.  The fold runs per island of
    overlapping rows.  order must be total.
    """
    rows = islands(df.withColumn("_ok", F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))), keys, start, end, "_island")
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    item = F.struct(rank.alias("rank"), F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.col("_ok").alias("ok"), F.col(start).alias("s"), F.col(end).alias("e"))
    groups = rows.groupBy(*keys, "_island").agg(F.sort_array(F.collect_list(item)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        blocked = F.exists(acc, lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"]))
        return F.when(~x["ok"] | blocked, acc).otherwise(F.array_append(acc, x))

    kept = F.aggregate("xs", F.slice("xs", 1, 0), step)
    return groups.select(F.explode(kept).alias("x")).select("x.row.*")


def pair_fold(pairs: DataFrame, keys: list[str], order: list[Column], loser: Column, other: Column) -> DataFrame:
    """Ids removed by going through pairs in order: a pair counts only if neither side is removed yet, then its loser goes.

    (keys, removed) rows.  Keys should part rows that can't meet (islands).
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    item = F.struct(rank.alias("rank"), loser.alias("loser"), other.alias("other"))
    groups = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        gone = F.array_contains(acc, x["loser"]) | F.array_contains(acc, x["other"])
        return F.when(gone, acc).otherwise(F.array_append(acc, x["loser"]))

    none = F.transform(F.slice("xs", 1, 0), lambda x: x["loser"])
    return groups.select(*keys, F.explode(F.aggregate("xs", none, step)).alias("removed"))


def ordered_fold(df: DataFrame, keys: list[str], order: list[Column], values: list[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "state") -> DataFrame:
    """(keys, state): a fold over each key's rows in a total order."""
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    item = F.struct(rank.alias("rank"), *(F.col(v).alias(v) for v in values))
    groups = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    out = F.aggregate("xs", start, step, finish) if finish else F.aggregate("xs", start, step)
    return groups.select(*keys, out.alias(name))


def range_pairs(df: DataFrame, equal: list[str], start: str, end: str, width: int, columns: list[str]) -> DataFrame:
    """Pairs (a_*, b_*) of rows equal in some columns where b starts in [a.start, a.end).

    Both sides meet in bins of a given width, so a hot key is spread over its
    bins; a pair is made once, in the bin where b starts.
    """
    a = df.select(*(F.col(c).alias(f"a_{c}") for c in columns), *(F.col(c).alias(f"_{i}") for i, c in enumerate(equal)), F.col(start).alias("_s"), F.col(end).alias("_e"))
    a = a.where("_e > _s").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width))))
    b = df.select(*(F.col(c).alias(f"b_{c}") for c in columns), *(F.col(c).alias(f"_{i}") for i, c in enumerate(equal)), F.col(start).alias("_at"), F.floor(F.col(start) / width).alias("_bin"))
    on = [f"_{i}" for i in range(len(equal))] + ["_bin"]
    return a.join(b, on).where("_at >= _s and _at < _e").drop(*on, "_s", "_e", "_at")
