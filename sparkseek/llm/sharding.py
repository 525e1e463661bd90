"""Minimax contiguous partition of documents into shards of near-equal bytes.

Documents with equal texts form one atomic group.  Groups stand in the order of
a 64-bit hash of their text.  The smallest shard capacity C for which a greedy
left-to-right filling needs no more than the given number of shards is found by
binary search, and the cuts are made where that filling stops.

The driver never sees the groups.  It holds a histogram of key ranges, at most
``BINS`` to begin with.  A greedy filling that stops inside a range of several
groups asks for that range to be split; the search is repeated over the finer
histogram until every stop of every tested capacity is at a single group, when
the result is exact.  A group above the fair share gets a shard of its own, as
else its size would be everybody's capacity, and the rest would stay empty.

Null and empty texts are one group (size 1 each).  Repeated rows stay, each with
a slot of its own.  Two different texts of the same hash share a group, which
keeps every promise made here.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.llm import common

BINS = 4096  # key ranges in the first histogram
SPLIT = 64  # parts of a range that is split
ROWS_PER_WINDOW = 200_000  # rows that one ranking task is meant to have


class KeyRange:
    """Groups with lo <= key <= hi: how many, their bytes and the largest."""

    __slots__ = ("bytes", "groups", "hi", "lo")

    def __init__(self, lo: int, hi: int, groups: int, size: int):
        self.lo, self.hi, self.groups, self.bytes = lo, hi, groups, size


def fill(ranges: Sequence[KeyRange], capacity: int, shards: int) -> tuple[list[int], list[int], bool]:
    """Greedy filling: last keys of each shard, ranges where it stopped, feasible."""
    ends: list[int] = []
    stops: list[int] = []
    load = 0
    for i, r in enumerate(ranges):
        if load + r.bytes > capacity:
            if r.groups > 1:
                stops.append(i)
            if r.bytes > capacity or len(ends) + 2 > shards:
                return ends, stops, False
            ends.append(ranges[i - 1].hi)
            load = 0
        load += r.bytes
    return ends, stops, True


def smallest_capacity(ranges: Sequence[KeyRange], shards: int) -> tuple[int, list[int], set[int]]:
    """Capacity, cuts, and the ranges of several groups at which a test stopped."""
    total = sum(r.bytes for r in ranges)
    low, high = -(-total // shards), max(total, 1)
    unsure: set[int] = set()
    while low < high:
        middle = (low + high) // 2
        _, stops, fits = fill(ranges, middle, shards)
        unsure.update(stops)
        low, high = (low, middle) if fits else (middle + 1, high)
    ends, stops, _ = fill(ranges, high, shards)
    return high, ends, unsure | set(stops)


def _top(key: Column) -> Column:
    """The highest bits of the key: BINS values."""
    return F.shiftright(key, 64 - (BINS.bit_length() - 1))


def _counted(bins) -> list[KeyRange]:
    rows = bins.agg(
        F.count("*").alias("groups"), F.sum("bytes").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")
    ).collect()
    return sorted((KeyRange(r.lo, r.hi, r.groups, r.bytes) for r in rows), key=lambda r: r.lo)


def _finer(groups: DataFrame, ranges: Sequence[KeyRange], parts: int) -> list[KeyRange]:
    """Split each range, which lies within one bin, into parts of equal width and count what is there."""
    top = 64 - (BINS.bit_length() - 1)
    rows = ", ".join(f"({r.lo >> top}, {i}, {r.lo}L, {r.hi}L, {max(1, -(-(r.hi - r.lo + 1) // parts))}L)" for i, r in enumerate(ranges))
    bounds = groups.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(bin, part, lo, hi, width)")
    # no more ranges than tests of the search times shards: a bound that does not grow with the data
    found = groups.withColumn("bin", _top(F.col("key"))).join(F.broadcast(bounds), "bin")
    found = found.filter(F.col("key").between(F.col("lo"), F.col("hi")))
    return _counted(found.groupBy("part", F.expr("(key - lo) div width").alias("sub")))


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], list[int]]:
    """(capacity, last keys of the ranges, keys of groups with own shards)."""
    total = groups.agg(F.sum("bytes")).first()[0]
    if not total:
        return 0, [], []
    own: list[int] = []
    for r in groups.orderBy(F.desc("bytes"), "key").limit(max(shards - 1, 0)).collect():
        if r.bytes * (shards - len(own)) <= total or len(own) + 1 >= shards:
            break
        own.append(r.key)
        total -= r.bytes
    rest = groups.filter(~F.col("key").isin(own)) if own else groups
    ranges = _counted(rest.groupBy(_top(F.col("key")).alias("bin")))
    while True:
        capacity, ends, unsure = smallest_capacity(ranges, shards - len(own))
        if not unsure:
            return capacity, ends, own
        split = sorted(unsure)
        finer = _finer(rest, [ranges[i] for i in split], SPLIT)
        kept = [r for i, r in enumerate(ranges) if i not in unsure]
        ranges = sorted([*kept, *finer], key=lambda r: r.lo)


def shard_of(key: Column, ends: Sequence[int], own: Sequence[int], shards: int) -> Column:
    """The number of cuts below the key; own groups take the last shards."""
    place = F.lit(0)
    for end in ends:
        place = place + (key > F.lit(end)).cast("int")
    for i, k in enumerate(own):
        place = F.when(key == F.lit(k), F.lit(shards - 1 - i)).otherwise(place)
    return place.cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0)."""
    text = common.text_or_empty(text_col)
    base = common.stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-base",
    )
    groups = common.stored(base.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, ends, own = plan_cuts(groups, shards)
    placed = base.withColumn("shard", shard_of(F.col("key"), ends, own, shards))
    n_sub = max(64, base.count() // (ROWS_PER_WINDOW * shards) + 1)
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(n_sub)))
    # shards * n_sub rows, so rows / ROWS_PER_WINDOW: a table join, which may broadcast when small
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "key"))
    return placed.withColumn("rank", rank).join(before, ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
