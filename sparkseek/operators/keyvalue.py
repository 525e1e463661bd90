"""Key-value logs, merge maps and static dictionaries (KV-1..6, MAP-1..7, PH-1..2).

A store is a log of (key, seq, value, is_tombstone): Put and Delete append, and
the newest record of a key is its state.  The newest is an aggregate, so it is
combined before the shuffle, and a key with very many records costs one row per
task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.sources import shared

MAX_VALUE = 1 << 20
LOG_COLUMNS = ["key", "seq", "value", "is_tombstone"]
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed: FNV-1a, 64 bits


def latest(log: DataFrame) -> DataFrame:
    """KV-3: (key, seq, value) of the live keys; last write wins, a tombstone removes."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone"), "seq").alias("r"), F.max("seq").alias("seq"))
    return newest.filter(~F.col("r.is_tombstone")).select("key", "seq", "r.value")


def put(log: DataFrame, rows: DataFrame, max_value: int = MAX_VALUE) -> DataFrame:
    """KV-1: the log with rows (key, seq, value) appended; a value above the limit is an error."""
    size = F.octet_length(F.col("value").cast("string"))
    checked = F.when(size > max_value, F.raise_error(F.lit("value too large"))).otherwise(F.col("value"))
    return log.unionByName(rows.select("key", "seq", checked.alias("value"), F.lit(False).alias("is_tombstone")))


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """KV-2: tombstones for (key, seq), present or not."""
    kind = log.schema["value"].dataType
    return log.unionByName(keys.select("key", "seq", F.lit(None).cast(kind).alias("value"), F.lit(True).alias("is_tombstone")))


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) of each key asked for; only their records are aggregated."""
    asked = keys.select("key").distinct()
    own = latest(log.join(asked, "key", "left_semi"))
    return asked.join(own, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "value")


def reset(log: DataFrame) -> DataFrame:
    """KV-4: an empty log of the same shape."""
    return log.limit(0)


def bucket(key: Column, buckets: int) -> Column:
    """KV-5: bucket of a key; the number of buckets must be a power of two."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1))


def fnv1a(data: bytes) -> int:
    """KV-5: FNV-1a of 64 bits, for files that need it."""
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def save_log(log: DataFrame, table: str, buckets: int = 64) -> None:
    """SRC-7: a table bucketed and sorted by key, so that later joins on it need no shuffle."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    log.select(LOG_COLUMNS).write.mode("append").bucketBy(buckets, "key").sortBy("key", "seq").format("parquet").saveAsTable(table)


def open_log(spark: SparkSession, table: str) -> DataFrame:
    """SRC-7: a saved log; an unknown table or one that is no log is an error."""
    if not spark.catalog.tableExists(table):
        raise FileNotFoundError(table)
    log = spark.table(table)
    if log.columns != LOG_COLUMNS:
        raise ValueError(f"{table} is no log: it has {log.columns}")
    return log


def merge(old: DataFrame, new: DataFrame, combine: Callable[[Column], Column] = F.sum) -> DataFrame:
    """MAP-4 for a commutative merger: combine over the old value and all new ones."""
    return old.select("key", "value").unionByName(new.select("key", "value")).groupBy("key").agg(combine(F.col("value")).alias("value"))


def merge_in_order(ops: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """MAP-4 for any merger: f(old, new) over (key, seq, value) in the order of seq.

    The values of a key are gathered; use merge() where order does not matter."""
    lists = ops.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]).alias("v"))
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return lists.select("key", F.aggregate(rest, F.col("v")[0], combine).alias("value"))


def size(table: DataFrame) -> int:
    return table.count()


def iterate(table: DataFrame) -> Iterator:
    """MAP-6: rows one partition at a time; stop when you like."""
    return table.toLocalIterator()


def build_dictionary(keys: DataFrame, order: str = "ordinal") -> DataFrame:
    """PH-1: (key, idx): places from 0 in the given order; a repeated key is an error.

    The global rank is taken in two steps, ranks within ranges and offsets of
    ranges, so no task sees all keys."""
    doubled = keys.groupBy("key").count().filter("count > 1")
    if not doubled.isEmpty():
        raise ValueError("a key occurs twice")
    return ranked(keys, order).select("key", (F.col("rank") - 1).cast("long").alias("idx"))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """Adds rank, from 1 in ascending order of a column: in ranges, then over them.

    The ranges are written once to the shared folder: counts and ranks then see the
    same ones, whatever is computed again after an executor was lost."""
    ranges = rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id())
    ranges = shared.stored(ranges, f"{shared.shared_root(rows.sparkSession)}/ranges-{uuid.uuid4().hex}")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))  # a row per range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranges.withColumn("_own", own).join(before, "_range").withColumn("rank", F.col("_own") + F.col("_before")).drop("_range", "_own", "_n", "_before")


def look_up(dictionary: DataFrame, probes: DataFrame) -> DataFrame:
    """PH-2: probes with idx (null if absent) and found."""
    out = probes.join(dictionary, "key", "left")
    return out.select(*probes.columns, "idx", F.col("idx").isNotNull().alias("found"))


def empty(spark: SparkSession, value_type: str = "string") -> DataFrame:
    """A new log."""
    return spark.createDataFrame([], f"key string, seq long, value {value_type}, is_tombstone boolean")
