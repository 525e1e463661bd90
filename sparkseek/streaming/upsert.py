"""Key-value and merge-map state kept up to date from a stream.

`latest_stream` and `merge_stream` are streaming aggregations: state lives in the
state store, partial results are combined before the shuffle.  `upsert` writes
each micro-batch into a versioned snapshot: version N is a complete table, found
by its number, so a batch that runs again replaces the version it wrote.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkseek.operators import keyvalue


def latest_stream(log: DataFrame) -> DataFrame:
    """(key, seq, value, is_tombstone) of the newest record of each key; use output mode update or complete."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("seq", "value", "is_tombstone"), "seq").alias("r"))
    return newest.select("key", "r.*")


def merge_stream(ops: DataFrame) -> DataFrame:
    """Running sums by key."""
    return ops.groupBy("key").agg(F.sum("value").alias("value"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions in ascending order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [(s.getPath(), re.fullmatch(r"v(\d+)", s.getPath().getName())) for s in store.listStatus(root)]
    done = [int(m[1]) for p, m in names if m and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)


def snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (below a number), or None."""
    own = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v{own[-1]}") if own else None


def upsert(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply a stream of (key, seq, value, is_tombstone); tombstones stay until compacted by the reader."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        old = snapshot(batch.sparkSession, path, before=batch_id)
        rows = batch.select("key", "seq", "value", "is_tombstone")
        both = rows if old is None else old.unionByName(rows)
        latest_stream(both).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, seq, value) of the live keys of the newest version."""
    newest = snapshot(spark, path)
    return None if newest is None else keyvalue.latest(newest)
