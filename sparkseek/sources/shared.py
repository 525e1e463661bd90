"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # by application


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder where none is named and all runs in one process.

    On a cluster that names none this fails: every executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sparkseek-")
    return _OWN[app]


def content(spark: SparkSession, path: str) -> tuple[int, int]:
    """(data files, bytes) below a path that Spark can open; FileNotFoundError where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(path)
    files, size, names = 0, 0, store.listFiles(at, True)
    while names.hasNext():
        f = names.next()
        if f.getPath().getName()[0] not in "._":
            files, size = files + 1, size + f.getLen()
    return files, size


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back, so that what follows sees one state of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
