"""What the training-data operators share: work folders, files and columns.

Work files live under ``spark.checkpoint.dir``, the one folder that driver and
executors share.  When it is unset a temporary folder is used if all runs in one
process (tests, a laptop), and on a cluster an error is raised.
Every write is to a new name and renamed when complete, so a task that runs
again after an executor was lost replaces its own file and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.sources import shared

_MADE: list[str] = []  # work folders of this process
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder as a full URI."""
    root = shared.shared_root(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = full.partition(":")
    return f"{scheme}://{rest.lstrip('/') if rest.startswith('//') else rest}".rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name, unique to this call, in the shared folder."""
    _MADE.append(f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete the work folders of this process.  Results that were not written yet are lost with them."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; used on executors and the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_file(uri: str, data) -> None:
    """Write bytes under a temporary name, then rename: complete or absent."""
    store, path = open_fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, path)


def read_file(uri: str):
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let no more rows than these be in an Arrow batch, for the rest of the session:
    batches of whole long texts are otherwise large native allocations, which the
    executors' JVM keeps."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Give freed memory back to the system; workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves no freed memory behind."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped
