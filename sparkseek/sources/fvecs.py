"""Vector files in fvecs layout (SRC-3): an int32 dimension and that many float32, again and again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 64 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def dimension(uri: str) -> tuple[int, int]:
    """(dimension, whole vectors); a cut-off tail is not counted, an empty file is an error."""
    store, path = _open(uri)
    size = store.get_file_info(path).size
    if not size:
        raise ValueError(f"{uri} is empty")
    with store.open_input_file(path) as f:
        dim = int(np.frombuffer(f.read(4), "<i4")[0])
    if dim <= 0:
        raise ValueError(f"{uri} has dimension {dim}")
    return dim, size // (4 + 4 * dim)


def read(spark: SparkSession, uri: str, max_vectors: int | None = None) -> DataFrame:
    """(vec_id, embedding): every task reads its own byte range of whole records."""
    dim, n = dimension(uri)
    n = n if max_vectors is None else min(n, max_vectors)
    record = 4 + 4 * dim
    each = max(1, PART_BYTES // record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(uri)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first, last = part * each, min(n, (part + 1) * each)
                with store.open_input_file(path) as f:
                    f.seek(first * record)
                    raw = np.frombuffer(f.read((last - first) * record), "<i4").reshape(-1, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{uri} mixes dimensions")
                flat = pa.array(raw[:, 1:].copy().view("<f4").ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), lists], ["vec_id", "embedding"])

    parts = -(-n // each)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, "vec_id long, embedding array<float>")


def write(path: str, vectors: np.ndarray) -> None:
    """A small file from the driver, for tests and samples."""
    v = np.ascontiguousarray(vectors, dtype="<f4")
    head = np.full((len(v), 1), v.shape[1], dtype="<i4")
    np.concatenate([head, v.view("<i4")], axis=1).tofile(path)
