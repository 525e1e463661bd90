"""Documents in blocks, and questions that blocks put to a hash-partitioned store.

A block is a run of documents of about BLOCK_BYTES, written once to the shared
folder.  An operator that needs a corpus-wide fact for each of a block's many
keys asks for all of them at once: `ask` lets every block send one row per
bucket of keys, `answer` sees a bucket's rows together and replies to each, and
`resolve` brings a block its replies beside its documents.  Keys are distinct
within a block, so a key that fills the corpus costs one entry per block, and
rows are a few packed arrays: what is shuffled is bytes, not records.

Block files are named anew by every attempt of a task and listed in a stored
table, so a task that runs again cannot change what others have read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkseek.llm import common, encoding

BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20  # of text for each bucket of keys
FEWEST, MOST = 64, 8192  # buckets
ZSTD = 6
ROW = "block long, uri string, bucket int, payload binary"
NAMES = ["block", "uri", "bucket", "payload"]

Packed = dict[int, bytes]  # bucket: payload


@dataclass
class Blocks:
    """table: a row per block (block, uri, docs, bytes)."""

    table: DataFrame
    folder: str
    n: int
    buckets: int


def write(docs: DataFrame, name: str, block_bytes: int | None = None) -> Blocks:
    """Write all columns in blocks, by the size of `text` (or binary); nulls as they are."""
    block_bytes = block_bytes or BLOCK_BYTES
    folder = common.work_dir(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0

        def done() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD))) as f:
                for b in held:
                    f.write_batch(b)
            block = (TaskContext.get().partitionId() << 24) + number
            uri = f"{folder}/{block}-{uuid.uuid4().hex[:8]}.arrow"
            common.write_file(uri, sink.getvalue())
            row = {"block": [block], "uri": [uri], "docs": [sum(len(b) for b in held)], "bytes": [size]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in encoding.slices(batch, limit=block_bytes // 2):
                part_bytes = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + part_bytes > block_bytes:
                    yield done()
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += part_bytes
        if held:
            yield done()

    table = common.stored(docs.mapInArrow(common.trimmed(run), "block long, uri string, docs long, bytes long"), name + "-list")
    n, size = table.selectExpr("count(*)", "coalesce(sum(bytes), 0)").first()
    return Blocks(table, folder, n, max(FEWEST, min(MOST, size // BUCKET_BYTES)))


def read(uri: str) -> pa.Table:
    return pa.ipc.open_file(common.read_file(uri)).read_all()


def _rows(block: int, uri: str, packed: Packed) -> pa.RecordBatch:
    n = len(packed)
    columns = [pa.array([block] * n, pa.int64()), pa.array([uri] * n), pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def ask(blocks: Blocks, question: Callable[[str, pa.Table], Packed]) -> DataFrame:
    """Rows of ROW: what each block asks each bucket; one that asks nothing sends an empty row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uri in zip(batch.column("block").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                yield _rows(block, uri, question(uri, read(uri)) or {0: b""})

    spread = blocks.table.select("block", "uri").repartition(max(1, blocks.n), "block")
    return spread.mapInArrow(common.trimmed(run), ROW)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Consecutive rows of one key, across batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer(blocks: Blocks, asked: DataFrame, reply: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """Rows of ROW: reply(bucket, payloads) gives an answer to each, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, "bucket"):
            for row, payload in zip(own, reply(own[0]["bucket"], [r["payload"] for r in own]), strict=True):
                yield _rows(row["block"], row["uri"], {row["bucket"]: payload})

    spread = asked.repartition(blocks.buckets, "bucket").sortWithinPartitions("bucket", "block")
    return spread.mapInArrow(common.trimmed(run), ROW)


def resolve(
    blocks: Blocks, answered: DataFrame, finish: Callable[[str, pa.Table, Packed], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """finish(file, documents, answers by bucket) for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, "block"):
            yield from finish(own[0]["uri"], read(own[0]["uri"]), {r["bucket"]: r["payload"] for r in own})

    spread = answered.repartition(max(1, blocks.n), "block").sortWithinPartitions("block", "bucket")
    return spread.mapInArrow(common.trimmed(run), schema)


def resolve_and_ask(blocks: Blocks, answered: DataFrame, question: Callable[[str, pa.Table, Packed], Packed]) -> DataFrame:
    """The next questions of every block, given the last answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, "block"):
            block, uri = own[0]["block"], own[0]["uri"]
            yield _rows(block, uri, question(uri, read(uri), {r["bucket"]: r["payload"] for r in own}) or {0: b""})

    spread = answered.repartition(max(1, blocks.n), "block").sortWithinPartitions("block", "bucket")
    return spread.mapInArrow(common.trimmed(run), ROW)


def gather(blocks: Blocks, answered: DataFrame, note: Callable[[Packed], list[int]]) -> DataFrame:
    """Write each block's answers to a file of its own, for use more than once.

    A stored row per block: block, uri, answers (the file), note(answers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, "block"):
            packed = {r["bucket"]: r["payload"] for r in own}
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], ["bucket", "payload"])
            with pa.ipc.new_file(sink, batch.schema) as f:
                f.write_batch(batch)
            uri = f"{own[0]['uri']}-answers-{uuid.uuid4().hex[:8]}"
            common.write_file(uri, sink.getvalue())
            row = {"block": [own[0]["block"]], "uri": [own[0]["uri"]], "answers": [uri], "note": pa.array([note(packed)], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(row)

    spread = answered.repartition(max(1, blocks.n), "block").sortWithinPartitions("block", "bucket")
    return common.stored(spread.mapInArrow(common.trimmed(run), "block long, uri string, answers string, note array<long>"), "answers")


def each(
    blocks: Blocks, gathered: DataFrame, finish: Callable[[str, pa.Table, Packed], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """finish(file, documents, answers by bucket) for every row of gather()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packed = read(row["answers"])
                answers = dict(zip(packed.column("bucket").to_pylist(), packed.column("payload").to_pylist(), strict=True))
                yield from finish(row["uri"], read(row["uri"]), answers)

    spread = gathered.select("block", "uri", "answers").repartition(max(1, blocks.n), "block")
    return spread.mapInArrow(common.trimmed(run), schema)
