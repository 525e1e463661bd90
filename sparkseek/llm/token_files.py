"""Token ids in Arrow files of fixed-size-list batches.

A part holds the ids of a range of documents in ascending id order, laid end to
end and cut into sequences of equal length.  ``ids-N.arrow`` (Arrow IPC file
format: a stream with a footer of batch offsets) has batches of SEQUENCES rows
with two columns, ``ids`` and ``mask``, both fixed-size lists; the mask is false
on the padding of the part's last sequence.  As every row has one size, sequence
i is batch i // SEQUENCES, row i % SEQUENCES: a slice of a memory-mapped buffer,
read without a copy.  ``docs-N.arrow`` says where each document begins.  Ids are
16-bit where the vocabulary allows, else 32-bit.

Writing takes one range shuffle of id and text.  A part is written under another
name and renamed, so a task may run twice.  The driver gathers one row per part
(its number of ids), whose running sum places the parts in the whole.

Null and empty texts have the end id alone.  Rows of one id are ordered by text.
An empty table makes no file and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, encoding

LENGTH = 2048
SEQUENCES = 64  # rows of a record batch
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class PartWriter:
    """Writes one part, holding no more than a batch of sequences."""

    def __init__(self, folder: str, number: int, kind: pa.DataType, length: int):
        self.folder, self.number, self.length, self.kind = folder, number, length, kind
        self.dtype = kind.to_pandas_dtype()
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.docs: list[tuple[list, np.ndarray, np.ndarray]] = []
        self.store, self.path = common.open_fs(f"{folder}/ids-{number:06d}.arrow")
        self.store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out = self.store.open_output_stream(self.temp)
        self.file = pa.ipc.new_file(self.out, schema(kind, length))

    def add(self, doc_ids: list, ids: np.ndarray, starts: np.ndarray) -> None:
        self.docs.append((doc_ids, starts[:-1] + self.total, np.diff(starts)))
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.total += len(ids)
        size = SEQUENCES * self.length
        if self.n_held >= size:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - size + 1, size):
                self._batch(flat[at : at + size], size)
            self.held = [flat[len(flat) // size * size :]]
            self.n_held = len(self.held[0])

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), dtype=bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema(self.kind, self.length)))

    def close(self) -> tuple[int, int]:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.file.close()
        self.out.close()
        self.store.move(self.temp, self.path)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, DOCS) as f:
            for doc_ids, starts, sizes in self.docs:
                f.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=DOCS))
        common.write_file(f"{self.folder}/docs-{self.number:06d}.arrow", sink.getvalue())
        return sum(len(d[0]) for d in self.docs), self.total


class Part:
    """Random access to a written part; local files are mapped, not read."""

    def __init__(self, folder: str, number: int):
        store, path = common.open_fs(f"{folder}/ids-{number:06d}.arrow")
        local = store.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.docs = pa.ipc.open_file(common.read_file(f"{folder}/docs-{number:06d}.arrow"))
        self._at, self._values = -1, np.empty(0)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """ids (a view of the mapped file) and mask of sequence i."""
        batch = self.file.get_batch(i // SEQUENCES)
        row = i % SEQUENCES
        ids, mask = (c.flatten() for c in batch.columns)
        return ids.to_numpy()[row * self.length : (row + 1) * self.length], mask.slice(row * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, over batches where need be."""
        size, found = SEQUENCES * self.length, []
        while n:
            if start // size != self._at:
                self._at = start // size
                self._values = self.file.get_batch(self._at).column(0).flatten().to_numpy()
            found.append(self._values[start % size : start % size + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, int, int, int]]:
    """Write the files; (part, documents, ids, ids in earlier parts) of each part."""
    from tokenizers import Tokenizer

    kind = pa.uint16() if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, encoding.chunk_encoder(tokenizer)
        for batch in batches:
            for part in encoding.slices(batch):
                writer = writer or PartWriter(folder, TaskContext.get().partitionId(), kind, length)
                writer.add(part.column("doc_id").to_pylist(), *encoder.encode(part.column("text"), end_id))
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [writer.number], "docs": [n_docs], "ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(tuple(r) for r in ranged.mapInArrow(common.trimmed(run), "part long, docs long, ids long").collect())  # a row per partition
    before, out = 0, []
    for number, n_docs, n_ids in parts:
        out.append((number, n_docs, n_ids, before))
        before += n_ids
    return out


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """A row per document: doc_id, start, ids as little-endian unsigned 32-bit."""
    kinds = [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                number, _, _, before = parts[i]
                part = Part(folder, number)
                for k in range(part.docs.num_record_batches):
                    doc_ids, starts, sizes = part.docs.get_batch(k).columns
                    ids = [part.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts.to_pylist(), sizes.to_pylist(), strict=True)]
                    columns = (doc_ids, pa.array(starts.to_numpy() + before), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "ids"])

    order = spark.range(0, len(parts), 1, max(1, len(parts)))
    return order.mapInArrow(common.trimmed(run), "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.work_dir(spark, "tokens")
    parts = write_tokens(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    ids = read_tokens(spark, folder, parts)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
