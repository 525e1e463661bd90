"""Hierarchical multi-length packing of token ids into training sequences.

A document is encoded and closed by an end id.  Its full windows of the longest
context size become sequences at once.  The rest is routed to the smallest tier
(context size) that holds it.  Within a pool of pieces the tiers are packed from
the longest down: a window begins with the longest piece of its tier, its gap
takes the longest piece of this or a shorter tier that fits, again and again,
and what gap is left is closed by cutting a piece of a shorter tier (or of its
own).  All windows are therefore full, their lengths powers of two, until a
partition ends; the few pieces left there are laid end to end and cut into
windows of falling size, so at most one sequence of a partition is padded.

Windows of a tier are gathered into slots of the longest size, and SLOTS slots
make a step group, so every group of a partition but its last has the same
number of tokens.

There is no shuffle: each partition of the input packs its own documents, and
ids of sequences and groups begin with the partition's number.  A task that runs
again emits whole documents only, so losing an executor loses nothing.  Memory
is bounded by POOL_TOKENS, one slice of text and one document.

Null and empty texts are one piece, the end id.  Rows repeat as they come, each
packed by itself.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, encoding

TIERS = (256, 512, 1024, 2048)
POOL_TOKENS = 2_000_000
SLOTS = 16  # slots of the longest size in a step group
SMALLEST = 64  # below it the last sequence of a partition is padded
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"

Piece = tuple[int, int, int]  # length, number of its document in the pool, start


class Packer:
    """Packs the documents of one partition; rows() hands over what is placed."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, slots: int = SLOTS):
        self.tiers, self.longest, self.slots = tiers, tiers[-1], slots
        self.base = partition << 40
        self.docs: dict[int, tuple[object, np.ndarray, int]] = {}  # doc_id, ids, pieces not yet placed
        self.next_doc = self.held = self.sequences = self.groups = self.in_group = 0
        self.pool: list[Piece] = []
        self.waiting: dict[int, list[list[Piece]]] = {t: [] for t in tiers}
        self.out: list[tuple] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        number = self.next_doc
        self.next_doc += 1
        self.docs[number] = (doc_id, ids, len(ids))
        full = len(ids) // self.longest * self.longest
        for start in range(0, full, self.longest):
            self._window(self.longest, [(self.longest, number, start)])
        if full < len(ids):
            self.pool.append((len(ids) - full, number, full))
            self.held += len(ids)
        if self.held >= POOL_TOKENS:
            self.pack()

    def pack(self) -> None:
        """Fill windows from the pool; pieces of an unfilled one stay in it."""
        rest, self.pool = sorted(self.pool), []
        for tier in reversed(self.tiers):
            below = self.tiers[self.tiers.index(tier) - 1] if tier > self.tiers[0] else 0
            while rest and rest[-1][0] > below:
                window = [rest.pop()]
                gap = tier - window[0][0]
                while gap and rest:
                    at = bisect_right(rest, (gap, 1 << 62, 0)) - 1
                    if at >= 0:
                        window.append(rest.pop(at))
                        gap -= window[-1][0]
                        continue
                    # all are longer than the gap: cut the one nearest in length
                    length, doc, start = rest.pop(0)
                    window.append((gap, doc, start))
                    insort(rest, (length - gap, doc, start + gap))
                    gap = 0
                if gap:
                    self.pool += window
                else:
                    self._window(tier, window)
        self.held = sum(p[0] for p in self.pool)

    def finish(self) -> None:
        """Lay what is left end to end, cut into windows of falling size."""
        self.pack()
        left, self.pool = self.pool, []
        size = self.longest
        while left:
            total = sum(p[0] for p in left)
            while size > total and size > SMALLEST:
                size //= 2
            window, gap = [], size
            while gap and left:
                length, doc, start = left.pop(0)
                if length > gap:
                    left.insert(0, (length - gap, doc, start + gap))
                window.append((min(length, gap), doc, start))
                gap -= min(length, gap)
            self._emit(size if not gap else self.longest, window)
        for tier, windows in self.waiting.items():
            for window in windows:
                self._emit(tier, window)
            windows.clear()

    def _window(self, tier: int, pieces: list[Piece]) -> None:
        """Windows wait until they fill a slot; full slots go to the open group."""
        self.waiting[tier].append(pieces)
        if len(self.waiting[tier]) * tier >= self.longest:
            for window in self.waiting[tier]:
                self._emit(tier, window)
            self.waiting[tier].clear()
            self.in_group += 1
            if self.in_group == self.slots:
                self.groups, self.in_group = self.groups + 1, 0

    def _emit(self, tier: int, pieces: list[Piece]) -> None:
        offset = 0
        for length, number, start in pieces:
            doc_id, ids, left = self.docs[number]
            cut = ids[start : start + length]
            self.out.append((doc_id, start, length, len(ids), self.base + self.sequences, offset, tier, self.base + self.groups, cut.tobytes()))
            offset += length
            if left == length:
                del self.docs[number]
            else:
                self.docs[number] = (doc_id, ids, left - length)
        self.sequences += 1

    def rows(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = list(zip(*self.out, strict=True)) if self.out else [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, slots: int = SLOTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, slots)
        encoder = encoding.chunk_encoder(tokenizer)
        for batch in batches:
            for part in encoding.slices(batch):
                ids, starts = encoder.encode(part.column("text"), end_id)
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), starts, starts[1:], strict=False):
                    packer.add(doc_id, ids[a:b].copy())
                if packer.out:
                    yield packer.rows()
                common.release_memory()
        packer.finish()
        if packer.out:
            yield packer.rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.trimmed(run), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
