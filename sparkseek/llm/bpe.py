"""Byte-level BPE with a two-tier lookup, and its decoding.

A text is cut by the vocabulary's pattern.  Tier one: a minimal perfect hash
(hash and displace: keys fall into buckets, a bucket of several keys has a
displacement that sends them to free slots, a bucket of one key names its slot)
finds whole pre-tokens that are in the vocabulary.  Tier two: all others are
merged over a linked list of byte spans, the lowest rank first and the leftmost
of equal ranks, from a heap whose stale entries are passed over; n bytes cost
O(n log n).  A worker remembers up to MEMO pre-tokens.

Null texts count as empty and give no ids.  Rows repeat as they come.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, encoding

MEMO = 500_000  # pre-tokens of up to MEMO_BYTES remembered by a worker
MEMO_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """n keys to 0..n-1, no slot empty; index(key) is -1 for any other key."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, dtype=np.int64).tolist()
        slots: list[bytes | None] = [None] * n
        inside: dict[int, list[bytes]] = {}
        for key in keys:
            inside.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        free = 0
        for bucket, own in sorted(inside.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                while slots[free] is not None:
                    free += 1
                self.shift[bucket] = -free - 1
                slots[free] = own[0]
                continue
            shift = 1
            while True:
                places = [self._place(k, shift) for k in own]
                if len(set(places)) == len(places) and all(slots[p] is None for p in places):
                    break
                shift += 1
            self.shift[bucket] = shift
            for p, k in zip(places, own, strict=True):
                slots[p] = k
        self.keys: list[bytes] = slots  # type: ignore[assignment]

    def _place(self, key: bytes, shift: int) -> int:
        return xxhash.xxh3_64_intdigest(key, shift) % self.n

    def index(self, key: bytes) -> int:
        if not self.n:
            return -1
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -shift - 1 if shift < 0 else self._place(key, shift) if shift else -1
        return slot if slot >= 0 and self.keys[slot] == key else -1


class BytePairCoder:
    """Encodes and decodes by a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.id_at = [ranks[k] for k in self.hash.keys]
        self.pattern = pattern
        self.bytes_of = {i: b for b, i in ranks.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the heap over linked bytes."""
        ranks, n = self.ranks, len(word)
        after = list(range(1, n + 1))  # where the span that begins here ends
        before = list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j, k = heappop(heap)
            if after[i] != j or j >= n or after[j] != k:
                continue
            after[i], after[j] = k, -1
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : after[k]])) is not None:
                    heappush(heap, (r, i, k, after[k]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:k])) is not None:
                heappush(heap, (r, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        slot = self.hash.index(word)
        return [self.id_at[slot]] if slot >= 0 else self.merge(word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._memo().__getitem__, self._findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _memo(self) -> _Memo:
        memo = self.__dict__.get("memo")
        if memo is None:
            memo = self.memo = _Memo(self)
            self._findall = regex.compile(self.pattern).findall
        elif len(memo) > MEMO:
            memo.clear()
        return memo

    def _findall(self, text: str) -> list[str]:  # replaced by the compiled pattern's own in _memo()
        raise AssertionError

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "_findall")}


class _Memo(dict):
    def __init__(self, coder: BytePairCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, token: str) -> bytes:
        word = token.encode("utf-8")
        ids = np.array(self.coder.encode_word(word), dtype="<u4").tobytes()
        if len(word) <= MEMO_BYTES:
            self[token] = ids
        return ids


_CODERS: dict[tuple[str, str], BytePairCoder] = {}


def coder_for(path: str, pattern: str) -> BytePairCoder:
    """One for each process, file and pattern; built in a second."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairCoder(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, pattern)
        for batch in batches:
            for part in encoding.slices(batch):
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.trimmed(run), "doc_id long, ids binary")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary) to doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, pattern)
        for batch in batches:
            for part in encoding.slices(batch, "ids"):
                texts = [coder.decode(b) for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(common.trimmed(run), "doc_id long, ids binary, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(common.table(spark, sf_dir, "documents"), path, public.PATTERN)
    return decode_documents(coded, path, public.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
