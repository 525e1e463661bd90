"""Exact removal of repeated passages: every byte under a string of LENGTH bytes
that also starts in a document of a smaller id.

1. Anchors.  A window of LENGTH bytes is filed under the least hash among its
   K-byte pieces (its minimizer), so equal windows are filed alike and about one
   position in (LENGTH - K + 2) / 2 begins a new run of windows filed alike.
   Blocks of documents ask, for each distinct hash they hold, whether another
   document has it; runs of all other hashes repeat nowhere and are dropped.
2. Suffixes.  The bytes under a run that is left are a string.  Blocks send each
   distinct string once with the least id that has it.  Within a bucket of hashes,
   strings that have the bytes beside the piece in common are tied; what is tied,
   directly or through others, stays together, so a common piece in many
   surroundings falls apart.  Collections of such strings get their Burrows-Wheeler
   transform and common prefixes column by column (bwt.py).  Suffixes between which
   no common prefix is below LENGTH begin with the same window; the least id among
   them decides which windows of which string are repeats.
3. A block gets a bit per window back, and cuts.

A string of every copy but the least in a block is covered whole, so a passage
in a third of all documents costs one string per block.  Nothing is capped.
Windows are judged on the input, and never cross documents.

Null texts count as empty.  Texts shorter than LENGTH keep all.  Rows of one id
are one document to each other: neither repeats the other.  A null id is smaller
than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import blocks, bwt, common, lm

LENGTH = 50
K = 20
SIDE = (LENGTH - K) // 2
COLLECTION = 2048  # strings ordered together, unless more are tied to each other
BLOCK = 8 << 20  # bytes of text in a block
RUN = 64  # windows of one string at most; longer runs are cut
CHUNK = 1 << 20  # windows looked at together
NULL_ID = -(1 << 63)
SCHEMA = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block's texts end to end, where each begins, and their ids."""
    texts = table.column("text").combine_chunks().fill_null("").cast(pa.large_binary())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ids = table.column("doc_id").fill_null(NULL_ID).to_numpy()
    return data, offsets - offsets[0], ids


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each K-byte piece."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    n = len(data) - K + 1
    h = eight[:n] * a
    for at in (8, K - 8):
        h ^= h >> np.uint64(32)
        h *= b
        h += eight[at : at + n] * a
    h ^= h >> np.uint64(29)
    h *= b
    return h


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of each run; windows lie within documents."""
    found = []
    for a in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        b = min(a + CHUNK, len(data) - LENGTH + 1)
        least = _hashes(data[a : b + LENGTH - 1])
        width, span = LENGTH - K + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: b - a], least[width - span :][: b - a])
        low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b)
        sizes = np.diff(np.clip(offsets[low : high + 1], a, b))
        last = np.repeat(offsets[low + 1 : high + 1] - LENGTH, sizes)  # last window of the document at each byte
        inside = np.flatnonzero(np.arange(a, b) <= last)
        if not len(inside):
            continue
        value = least[inside]
        where = inside + a
        begins = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (where[1:] != where[:-1] + 1)]))
        size = np.diff(np.append(begins, len(inside)))
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(where[begins], parts) + nth * RUN
        n = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
        found.append((first, n, np.repeat(value[begins], parts)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _documents(first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, first, side="right") - 1


def _by_bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, hash), and where each bucket begins in it."""
    bucket = (hashes % np.uint64(n)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _distinct_hashes(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether two ids have one, and which one each is."""
    order = np.argsort(hashes)
    h, i = hashes[order], ids[order]
    new = np.concatenate([np.ones(min(len(h), 1), dtype=bool), h[1:] != h[:-1]])
    begins = np.flatnonzero(new)
    several = np.minimum.reduceat(i, begins) < np.maximum.reduceat(i, begins) if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), dtype=np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return h[begins], several, which


def ask_anchors(n_buckets: int):
    def question(uri: str, table: pa.Table) -> blocks.Packed:
        data, offsets, ids = joined(table)
        first, _, hashes = runs(data, offsets)
        known, several, _ = _distinct_hashes(hashes, ids[_documents(first, offsets)])
        order, at = _by_bucket(known, n_buckets)
        out = {}
        for b in range(n_buckets):
            own = order[at[b] : at[b + 1]]
            if len(own):
                out[b] = np.packbits(several[own]).tobytes() + known[own].astype("<u8").tobytes()
        return out

    return question


def _unpack_anchors(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) * 8 // 65
    flags = len(payload) - 8 * n
    return np.unpackbits(np.frombuffer(payload[:flags], np.uint8), count=n).astype(bool), np.frombuffer(payload[flags:], "<u8")


def answer_anchors(bucket: int, payloads: list[bytes]) -> list[bytes]:
    """A bit for each hash asked: another document may have it."""
    asked = [_unpack_anchors(p) for p in payloads]
    flat = np.concatenate([a[1] for a in asked])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    several = np.bincount(inverse, weights=np.concatenate([a[0] for a in asked]), minlength=len(count))[inverse] > 0 if len(flat) else shared
    ends = np.cumsum([len(a[1]) for a in asked])
    return [np.packbits(x).tobytes() for x in np.split(shared | several, ends[:-1])]


def _strings(table: pa.Table, answers: blocks.Packed, n_buckets: int):
    """The shared runs of a block and their distinct strings."""
    data, offsets, ids = joined(table)
    first, n, hashes = runs(data, offsets)
    known, _, which = _distinct_hashes(hashes, ids[_documents(first, offsets)])
    order, at = _by_bucket(known, n_buckets)
    shared = np.zeros(len(known), dtype=bool)
    for b, payload in answers.items():
        own = order[at[b] : at[b + 1]]
        shared[own] = np.unpackbits(np.frombuffer(payload, np.uint8), count=len(own)).astype(bool)
    keep = shared[which]
    first, n, hashes = first[keep], n[keep], hashes[keep]
    size = n + LENGTH - 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    flat = data[np.repeat(first - (ends - size), size) + np.arange(total)]
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat)])
    coded = strings.dictionary_encode()
    which = coded.indices.to_numpy()
    owner = ids[_documents(first, offsets)]
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    of = np.zeros(len(least), dtype=np.uint64)
    of[which] = hashes
    # every window of a copy in a later document than the block's first is a repeat
    later = owner > least[which]
    return first, n, which, later, coded.dictionary, least, of


def ask_strings(n_buckets: int):
    def question(uri: str, table: pa.Table, answers: blocks.Packed) -> blocks.Packed:
        first, n, which, later, strings, least, of = _strings(table, answers, n_buckets)
        common.write_file(f"{uri}-runs", lm.pack([x.astype(np.uint64) for x in (first, n, which, later, of)]))
        order, at = _by_bucket(of, n_buckets)
        out = {}
        for b in range(n_buckets):
            own = order[at[b] : at[b + 1]]
            if len(own):
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_arrays([strings.take(pa.array(own)), pa.array(least[own])], ["string", "id"])
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                    f.write_batch(batch)
                out[b] = sink.getvalue().to_pybytes()
        return out

    return question


def comparable(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that may share a window with another one, and the first string each is tied to.

    A window has SIDE bytes at least before or after the piece it is filed under.
    So two strings can only share one if they have the piece with SIDE bytes before
    it, or with SIDE bytes after it, in common.  A string is keyed by every place at
    which it has the piece: another one may share the surroundings of any of them."""
    n = len(starts) - 1
    hashes = _hashes(flat)
    lengths = np.diff(starts)
    of = np.repeat(np.arange(n), lengths - K + 1)
    at = np.arange(len(of)) + of * (K - 1)  # the piece's first byte in flat
    least = np.minimum.reduceat(hashes[at], np.cumsum(lengths - K + 1) - (lengths - K + 1))
    hit = hashes[at] == least[of]
    where, owner = at[hit], of[hit]
    ties = []
    eight = np.ndarray(len(flat), dtype="<u8", buffer=np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
    mult = np.uint64(0xBF58476D1CE4E5B9)
    for begin, fits in ((where - SIDE, where - SIDE >= starts[owner]), (where + K, where + K + SIDE <= starts[owner + 1])):
        own, a = owner[fits], begin[fits]
        key = (least[own] ^ (eight[a] * mult)) * mult
        key = (key ^ (key >> np.uint64(31)) ^ (eight[a + SIDE - 8] * mult)) * mult
        ties.append((own, np.unique(key, return_inverse=True)[1]))
    (a, ka), (b, kb) = ties
    owner, key = np.concatenate([a, b]), np.concatenate([ka, kb + (ka.max() + 1 if len(ka) else 0)])
    top, size = np.arange(n), np.bincount(key)
    owner, key = owner[size[key] > 1], key[size[key] > 1]
    some = np.zeros(n, dtype=bool)
    some[owner] = True
    while True:  # the least label of all that share a key, then that label's own label
        best = np.full(len(size), n)
        np.minimum.at(best, key, top[owner])
        new = top.copy()
        np.minimum.at(new, owner, best[key])
        new = new[new]
        if (new == top).all():
            return some, top
        top = new


def repeated_windows(flat: np.ndarray, starts: np.ndarray, least: np.ndarray, folder: str | None = None) -> np.ndarray:
    """For each window of each of the distinct strings, the least id of all strings that have it."""
    lengths = np.diff(starts)
    windows = lengths - LENGTH + 1
    some, tied = comparable(flat, starts)
    out = np.repeat(least, windows)  # a string that has nothing in common with another
    base = np.cumsum(windows) - windows
    own = np.flatnonzero(some)
    if not len(own):
        return out
    own = own[np.argsort(tied[own], kind="stable")]
    new = np.flatnonzero(np.concatenate([[True], tied[own][1:] != tied[own][:-1]]))
    # strings that are not tied share nothing: collections of about COLLECTION strings, cut between ties
    cuts = new[np.concatenate([[True], new[1:] // COLLECTION != new[:-1] // COLLECTION])]
    for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
        part = own[a:b]
        size, n = lengths[part], windows[part]
        ends = np.cumsum(size)
        symbols = flat[np.repeat(starts[:-1][part] - (ends - size), size) + np.arange(ends[-1])]
        places = np.repeat(base[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[places] = _ordered(symbols, np.append(0, ends), least[part], folder)
    return out


def _ordered(flat: np.ndarray, starts: np.ndarray, least: np.ndarray, folder: str | None) -> np.ndarray:
    windows = np.diff(starts) - LENGTH + 1
    base = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), dtype=np.int64)
    # 0 marks a begin in the transform; where texts hold it, bytes are numbered from 1
    if flat.all():
        return _least_by_suffix(flat, starts, least, base, out, 1, folder)
    values, codes = np.unique(flat, return_inverse=True)
    if len(values) < 256:
        return _least_by_suffix((codes + 1).astype(np.uint8), starts, least, base, out, 1, folder)
    wide = np.stack([(flat >> 4) + 1, (flat & 15) + 1], axis=1).ravel().astype(np.uint8)  # half bytes
    return _least_by_suffix(wide, 2 * starts, least, base, out, 2, folder)


def _least_by_suffix(flat, starts, least, base, out, unit, folder) -> np.ndarray:
    """Two passes over the columns: the least id of each run of suffixes that begin alike, then its windows."""
    columns = bwt.build(flat, starts, folder)
    lengths, none = np.diff(starts), np.iinfo(np.int64).max
    best, runs_ = [np.full(1, none)], 0
    for write in (False, True):
        if write:
            best = np.concatenate(best)
        runs_ = 0
        for rows in columns.chunks(bwt.CHUNK):
            run, length, who = runs_ + np.cumsum(rows["lcp"] < LENGTH * unit), rows["length"].astype(np.int64), rows["who"]
            whole = (length >= LENGTH * unit) & (length % unit == 0)
            at, who = run[whole], who[whole].astype(np.int64)
            if write:
                out[base[who] + (lengths[who] - length[whole]) // unit] = best[at]
            else:
                own = np.full(int(run[-1]) - runs_ + 1, none)
                np.minimum.at(own, at - runs_, least[who])
                best[-1][-1] = min(best[-1][-1], own[0])  # of the run that the last chunk left open
                best.append(own[1:] if len(own) > 1 else np.zeros(0, np.int64))
                best = [np.concatenate(best)] if len(own) == 1 else best
            runs_ = int(run[-1])
    columns.drop()
    return out


def answer_strings(folder: str):
    def reply(bucket: int, payloads: list[bytes]) -> list[bytes]:
        """Eight bytes for each string asked: bit w says that window w starts in a smaller document."""
        tables = [pa.ipc.open_stream(p).read_all() if p else None for p in payloads]
        real = [t for t in tables if t is not None]
        if not real:
            return [b"" for _ in payloads]
        both = pa.concat_tables(real).combine_chunks()
        coded = both.column("string").chunk(0).dictionary_encode()
        asked, strings = both.column("id").to_numpy(), coded.dictionary
        which = coded.indices.to_numpy()
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, asked)
        starts = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        flat = np.frombuffer(strings.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        smallest = repeated_windows(flat, starts - starts[0], least, f"{folder}/bucket-{bucket}")
        windows = np.diff(starts) - LENGTH + 1
        base = np.cumsum(windows) - windows
        each = windows[which]
        of = np.repeat(np.arange(len(which)), each)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        hit = smallest[base[which[of]] + nth] < asked[of]
        masks = np.zeros(len(which), dtype=np.uint64)
        np.bitwise_or.at(masks, of[hit], np.uint64(1) << nth[hit].astype(np.uint64))
        out, k = [], 0
        for t in tables:
            m = 0 if t is None else len(t)
            out.append(masks[k : k + m].astype("<u8").tobytes())
            k += m
        return out

    return reply


def finish(n_buckets: int, extra: tuple[str, ...] = ()):
    def cut(uri: str, table: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        data, offsets, _ = joined(table)
        first, n, which, later, of = lm.unpack(common.read_file(f"{uri}-runs").to_pybytes())
        first, n, which = (x.astype(np.int64) for x in (first, n, which))
        order, at = _by_bucket(of, n_buckets)
        masks = np.zeros(len(of), dtype=np.uint64)
        for b, payload in answers.items():
            masks[order[at[b] : at[b + 1]]] = np.frombuffer(payload, "<u8")
        own = np.where(later > 0, ~np.uint64(0), masks[which]) if len(which) else np.zeros(0, np.uint64)
        of_run = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of_run)) - np.repeat(np.cumsum(n) - n, n)
        hit = (own[of_run] >> nth.astype(np.uint64)) & np.uint64(1) > 0
        windows = first[of_run[hit]] + nth[hit]
        change = np.zeros(len(data) + 1, dtype=np.int8)  # a window begins once at a place, so LENGTH at most are open
        change[windows] += 1
        change[windows + LENGTH] -= 1
        gone = np.cumsum(change, dtype=np.int8)[: len(data)] > 0
        del change, windows, of_run, nth, hit
        rows = []
        for doc_id, a, b in zip(table.column("doc_id").to_pylist(), offsets, offsets[1:], strict=False):
            mine = gone[a:b]
            edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
            rows.append((doc_id, int(b - a), int(mine.sum()), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), data[a:b][~mine].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"]
        for a in range(0, len(rows), 1000):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1000], strict=True), kinds, strict=True)]
            more = [table.column(c).slice(a, 1000).combine_chunks() for c in extra]
            columns += [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in more]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, removed runs (starts, ends), kept bytes, extra columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    kept = blocks.write(rows, "suffix-blocks", BLOCK)
    shared = blocks.answer(kept, blocks.ask(kept, ask_anchors(kept.buckets)), answer_anchors)
    strings = blocks.resolve_and_ask(kept, shared, ask_strings(kept.buckets))
    masks = blocks.answer(kept, strings, answer_strings(kept.folder))
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return blocks.resolve(kept, masks, finish(kept.buckets, extra), SCHEMA + kinds)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
