"""Posting-list codecs: sizes as SQL, bytes as numpy in Arrow batches (COD-1..8).

Sizes need no encoding: every codec's length is a formula of its numbers, so
accounting for an index is one aggregation.  The byte forms below round-trip.

Layouts: varint is LEB128.  A bit-packed stream is width (1 byte) and values,
most significant bit first.  PForDelta is a count (4 bytes), then blocks of up
to 128 values: width, count, exceptions (1 byte each), the low bits of all
values, and 5 bytes (place, value) for each exception; of the widths that leave
at most 32 exceptions the one with the fewest bytes is taken, the least on ties.
An optimal stream is tagged 0 (varint) or 1 (bit-packed), whichever is shorter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions.batches import runs

BLOCK = 128
EXCEPTIONS = 32


def bits(x: Column) -> Column:
    """Bits of a number of 0 or more; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def varint_bytes(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits(x) / 7)).cast("long")


def with_gaps(postings: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """COD-1: adds gap (from the term's previous document; the first as it is) and
    rank (from 0 within the term).

    A frequent term's list is cut by ranges of doc_id: windows run within
    (term, range), and a small table of each range's last document and size
    carries them over the seams.  No task holds a whole hot list."""
    cut = postings.withColumn("_part", F.floor(F.col("doc_id") / chunk))
    inner = Window.partitionBy("term", "_part").orderBy("doc_id")
    outer = Window.partitionBy("term").orderBy("_part")
    seams = cut.groupBy("term", "_part").agg(F.max("doc_id").alias("_last"), F.count("*").alias("_n"))
    seams = seams.select(
        "term", "_part", F.lag("_last", 1, 0).over(outer).alias("_before"), (F.sum("_n").over(outer) - F.col("_n")).alias("_start")
    )
    ranked = cut.withColumn("_prev", F.lag("doc_id").over(inner)).withColumn("_rank", F.row_number().over(inner) - 1)
    out = ranked.join(seams, ["term", "_part"])
    return out.withColumn("gap", F.col("doc_id") - F.coalesce("_prev", "_before")).withColumn(
        "rank", (F.col("_start") + F.col("_rank")).cast("long")
    ).drop("_part", "_prev", "_before", "_start", "_rank")


def block_sizes(gaps: DataFrame, by: str = "term", more: dict[str, Column] | None = None) -> DataFrame:
    """COD-2: a row per block of a list: values, varint bytes, widest value, PForDelta bytes; more sums if asked.

    PForDelta's need only how many values are longer than each width."""
    more = more or {}
    sized = gaps.select("*", F.floor(F.col("rank") / BLOCK).alias("block"), bits(F.col("gap")).alias("bits"))
    # a histogram of widths 0..32 in five sums: seven counts of up to BLOCK, eight bits each, in a long
    part = [F.when(F.floor(F.col("bits") / 7) == g, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bits") % 7 * 8).cast("int"))).otherwise(0) for g in range(5)]
    counted = sized.groupBy(by, "block").agg(
        F.count("*").alias("values"),
        F.sum(F.greatest(F.lit(1), F.ceil(F.col("bits") / 7))).cast("long").alias("varint"),
        F.max("bits").alias("widest"),
        *[F.sum(x).alias(f"h{g}") for g, x in enumerate(part)],
        *[x.alias(name) for name, x in more.items()],
    )
    # one walk over the widths from 32 down; at each, the values that are longer are known
    of_width = F.array(*[F.struct(F.lit(w).alias("width"), F.shiftright(f"h{w // 7}", w % 7 * 8).bitwiseAND(F.lit(255)).alias("n")) for w in range(32, -1, -1)])
    none = F.struct(F.lit(0).cast("long").alias("over"), F.lit(None).cast("long").alias("least"))

    def step(held: Column, of: Column) -> Column:
        cost = F.when(held["over"] <= EXCEPTIONS, 3 + F.ceil(F.col("values") * of["width"] / 8) + 5 * held["over"])
        return F.struct((held["over"] + of["n"]).alias("over"), F.least(held["least"], cost).alias("least"))  # skips nulls

    best = F.aggregate(of_width, none, step)["least"]
    return counted.select(by, "block", "values", "varint", "widest", best.alias("pfordelta"), *more)


def list_sizes(gaps: DataFrame) -> DataFrame:
    """A row per term: values and bytes of its document list by varint, bit packing and PForDelta."""
    return block_sizes(gaps).groupBy("term").agg(
        F.sum("values").alias("values"),
        F.sum("varint").alias("varint"),
        (1 + F.ceil(F.sum("values") * F.max("widest") / 8)).cast("long").alias("bitpack"),
        (4 + F.sum("pfordelta")).alias("pfordelta"),
    )


def breakdown(sizes: DataFrame) -> DataFrame:
    """COD-7: totals, and how often PForDelta wins, loses or ties against bit packing."""
    return sizes.agg(
        F.sum("varint").alias("varint_total"),
        F.sum("bitpack").alias("bitpack_total"),
        F.sum("pfordelta").alias("pfordelta_total"),
        F.sum(F.least("varint", "bitpack") + 1).alias("optimal_total"),
        F.count_if(F.col("pfordelta") < F.col("bitpack")).alias("wins"),
        F.count_if(F.col("pfordelta") > F.col("bitpack")).alias("losses"),
        F.count_if(F.col("pfordelta") == F.col("bitpack")).alias("ties"),
    )


# bytes
#
# Each codec takes many lists at once, one after another in a flat array, and their
# sizes: most terms are in one or two documents, and a call for each would cost more
# than its numbers.  Readers take the bytes and where each stream lies in them.


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - _begins(sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each list; 0 of an empty one."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _gaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first number of each list as it is, the others from the one before."""
    out, first = np.diff(values, prepend=0), _begins(sizes)[sizes > 0]
    out[first] = values[first]
    return out


def _from_gaps(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(gaps)])
    return total[1:] - np.repeat(total[_begins(sizes)], sizes)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), dtype=np.int64)
    left = v.astype(np.uint64).copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= np.uint64(1) << np.uint64(step)
        out[big] += step
        left[big] >>= np.uint64(step)
    return out + (left > 0)


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: int = 4) -> None:
    """Little-endian numbers of some bytes."""
    for k in range(width):
        out[at + k] = (values >> (8 * k)) & 255


def _number(data: np.ndarray, at: np.ndarray, width: int = 4) -> np.ndarray:
    return sum((data[at + k].astype(np.int64) << (8 * k) for k in range(width)), np.zeros(len(at), np.int64))


def _write_bits(v: np.ndarray, start: np.ndarray, width: np.ndarray, size: int) -> np.ndarray:
    """`size` bytes with each value at its first bit, most significant first."""
    out = np.zeros(8 * size, np.uint8)
    for j in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > j)
        out[start[on] + j] = (v[on] >> (width[on] - 1 - j).astype(np.uint64)) & np.uint64(1)
    return np.packbits(out)


def _read_bits(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    flat, out = np.unpackbits(data), np.zeros(len(start), np.uint64)
    for j in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > j)
        out[on] = out[on] << np.uint64(1) | flat[start[on] + j]
    return out


def _write_varint(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.maximum(1, -(-_bit_lengths(v) // 7))
    planes = np.arange(int(length.max(initial=1)))
    groups = (v[:, None] >> (7 * planes).astype(np.uint64)) & np.uint64(127)
    groups |= np.where(planes < length[:, None] - 1, np.uint64(128), np.uint64(0))
    return groups.astype(np.uint8)[planes < length[:, None]], _sums(length, sizes)


def _read_varint(data: np.ndarray, at: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    raw = data[_spans(at, size)]
    if (data[(at + size - 1)[size > 0]] & 128).any():
        raise ValueError("varint stream is cut off")
    if (_sums(raw < 128, size) != counts).any():
        raise ValueError("stream has a wrong length")
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _widest(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    out[sizes > 0] = np.maximum.reduceat(lengths, _begins(sizes)[sizes > 0]) if len(lengths) else 0
    return out


def _write_bitpack(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = _widest(_bit_lengths(v), sizes)
    size = 1 + -(-sizes * width // 8)
    at, each = _begins(size), np.repeat(width, sizes)
    place = np.arange(len(v)) - np.repeat(_begins(sizes), sizes)
    out = _write_bits(v, np.repeat(8 * (at + 1), sizes) + place * each, each, int(size.sum()))
    out[at] = width
    return out, size


def _read_bitpack(data: np.ndarray, at: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if (size < 1).any():
        raise ValueError("bit-packed stream has a wrong length")
    width = data[at].astype(np.int64)
    if (size != 1 + -(-counts * width // 8)).any():
        raise ValueError("bit-packed stream has a wrong length")
    place, each = np.arange(counts.sum()) - np.repeat(_begins(counts), counts), np.repeat(width, counts)
    return _read_bits(data, np.repeat(8 * (at + 1), counts) + place * each, each)


def _write_optimal(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (a, a_size), (b, b_size) = _write_varint(v, sizes), _write_bitpack(v, sizes)
    packed = b_size < a_size
    size = 1 + np.where(packed, b_size, a_size)
    at, out = _begins(size), np.zeros(int(size.sum()), np.uint8)
    out[at] = packed
    for own, data, each in ((~packed, a, a_size), (packed, b, b_size)):
        out[_spans(at[own] + 1, each[own])] = data[_spans(_begins(each)[own], each[own])]
    return out, size


def _read_optimal(data: np.ndarray, at: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if (size < 1).any() or (data[at] > 1).any():
        raise ValueError("unknown stream tag")
    out, begins = np.zeros(counts.sum(), np.uint64), _begins(counts)
    for tag, read in enumerate((_read_varint, _read_bitpack)):
        own = data[at] == tag
        out[_spans(begins[own], counts[own])] = read(data, at[own] + 1, size[own] - 1, counts[own])
    return out


def _write_pfordelta(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths, n = _bit_lengths(v), -(-sizes // BLOCK)
    if (lengths > 32).any():
        raise ValueError("PForDelta takes numbers below 2 ** 32")
    rank = np.arange(len(v)) - np.repeat(_begins(sizes), sizes)
    block, place = np.repeat(_begins(n), sizes) + rank // BLOCK, rank % BLOCK
    of_width = np.bincount(block * 33 + lengths, minlength=33 * int(n.sum())).reshape(-1, 33)
    values = of_width.sum(axis=1)
    over = values[:, None] - of_width.cumsum(axis=1)
    cost = 3 + -(-values[:, None] * np.arange(33) // 8) + 5 * over
    width = np.where(over <= EXCEPTIONS, cost, cost.max(initial=0) + 1).argmin(axis=1)
    odd = over[np.arange(len(width)), width]
    packed = -(-values * width // 8)
    each = 3 + packed + 5 * odd
    size = 4 + _sums(each, n)
    at = _begins(each) + 4 * (1 + np.repeat(np.arange(len(n)), n))
    low = v & ((np.uint64(1) << width[block].astype(np.uint64)) - np.uint64(1))
    out = _write_bits(low, 8 * (at[block] + 3) + place * width[block], width[block], int(size.sum()))
    _put(out, _begins(size), sizes)
    out[at], out[at + 1], out[at + 2] = width, values, odd
    rare = np.flatnonzero(lengths > width[block])
    own = block[rare]
    to = at[own] + 3 + packed[own] + 5 * (np.arange(len(rare)) - np.searchsorted(own, own))
    out[to] = place[rare]
    _put(out, to + 1, v[rare].astype(np.int64))
    return out, size


def _read_pfordelta(data: np.ndarray, at: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    cut_off, end = ValueError("PForDelta stream has a wrong length"), at + size
    if (size < 4).any() or (_number(data, at) != counts).any():
        raise cut_off
    out, begins = np.zeros(counts.sum(), np.uint64), _begins(counts)
    left, here, heads = np.arange(len(at)), at + 4, []
    done = np.zeros(len(at), np.int64)
    while len(left := left[done[left] < counts[left]]):  # the next block of all lists that have one
        p = here[left]
        if (p + 3 > end[left]).any():
            raise cut_off
        width, m, odd = (data[p + k].astype(np.int64) for k in range(3))
        heads.append((p, begins[left] + done[left], width, m, odd))
        done[left] += m
        here[left] = p + 3 + -(-m * width // 8) + 5 * odd
        if not m.all() or (here[left] > end[left]).any():
            raise cut_off
    if (done != counts).any() or (here != end).any():
        raise cut_off
    if heads:
        p, to, width, m, odd = (np.concatenate(x) for x in zip(*heads, strict=True))
        place, each = np.arange(m.sum()) - np.repeat(_begins(m), m), np.repeat(width, m)
        out[np.repeat(to, m) + place] = _read_bits(data, np.repeat(8 * (p + 3), m) + place * each, each)
        rare = _spans(np.zeros(len(p), np.int64), odd) * 5 + np.repeat(p + 3 + -(-m * width // 8), odd)
        out[np.repeat(to, odd) + data[rare]] = _number(data, rare + 1)
    return out


_WRITE = {"varint": _write_varint, "bitpack": _write_bitpack, "optimal": _write_optimal, "pfordelta": _write_pfordelta}
_READ = {"varint": _read_varint, "bitpack": _read_bitpack, "optimal": _read_optimal, "pfordelta": _read_pfordelta}


def _encode(codec: str, values: np.ndarray) -> bytes:
    return _WRITE[codec](np.asarray(values, dtype=np.uint64), np.array([len(values)]))[0].tobytes()


def _decode(codec: str, data: bytes, n: int) -> np.ndarray:
    return _READ[codec](np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), np.array([n]))


def encode_varint(values: np.ndarray) -> bytes:
    return _encode("varint", values)


def decode_varint(data: bytes) -> np.ndarray:
    return _decode("varint", data, int((np.frombuffer(data, np.uint8) < 128).sum()))


def encode_bitpack(values: np.ndarray) -> bytes:
    return _encode("bitpack", values)


def decode_bitpack(data: bytes, n: int) -> np.ndarray:
    return _decode("bitpack", data, n)


def encode_optimal(values: np.ndarray) -> bytes:
    return _encode("optimal", values)


def decode_optimal(data: bytes, n: int) -> np.ndarray:
    return _decode("optimal", data, n)


def encode_pfordelta(values: np.ndarray) -> bytes:
    return _encode("pfordelta", values)


def decode_pfordelta(data: bytes) -> np.ndarray:
    return _decode("pfordelta", data, struct.unpack_from("<I", data)[0])


CODECS = {
    "varint": (encode_varint, lambda data, n: decode_varint(data)),
    "bitpack": (encode_bitpack, decode_bitpack),
    "optimal": (encode_optimal, decode_optimal),
    "pfordelta": (encode_pfordelta, lambda data, n: decode_pfordelta(data)),
}
#: Container versions (COD-6): codecs of documents, frequencies and positions.
VERSIONS = {
    1: ("varint", "varint", "varint"),
    2: ("bitpack", "bitpack", "bitpack"),
    3: ("pfordelta", "bitpack", "bitpack"),
    4: ("pfordelta", "optimal", "optimal"),
}
_HEAD = 5  # of a container: documents (4 bytes), version; before each stream its bytes and numbers (4 each)


def encode_lists(docs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, flat: np.ndarray, version: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A container for each list of documents: all bytes, and the bytes of each.

    Documents of all lists, documents of each list, positions of each document, positions."""
    values = (_gaps(docs, sizes), counts, _gaps(flat, counts))
    numbers = (sizes, sizes, _sums(counts, sizes))
    streams = [_WRITE[codec](v.astype(np.uint64), n) for codec, v, n in zip(VERSIONS[version], values, numbers, strict=True)]
    whole = _HEAD + sum(8 + size for _, size in streams)
    at, out = _begins(whole), np.zeros(int(whole.sum()), np.uint8)
    _put(out, at, sizes)
    out[at + 4] = version
    at = at + _HEAD
    for (data, size), n in zip(streams, numbers, strict=True):
        _put(out, at, size)
        _put(out, at + 4, n)
        out[_spans(at + 8, size)] = data
        at = at + 8 + size
    return out, whole


def decode_lists(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four arrays that encode_lists() took."""
    at, end = _begins(whole), np.cumsum(whole)
    if (whole < _HEAD).any():
        raise ValueError("postings are cut off")
    sizes, versions = _number(data, at), data[at + 4]
    at = at + _HEAD
    found = []
    for k in range(3):
        if (at + 8 > end).any():
            raise ValueError("postings are cut off")
        size, counts = _number(data, at), _number(data, at + 4)
        if (at + 8 + size > end).any():
            raise ValueError("postings are cut off")
        out, begins = np.zeros(counts.sum(), np.int64), _begins(counts)
        for version in np.unique(versions):
            own = versions == version
            out[_spans(begins[own], counts[own])] = _READ[VERSIONS[int(version)][k]](data, at[own] + 8, size[own], counts[own]).astype(np.int64)
        found.append(out)
        at = at + 8 + size
    docs, counts, flat = found
    return _from_gaps(docs, sizes), sizes, counts, _from_gaps(flat, counts)


def encode_postings(docs: list[int], poss: list[list[int]], version: int = 4) -> bytes:
    """Documents and positions as gaps: n, version, three streams with their lengths and counts."""
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, dtype=np.int64) for p in poss)])
    counts = np.array([len(p) for p in poss], dtype=np.int64)
    return encode_lists(np.asarray(docs, dtype=np.int64), np.array([len(docs)]), counts, flat, version)[0].tobytes()


def decode_postings(data: bytes) -> tuple[list[int], list[list[int]]]:
    docs, _, counts, flat = decode_lists(np.frombuffer(data, np.uint8), np.array([len(data)]))
    return docs.tolist(), [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] if len(docs) else []


def encode_index(postings: DataFrame, version: int = 4, chunk: int = 1 << 14) -> DataFrame:
    """COD-6: (term, part, docs, code): a container for each term and range of doc_id,
    so that a frequent term is many rows.

    Lists come sorted, as rows: a task holds a batch and the container that it is in."""
    placed = postings.select("term", F.floor(F.col("doc_id") / chunk).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "poss")
    rows = placed.repartition("term", "part").sortWithinPartitions("term", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first = np.flatnonzero(_changes(whole))
            sizes = np.diff(np.append(first, len(whole)))
            poss = whole.column("poss")
            counts = np.diff(poss.offsets.to_numpy()).astype(np.int64)
            code, bytes_ = encode_lists(whole.column("doc_id").to_numpy(), sizes, counts, poss.flatten().to_numpy().astype(np.int64), version)
            ends = np.concatenate([[0], np.cumsum(bytes_)])
            codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(code)])
            names = [whole.column(c).take(pa.array(first)) for c in ("term", "part")]
            return pa.RecordBatch.from_arrays([*names, pa.array(sizes), codes.cast(pa.binary())], ["term", "part", "docs", "code"])

        held: list[pa.RecordBatch] = []  # the container that may go on in the next batch is the last of them
        for batch in batches:
            if not len(batch):
                continue
            last = int(np.flatnonzero(_changes(batch))[-1])
            if last:
                held.append(batch.slice(0, last))
            elif held and not all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("term", "part")):
                yield done(held)
                held = []
            if last:
                yield done(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    return rows.mapInArrow(run, "term string, part long, docs long, code binary")


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row is the first of its term and part."""
    out = np.ones(len(batch), dtype=bool)
    before, here = batch.slice(0, len(batch) - 1), batch.slice(1)
    out[1:] = np.logical_or(*(pc.not_equal(here.column(c), before.column(c)).to_numpy(zero_copy_only=False) for c in ("term", "part")))
    return out


BYTES_AT_ONCE = 1 << 19  # of containers decoded together


def decode_index(coded: DataFrame) -> DataFrame:
    """term, doc_id, tf, poss from encode_index()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.binary_length(whole.column("code")).to_numpy().astype(np.int64)
            for a, b in runs(lengths, BYTES_AT_ONCE):
                data = np.frombuffer(b"".join(whole.column("code").slice(a, b - a).to_pylist()), np.uint8)
                docs, sizes, counts, flat = decode_lists(data, lengths[a:b])
                poss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                terms = whole.column("term").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), sizes)))
                yield pa.RecordBatch.from_arrays([terms, pa.array(docs), pa.array(counts), poss], ["term", "doc_id", "tf", "poss"])

    return coded.select("term", "code").mapInArrow(run, "term string, doc_id long, tf long, poss array<int>")


def payload_bytes(postings: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """COD-8, SRC-11: a row per container version: its bytes for all postings, in KB too, and their share of plain ones.

    Lengths are formulas, so no list is held: a window gives the gaps of a container, and
    all versions are summed up in one pass over the postings; files.write_tsv writes the table."""
    order = Window.partitionBy("list").orderBy("doc_id")
    placed = postings.select(F.struct("term", F.floor(F.col("doc_id") / chunk).alias("part")).alias("list"), "doc_id", "poss")
    apart = F.transform("poss", lambda x, i: bits(x - F.when(i > 0, F.get("poss", i - 1)).otherwise(0)))
    rows = placed.select(
        "list",
        (F.col("doc_id") - F.lag("doc_id", 1, 0).over(order)).alias("gap"),
        (F.row_number().over(order) - 1).alias("rank"),
        F.size("poss").cast("long").alias("tf"),
        apart.alias("wide"),
    )
    varint_of = F.aggregate("wide", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(1), F.ceil(w / 7)))
    sums = {"positions": F.sum("tf"), "tf_varint": F.sum(varint_bytes(F.col("tf"))), "tf_widest": F.max(bits(F.col("tf"))), "pos_varint": F.sum(varint_of), "pos_widest": F.max(F.array_max("wide"))}
    blocks = block_sizes(rows, "list", sums)
    lists = blocks.groupBy("list").agg(*[(F.max if c.endswith("widest") else F.sum)(c).alias(c) for c in ("values", "varint", "widest", "pfordelta", *sums)])

    def packed(n: str, widest: str) -> Column:
        return 1 + F.ceil(F.col(n) * F.coalesce(widest, F.lit(0)) / 8)

    tf, pos = packed("values", "tf_widest"), packed("positions", "pos_widest")
    docs = 4 + F.when(F.col("widest") > 32, F.raise_error(F.lit("PForDelta takes numbers below 2 ** 32"))).otherwise(F.col("pfordelta"))
    best = 2 + F.least("tf_varint", tf) + F.least("pos_varint", pos)
    streams = {1: F.col("varint") + F.col("tf_varint") + F.col("pos_varint"), 2: packed("values", "widest") + tf + pos, 3: docs + tf + pos, 4: docs + best}
    plain = 4 * (2 * F.col("values") + F.col("positions"))  # four bytes for each document, count and position
    total = lists.agg(F.sum(plain).alias("plain"), *[F.sum((_HEAD + 3 * 8 + x).cast("long")).alias(f"v{n}") for n, x in streams.items()])
    each = total.select("plain", F.inline(F.array(*[F.struct(F.lit(n).alias("version"), F.coalesce(f"v{n}", F.lit(0)).alias("bytes")) for n in streams])))
    return each.select("version", "bytes", (F.col("bytes") / 1024).alias("kb"), F.expr("try_divide(bytes, plain)").alias("ratio"))
