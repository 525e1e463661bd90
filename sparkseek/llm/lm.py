"""Deleted interpolation: an n-gram language model that scores whole texts.

Tokens are the words of a text in ASCII lower case and an end token.  The model
mixes maximum-likelihood estimates of orders 3, 2 and 1, the last smoothed by
adding a half:

    p(w | u v) = l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 (c(w)+0.5)/(N+0.5(V+1))

The weights depend on how often the longest context that was seen at all was
seen: a bucket for each power of two of c(uv), or of c(v) where uv is new.  They
are learned by expectation-maximisation on held-out counts: training documents
of fold HELD_FOLD are scored with the counts of the other training folds, which
are "deleted" of them; all training folds make the final counts.

Counting and looking up are one exchange (blocks.py): every block asks for each
distinct n-gram it has once, sending its own counts along, and the store of a
bucket of n-grams adds them up and sends back what the others have, which is
mostly nothing.  Words are known by 64-bit hashes and longer n-grams by the upper
KEY_BITS of theirs, sent as compressed differences.  All are counted, none pruned.
The expectation step needs only how the estimates of orders 3 and 2 compare to
that of order 1, so the driver gathers one histogram of fixed size (bucket and
two ratios in STEPS per factor e) for all its rounds.

Null texts count as empty: the end token alone.  Rows of one id count as often
as they come; a null id hashes as the empty text.  An empty table gives no rows,
and without training documents every estimate is the smoothed one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import blocks, common, shingles

ORDER = 3
KEY_BITS = 56  # of the hash of an n-gram of two words or more; one pair in 2 ** 56 is taken for the same
FOLDS, TEST_FOLD, HELD_FOLD = 5, 1, 4
END = np.uint64(0x51ED270B7A14E3C5)
STEPS = 4  # histogram steps for a factor e
NONE = -9999  # ratio of an estimate that is 0
WIDEST = 40  # ratios beyond e ** WIDEST share a step
ROUNDS = 100
CHUNK = 1 << 18  # tokens whose estimates are held at once
_A = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by END, and where each text begins."""
    words, starts = shingles.word_hashes(pc.ascii_lower(texts.fill_null("")))
    flat = np.insert(words, starts[1:], END)
    return flat, starts + np.arange(len(starts))


def ngrams(flat: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the 1-, 2- and 3-gram that end at each token; END stands before a text."""
    before = rolled = flat
    yield shingles.mix(flat + np.uint64(1))
    for order in range(2, ORDER + 1):
        before = np.concatenate([[END], before[:-1]])
        before[starts[:-1]] = END
        rolled = rolled + before * _A ** np.uint64(order - 1)
        yield shingles.mix(rolled + np.uint64(order)) >> np.uint64(64 - KEY_BITS) << np.uint64(64 - KEY_BITS)


def folds(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids.to_pylist()], dtype=np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned numbers by byte planes, without planes of zeros, compressed."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T
        used = [i for i in range(8) if planes[i].any()]
        out.append(np.array([len(x), sum(1 << i for i in used)], dtype="<u8").tobytes())
        out += [planes[i].tobytes() for i in used]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, mask = np.frombuffer(raw, "<u8", 2, at).tolist()
        at += 16
        planes = np.zeros((n, 8), dtype=np.uint8)
        for i in range(8):
            if mask >> i & 1:
                planes[:, i] = np.frombuffer(raw, np.uint8, n, at)
                at += n
        out.append(planes.view("<u8").ravel())
    return out


FEW = 16  # counts below it share a byte


def pack_counts(n_train: np.ndarray, n_held: np.ndarray) -> list[np.ndarray]:
    """A byte of both counts where both are small; the others beside it."""
    many = np.flatnonzero(n_train >= FEW)
    code = (n_train | n_held * np.uint32(FEW)).astype(np.uint8)
    code[many] = 0
    return [code, np.diff(many, prepend=0), n_train[many], n_held[many]]


def unpack_counts(code: np.ndarray, gaps: np.ndarray, n_train: np.ndarray, n_held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    train, held = code & np.uint64(FEW - 1), code >> np.uint64(FEW.bit_length() - 1)
    many = np.cumsum(gaps).astype(np.int64)
    train[many], held[many] = n_train, n_held
    return train, held


def _edges(n_buckets: int) -> np.ndarray:
    """First key of each bucket: equal ranges of the hash."""
    return np.array([-(-(i << 64) // n_buckets) for i in range(n_buckets)], dtype=np.uint64)


class _Block:
    """Tokens of a block, and for each order its distinct n-grams, which one ends at
    each token, and how many training and held-out tokens of its own each has."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id")
        self.flat, self.starts = tokens(table.column("text").combine_chunks())
        self.fold = folds(self.ids)
        of = np.repeat(self.fold, np.diff(self.starts))
        self.keys, self.at, self.own = [], [], []
        for k in ngrams(self.flat, self.starts):
            u, at = np.unique(k, return_inverse=True)
            del k
            self.keys.append(u)
            self.at.append(at.astype(np.int32))
            self.own.append([np.bincount(at[of != TEST_FOLD], minlength=len(u)).astype(np.uint32), np.bincount(at[of == HELD_FOLD], minlength=len(u)).astype(np.uint32)])


def ask_counts(n_buckets: int):
    edges = _edges(n_buckets)

    def question(uri: str, table: pa.Table) -> blocks.Packed:
        b = _Block(table)
        b.at = []
        cuts = [np.append(np.searchsorted(keys, edges), len(keys)) for keys in b.keys]
        out = {}
        for i in range(n_buckets):
            arrays = []
            for order, (cut, keys, (n_train, n_held)) in enumerate(zip(cuts, b.keys, b.own, strict=True)):
                own = slice(cut[i], cut[i + 1])
                gaps = np.diff(keys[own], prepend=np.uint64(0))
                arrays += [gaps >> np.uint64(64 - KEY_BITS) if order else gaps, *pack_counts(n_train[own], n_held[own])]
            out[i] = pack(arrays)
        return out

    return question


def answer_counts(bucket: int, payloads: list[bytes]) -> list[bytes]:
    """For each n-gram asked, what others have; first the bucket's distinct, training and held-out tokens."""
    asked = [unpack(p) if p else [np.zeros(0, np.uint64)] * (5 * ORDER) for p in payloads]
    replies: list[list[np.ndarray]] = [[] for _ in payloads]
    head = [0, 0, 0]
    for order in range(ORDER):
        parts = [a[5 * order : 5 * order + 5] for a in asked]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]  # order 2 and 3: of KEY_BITS
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        for which, own in enumerate(map(np.concatenate, zip(*(unpack_counts(*p[1:]) for p in parts), strict=True))):
            sums = np.bincount(at, weights=own, minlength=len(u)).astype(np.uint64)
            if order == 0:
                head = [int((sums > 0).sum()), int(sums.sum()), 0] if which == 0 else [*head[:2], int(sums.sum())]
            for reply, part in zip(replies, np.split(sums[at] - own, ends), strict=True):
                reply.append(part)
    lead = b"".join(x.to_bytes(8, "big") for x in head)
    return [lead + pack(r) for r in replies]


def _totals(answers: blocks.Packed) -> list[int]:
    """V, N, and the tokens of the held fold, from the heads of all buckets' answers."""
    return [sum(int.from_bytes(p[8 * i : 8 * i + 8], "big") for p in answers.values()) for i in range(3)]


def _counts(b: _Block, answers: blocks.Packed, which: int) -> list[np.ndarray]:
    """For each order, training (0) or held-out (1) counts of the distinct n-grams."""
    parts = [[] for _ in range(ORDER)]
    for i in sorted(answers):
        others = unpack(answers[i][24:])
        for order in range(ORDER):
            parts[order].append(others[2 * order + which].astype(np.uint32))
    return [b.own[o][which] + np.concatenate(parts[o]) for o in range(ORDER)]


def _estimates(b: _Block, counts: list[np.ndarray], own: np.ndarray):
    """Counts of the n-grams of the wanted tokens by order, and of their contexts.

    A token's contexts are the n-grams that end at the token before it; at a
    text's begin it is END, which stands before each text."""
    first = np.isin(own, b.starts[:-1], assume_unique=True)
    n_docs = counts[0][b.at[0][b.starts[1] - 1]]
    seen = [c[at[own]].astype(np.float64) for c, at in zip(counts, b.at, strict=True)]
    context = [np.where(first, n_docs, c[at[own - 1]]).astype(np.float64) for c, at in zip(counts[:-1], b.at, strict=False)]
    return seen, context


def _chunks(own: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(own), CHUNK):
        yield own[a : a + CHUNK]


def bucket_of(context: list[np.ndarray]) -> np.ndarray:
    """By the longest seen context: 1 + log2 of its count, plus 64 for order 3; 0 if none."""
    v, uv = context
    log = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1
    return np.where(uv > 0, 64 + log(uv), np.where(v > 0, log(v), 0))


def _mixture_inputs(seen, context, n: float, v: float):
    c1, c2, c3 = seen
    base = (c1 + 0.5) / (n + 0.5 * (v + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(context[0] > 0, c2 / context[0], 0)
        p3 = np.where(context[1] > 0, c3 / context[1], 0)
    return base, p2, p3


def held_out_histogram(v: int, n: int):
    def run(uri: str, table: pa.Table, answers: blocks.Packed) -> Iterator[pa.RecordBatch]:
        b = _Block(table)
        wanted = np.flatnonzero(np.repeat(b.fold == HELD_FOLD, np.diff(b.starts)))
        if not len(wanted):
            return
        kept = [total - held for total, held in zip(_counts(b, answers, 0), _counts(b, answers, 1), strict=True)]
        for own in _chunks(wanted):
            seen, context = _estimates(b, kept, own)
            base, p2, p3 = _mixture_inputs(seen, context, n, v)
            steps = []
            for p in (p3, p2):
                with np.errstate(divide="ignore"):
                    r = np.round(STEPS * np.clip(np.log(p / base), -WIDEST, WIDEST))
                steps.append(np.where(p > 0, r, NONE).astype(np.int64))
            cells = np.stack([bucket_of(context), *steps], axis=1)
            u, tally = np.unique(cells, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(u[:, 2]), pa.array(tally)], ["bucket", "r3", "r2", "n"])

    return run


def learn_weights(cells: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, float, float]]:
    """EM in each bucket: weights of orders 3, 2, 1; a token in each is assumed beside the held-out ones."""
    out = {}
    table = np.array(cells, dtype=np.float64).reshape(-1, 4)
    for bucket in np.unique(table[:, 0]):
        own = table[table[:, 0] == bucket]
        ratio = np.where(own[:, 1:3] == NONE, 0, np.exp(own[:, 1:3] / STEPS))
        p = np.column_stack([ratio, np.ones(len(own))])
        weights = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = share.T @ own[:, 3] + 1
            weights /= weights.sum()
        out[int(bucket)] = tuple(weights)
    return out


def scores(v: int, n: int, weights: dict[int, tuple[float, float, float]]):
    table = np.tile([0.0, 0.0, 1.0], (160, 1))
    for bucket, w in weights.items():
        table[bucket] = w
    # a bucket that no held-out token met takes the weights of the one below it
    for low in (0, 64):
        for i in range(low + 1, low + 64):
            if i not in weights and i > low + 1:
                table[i] = table[i - 1]

    def run(uri: str, data: pa.Table, answers: blocks.Packed) -> Iterator[pa.RecordBatch]:
        b = _Block(data)
        counts = _counts(b, answers, 0)
        base_log, score_log, known = np.empty(len(b.flat)), np.empty(len(b.flat)), np.empty(len(b.flat), dtype=bool)
        for own in _chunks(np.arange(len(b.flat))):
            seen, context = _estimates(b, counts, own)
            base, p2, p3 = _mixture_inputs(seen, context, n, v)
            w = table[bucket_of(context)]
            # weights of an order whose context is new go to the others
            w = w * np.column_stack([context[1] > 0, context[0] > 0, np.ones(len(base), bool)])
            w /= w.sum(axis=1, keepdims=True)
            base_log[own], score_log[own] = np.log10(base), np.log10(w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * base)
            known[own] = seen[0] > 0
        at = b.starts[:-1]
        columns = [
            b.ids.combine_chunks(),
            pa.array(b.fold == TEST_FOLD),
            pa.array(np.diff(b.starts)),
            pa.array(np.add.reduceat(known.astype(np.int64), at)),
            pa.array(np.full(len(at), n)),
            pa.array(np.add.reduceat(base_log, at)),
            pa.array(np.add.reduceat(score_log, at)),
        ]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document; held_out marks those that the model did not see."""
    held = blocks.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "lm-blocks")
    answered = blocks.answer(held, blocks.ask(held, ask_counts(held.buckets)), answer_counts)
    answers = blocks.gather(held, answered, _totals)  # every block asks every bucket, so all have the same totals
    row = answers.select("note").first()
    v, n, n_held = row.note if row else (0, 0, 0)
    found = blocks.each(held, answers, held_out_histogram(v, n - n_held), "bucket long, r3 long, r2 long, n long")
    cells = found.groupBy("bucket", "r3", "r2").agg(F.sum("n").alias("n")).collect()  # as many as the grid has at most
    return blocks.each(held, answers, scores(v, n, learn_weights([tuple(r) for r in cells])), SCHEMA)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
