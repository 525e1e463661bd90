"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Features are the character n-grams (ORDERS) of the lower-cased text with white
space runs as one space, hashed to 2 ** BITS bins and counted as present or not.
With p and q the smoothed shares of toxic and other training documents that have
a feature, r = ln(p / q) is its log-count ratio.  A logistic regression is
trained on features of value r (those with |r| >= MIN_RATIO in at least MIN_DOCS
documents; the others are left out) with an L2 penalty, and its score is moved
from the sample's share of toxic documents to that of all training labels.

The training set is a sample of at most PER_CLASS documents of each class, in
the order of a hash of their ids, one text for each id and none above MOST_CHARS
characters: the bounds hold the driver's memory.  Scoring
reads every text whole, in slices, and needs no shuffle.

Null texts count as empty and get the bias alone.  Without labels of both
classes every score is the smoothed share of toxic labels (0.5 if there are
none).  Labels that are null are ignored; of several, the highest holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, encoding

ORDERS = (3, 4, 5, 6)
BITS = 20
PER_CLASS = 3000
MOST_CHARS = 50_000  # of a text that is learned from; scored are texts of any length
MIN_RATIO = 2.0
MIN_DOCS = 3
ROUNDS = 200
L2 = 1e-3
THRESHOLD = 0.7
SCORED_BYTES = 1 << 20  # text scored at once: about 100 bytes of arrays for each
_SPACES = re.compile(r"\s+")


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bins of all n-grams of all texts, and their texts' numbers."""
    clean = [_SPACES.sub(" ", f" {t} ").lower() for t in texts]
    chars = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    h = chars
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            same = of[: len(h)] == of[n - 1 :] if len(h) else np.zeros(0, dtype=bool)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)[same], of[: len(h)][same]


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bin, text number) of the wanted bins, by text."""
    keys = []
    for bins, of in ngrams(texts):
        if wanted is not None:
            hit = wanted[bins]
            bins, of = bins[hit], of[hit]
        keys.append(np.unique((of.astype(np.int64) << BITS) | bins))
    key = np.unique(np.concatenate(keys))
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass
class Model:
    """weights: of each bin, the product of ratio and coefficient."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.wanted = np.zeros(1 << BITS, dtype=bool)
        self.wanted[self.bins] = True
        self.table = np.zeros(1 << BITS)
        self.table[self.bins] = self.weights

    def __reduce__(self):
        return Model, (self.bins, self.weights, self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        bins, of = present(texts, self.wanted)
        z = self.bias + np.bincount(of, weights=self.table[bins], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """share: of toxic documents among all training labels."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    found, held = [], []  # bins of 32 bits, and how many each text has
    for a in range(0, len(texts), 100):
        bins, of = present(texts[a : a + 100])
        for k in (0, 1):
            counts[k] += np.bincount(bins[toxic[of + a] == k], minlength=1 << BITS).astype(np.int32)
        found.append(bins.astype(np.int32))
        held.append(np.bincount(of, minlength=min(100, len(texts) - a)))
    ratio = np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2))
    use = (np.abs(ratio) >= MIN_RATIO) & (counts.sum(axis=0) >= MIN_DOCS)
    number = np.cumsum(use, dtype=np.int32) - 1
    columns, rows = [], []
    for i, (bins, n) in enumerate(zip(found, held, strict=True)):
        hit = use[bins]
        columns.append(number[bins[hit]])
        rows.append((100 * i + np.repeat(np.arange(len(n), dtype=np.int32), n))[hit])
        found[i] = bins[:0]
    column, row, r = np.concatenate(columns), np.concatenate(rows), ratio[use]
    value = r[column]
    w, b = np.zeros(len(r)), 0.0
    squares, b_square = np.full(len(r), 1e-8), 1e-8
    for _ in range(ROUNDS):  # adaptive gradient over the whole sample
        z = b + np.bincount(row, weights=value * w[column], minlength=len(texts))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) / len(texts)
        slope = np.bincount(column, weights=value * error[row], minlength=len(r)) + L2 * w / len(r)
        squares += slope**2
        w -= 0.05 * slope / np.sqrt(squares)
        b_slope = error.sum()
        b_square += b_slope**2
        b -= 0.05 * b_slope / np.sqrt(b_square)
    b += np.log(share / (1 - share)) - np.log(n1 / n0)
    return Model(np.flatnonzero(use), r * w, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows whose id's crc32 mod 3 is not 1."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (common.fold(id_col, 3) != 1))
    marks = marks.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("mark"))
    n, n1 = marks.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    order = F.xxhash64("doc_id", F.lit(10))
    sample = None
    for mark in (0, 1):
        part = marks.filter(F.col("mark") == mark).orderBy(order, "doc_id").limit(PER_CLASS)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    texts = texts.filter(F.length("text") <= MOST_CHARS).join(F.broadcast(sample), "doc_id")
    # one text for each id: 2 * PER_CLASS rows of MOST_CHARS characters at most
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("mark").alias("mark")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], np.array([r.mark for r in rows], dtype=np.int64), (n1 + 0.5) / (n + 1))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, score, and the columns of keep."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in keep if c not in (id_col, text_col)])
    names = [n for n in rows.columns if n != "text" or "text" in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in encoding.slices(batch, limit=SCORED_BYTES):
                scores = model.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(scores)], [*names, "score"])

    kept = rows.select(*names).schema.add("score", "double")
    return rows.mapInArrow(common.trimmed(run), kept)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_documents(docs, train(docs, labels))
    return scored.select(
        "doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
