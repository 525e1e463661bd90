"""Full-text retrieval: tokens, positional index, boolean search and BM25 (IR-1..26).

A search needs, per document, the positions of the query's words.  Two stores
give them: `Scan` finds them in the tokens of each row, without a shuffle, and
suits one-off queries; `Index` reads stored postings, pruned to the query's
words by Parquet statistics (they are sorted by term).  Postings carry the length
of their document, and an index its corpus statistics, so a query that no document
without its words can satisfy reads neither the documents nor anything of other
words; others (NOT) are joined to all documents.  Both stores feed the same
compiled Column, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.batches import runs
from sparkseek.plans import compile as c
from sparkseek.plans import query as q
from sparkseek.sources import shared

TOKEN = r"[\p{L}\p{Nd}]+"
TOKENS_AT_ONCE = 1 << 17  # of documents whose postings are made together
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """IR-1: maximal runs of letters and decimal digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, title if there is one, tokens, n_tok."""
    title = ["title"] if "title" in docs.columns else []
    out = docs.select("doc_id", *title, tokens(F.col(text_col)).alias("tokens"))
    return out.withColumn("n_tok", F.size("tokens"))


def postings_of(batch: pa.RecordBatch, lengths: bool = False) -> Iterator[pa.RecordBatch]:
    """postings() of the documents of a batch, in runs of about TOKENS_AT_ONCE tokens."""
    for a, b in runs(np.diff(np.asarray(batch.column("tokens").offsets)), TOKENS_AT_ONCE):
        docs = batch.slice(a, b - a)
        lists = docs.column("tokens")
        words = lists.flatten().dictionary_encode()
        sizes = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * max(len(words.dictionary), 1) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), dtype=bool), key[1:] != key[:-1]]))
        offsets = np.append(begins, len(key)).astype(np.int32)
        first = pa.array(order[begins])
        more = [pa.array(sizes[row[order[begins]]].astype(np.int32))] if lengths else []
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.take(words.indices.take(first)),
                docs.column("doc_id").take(pa.array(row[order[begins]])),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[order].astype(np.int32))),
                *more,
            ],
            ["term", "doc_id", "tf", "poss", *["n_tok"][: len(more)]],
        )


def postings(tokenized_docs: DataFrame, lengths: bool = False) -> DataFrame:
    """IR-2: a row per term and document: tf and ascending positions; with n_tok of the document if asked.

    All tokens of a document are in its row, so its postings are made there, from
    sorted Arrow batches: building an index shuffles nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from postings_of(batch, lengths)

    kind = tokenized_docs.schema["doc_id"].dataType.simpleString()
    schema = f"term string, doc_id {kind}, tf long, poss array<int>" + (", n_tok int" if lengths else "")
    return tokenized_docs.select("doc_id", "tokens").mapInArrow(run, schema)


@dataclass
class Scan:
    """Position arrays straight from tokens."""

    docs: DataFrame  # doc_id, tokens, perhaps title

    def documents(self) -> DataFrame:
        return self.docs

    def positions(self, words: list[str], all_documents: bool = True) -> DataFrame:
        """n_tok and the places of each word, from one evaluation of the tokens.

        The columns are made by a generator: a filter on them stays above it, where
        one on a projection would be pushed below and compute the tokens again."""

        def of(tokens_: Column, word: str) -> Column:
            places = F.sequence(F.lit(0), F.size(tokens_) - 1)
            return F.filter(places, lambda i: F.get(tokens_, i) == F.lit(word))

        def row(t: Column) -> Column:
            none = F.array().cast("array<int>")
            each = [F.when(F.size(t) > 0, of(t, w)).otherwise(none).alias(f"p{i}") for i, w in enumerate(words)]
            return F.struct(F.size(t).alias("n_tok"), *each)

        kept = [x for x in self.docs.columns if x not in ("tokens", "n_tok")]
        return self.docs.select(*kept, F.inline(F.transform(F.array("tokens"), row)))

    def corpus(self, words: list[str]) -> DataFrame:
        """One row: n_docs, avgdl, and df0, df1, ... of the words."""
        df = [F.count_if(F.size(f"p{i}") > 0).alias(f"df{i}") for i in range(len(words))]
        return self.positions(words).agg(F.count("*").alias("n_docs"), F.avg("n_tok").alias("avgdl"), *df)


@dataclass
class Index:
    """Position arrays from a postings table and a documents table."""

    docs: DataFrame  # doc_id, n_tok, perhaps title
    postings: DataFrame  # term, doc_id, tf, poss, n_tok
    terms: DataFrame | None = None  # term, df, tf; with them what is known of the corpus need not be counted
    totals: tuple[int, float] | None = None  # documents, their mean length

    @staticmethod
    def build(docs: DataFrame, text_col: str = "text") -> Index:
        split = tokenized(docs, text_col)
        return Index(split.drop("tokens"), postings(split, lengths=True))

    def documents(self) -> DataFrame:
        return self.docs

    def positions(self, words: list[str], all_documents: bool = True) -> DataFrame:
        if not words:
            return self.docs
        none = F.array().cast("array<int>")
        picked = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("poss"))), none).alias(f"p{i}") for i, w in enumerate(words)]
        found = self.postings.filter(F.col("term").isin(words)).groupBy("doc_id").agg(F.max("n_tok").alias("n_tok"), *picked)
        if not all_documents:
            return found
        joined = self.docs.join(found.drop("n_tok"), "doc_id", "left")
        return joined.select(*self.docs.columns, *[F.coalesce(f"p{i}", none).alias(f"p{i}") for i in range(len(words))])

    def corpus(self, words: list[str]) -> DataFrame:
        """One row: n_docs, avgdl, and df0, df1, ... of the words."""
        if self.terms is None or self.totals is None:
            df = document_frequency(self.postings.filter(F.col("term").isin(words)))
            docs = self.docs.agg(F.count("*").alias("n_docs"), F.avg("n_tok").alias("avgdl"))
        else:
            df = self.terms.filter(F.col("term").isin(words))
            docs = df.sparkSession.range(1).select(F.lit(self.totals[0]).alias("n_docs"), F.lit(self.totals[1]).alias("avgdl"))
        each = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("df"))), F.lit(0)).alias(f"df{i}") for i, w in enumerate(words)]
        return docs.crossJoin(df.agg(*each, F.lit(0).alias("_"))).drop("_")  # one row each


Store = Scan | Index


def matches(store: Store, text: str) -> tuple[DataFrame, list[str]]:
    """Documents that satisfy the query, with position arrays p0, p1, ... of its words."""
    node = q.parse(text)
    words = q.all_words(node)
    at = {w: F.col(f"p{i}") for i, w in enumerate(words)}
    rows = store.positions(words, c.matches_without(node))
    return rows.filter(c.predicate(node, at.__getitem__, F.col("n_tok"))), words


def search(store: Store, text: str) -> DataFrame:
    """IR-17: doc_id of the documents that satisfy the query."""
    return matches(store, text)[0].select("doc_id")


def _scored(store: Store, text: str, k1: float, b: float) -> tuple[DataFrame, list[str]]:
    found, words = matches(store, text)
    positive = q.positive_words(q.parse(text))
    at = {w: F.col(f"p{i}") for i, w in enumerate(words)}
    stats = store.corpus(positive).withColumn("avgdl", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    found = found.crossJoin(F.broadcast(stats))  # one row

    def part(i: int, word: str) -> Column:
        tf = F.size(at[word]).cast("double")
        idf = F.ln(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_tok") / F.col("avgdl")))

    score = reduce(Column.__add__, [part(i, w) for i, w in enumerate(positive)], F.lit(0.0))
    return found.withColumn("score", score), positive


def bm25(store: Store, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """IR-16: doc_id and score of every match; order by score desc, doc_id for display."""
    return _scored(store, text, k1, b)[0].select("doc_id", "score")


def hit_lines(store: Store, text: str, rank: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """IR-24: doc_id, title, matched ("term×tf, ..." by term), total_tf, score (null if not ranked)."""
    found, positive = _scored(store, text, k1, b)
    if isinstance(store, Index) and "title" in store.docs.columns and "title" not in found.columns:
        found = found.join(store.docs.select("doc_id", "title"), "doc_id", "left")  # of the matches alone
    names = q.all_words(q.parse(text))
    hits = F.array(*[
        F.when(F.size(f"p{names.index(w)}") > 0, F.concat(F.lit(w + "×"), F.size(f"p{names.index(w)}").cast("string")))
        for w in sorted(positive)
    ]) if positive else F.array().cast("array<string>")
    total = reduce(Column.__add__, [F.size(f"p{names.index(w)}") for w in positive], F.lit(0))
    number = F.concat(F.lit("(doc "), F.col("doc_id").cast("string"), F.lit(")"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), number) if "title" in found.columns else number
    return found.select(
        "doc_id",
        title.alias("title"),
        F.array_join(F.array_compact(hits), ", ").alias("matched"),
        total.cast("long").alias("total_tf"),
        (F.col("score") if rank else F.lit(None).cast("double")).alias("score"),
    )


def top(scored: DataFrame, n: int) -> DataFrame:
    """IR-25: the best n, a bounded heap per task."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(n)


def document_frequency(index: DataFrame) -> DataFrame:
    """IR-19: df of every term."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def look_up(index: DataFrame, term: str) -> DataFrame:
    """IR-19: a term's postings; none for an unknown term."""
    return index.filter(F.col("term") == term).select("doc_id", "tf", "poss")


def statistics(docs: DataFrame, index: DataFrame) -> DataFrame:
    """IR-20..23: one row of counts, the mean length and a memory estimate.

    The estimate counts 4 bytes a position, 8 a posting and the bytes of each term."""
    d = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_tok"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("n_tok"), F.lit(0.0)).alias("avg_doc_len"))
    by_term = index.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    p = by_term.agg(
        F.count("*").alias("terms"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("postings"),
        F.coalesce(F.sum(F.octet_length("term") + 8 * F.col("n") + 4 * F.col("tf")), F.lit(0)).alias("raw_bytes"),
    )
    return d.crossJoin(F.broadcast(p))  # one row each


FORMAT, VERSION = "sparkseek-index", 2
_PARTS = ("docs", "postings", "terms")
_MOST_BYTES = 65_535  # of a term or a title


class IndexError_(ValueError):
    """What lies at a path is no index, or not a whole one."""


def _cut_title(title: Column) -> Column:
    """At most _MOST_BYTES of UTF-8, and no half of a character."""
    whole = F.octet_length(title) <= _MOST_BYTES
    raw = F.substring(title.cast("binary"), 1, _MOST_BYTES)
    # bytes 10xxxxxx at the end continue a character that begins up to three bytes before
    back = F.expr("0").cast("int")
    for n in (3, 2, 1):
        lead = F.conv(F.hex(F.substring(raw, _MOST_BYTES - n + 1, 1)), 16, 10).cast("int")
        back = F.when((lead >= 0xC0) & (F.when(lead >= 0xF0, 4).when(lead >= 0xE0, 3).otherwise(2) > n), n).otherwise(back)
    return F.when(whole, title).otherwise(F.substring(raw, F.lit(1), F.lit(_MOST_BYTES) - back).cast("string"))


def save_index(index: Index, path: str, partitions: int | None = None) -> None:
    """SRC-5: postings and term statistics sorted by term, so that row groups prune by it;
    titles cut to 65,535 bytes.  What was written is told last: without it there is no index."""
    spark = index.docs.sparkSession
    docs = index.docs
    if "title" in docs.columns:
        docs = docs.withColumn("title", _cut_title(F.col("title")))
    length = F.octet_length("term")
    checked = F.when(length > _MOST_BYTES, F.raise_error(F.lit(f"a term is longer than {_MOST_BYTES} bytes"))).otherwise(F.col("term"))
    by = ["term", "doc_id"]
    own = index.postings.withColumn("term", checked)
    ranged = own.repartitionByRange(partitions, *by) if partitions else own.repartitionByRange(*by)
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    terms = stored.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    terms = terms.repartitionByRange(partitions, "term") if partitions else terms.repartitionByRange("term")
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("docs"), F.coalesce(F.avg("n_tok"), F.lit(0.0)).alias("avg_doc_len"))
    sizes = [x for part in _PARTS for x in shared.content(spark, f"{path}/{part}")]
    told = total.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.array(*map(F.lit, sizes)).cast("array<long>").alias("content"), "docs", "avg_doc_len")
    told.write.mode("overwrite").json(f"{path}/about")


def open_index(spark: SparkSession, path: str) -> Index:
    """SRC-6: FileNotFoundError where there is nothing; IndexError_ where there is no index, one
    of another version, or one whose files are not those that were written."""
    shared.content(spark, path)
    try:
        about = spark.read.schema("format string, version int, content array<long>, docs long, avg_doc_len double").json(f"{path}/about").first()
    except AnalysisException as e:
        raise IndexError_(f"{path}: no index") from e
    if about is None or about.format != FORMAT:
        raise IndexError_(f"{path}: no index")
    if about.version != VERSION:
        raise IndexError_(f"{path}: an index of version {about.version}, not {VERSION}")
    try:
        found = [x for part in _PARTS for x in shared.content(spark, f"{path}/{part}")]
    except FileNotFoundError as e:
        raise IndexError_(f"{path}: {e} is missing") from e
    if found != about.content:
        raise IndexError_(f"{path}: files were cut or lost: {found}, written were {about.content}")
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in _PARTS), (about.docs, about.avg_doc_len))


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """IR-23: one row: raw_bytes (4 a position, 8 a posting, the bytes of terms), stored_bytes of the files, ratio."""
    index = open_index(spark, path)
    raw = index.terms.agg(F.coalesce(F.sum(F.octet_length("term") + 8 * F.col("df") + 4 * F.col("tf")), F.lit(0)).alias("raw_bytes"))
    size = sum(shared.content(spark, f"{path}/{part}")[1] for part in ("postings", "terms"))
    return raw.select("raw_bytes", F.lit(size).alias("stored_bytes"), F.expr("try_divide(stored_bytes, raw_bytes)").alias("ratio"))
