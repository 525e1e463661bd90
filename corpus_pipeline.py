"""A training corpus from raw documents: five stages over the operators of sparkseek.llm.

Every stage takes (spark, docs, sf_dir), reads all rows its predecessor kept and
returns the columns of documents, but for the last, which returns packed pieces.
Only those columns are read, so others may have any names.  An empty table passes
every stage as one; rows with a null id are documents like others.
`run` writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, ngram_join, packing, quality, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a null text is scored as the empty one."""
    common.bound_batches(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, keep=tuple(COLUMNS))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a certified cutoff rejects.

    A null or empty text has fewer than 50 words and goes; equal rows all stay or all go."""
    common.bound_batches(spark)
    judged = quality.judge(docs, common.table(spark, sf_dir, "labels"), extra=tuple(c for c in COLUMNS if c != "doc_id"))
    return judged.filter("kept").select(*COLUMNS)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least id, a null id coming last.

    Texts without words are each a class of their own and stay; of equal rows one stays."""
    common.bound_batches(spark)
    classes = ngram_join.join_classes(docs.select("doc_id", "text"))
    firsts = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.xxhash64("doc_id", "text_hash").alias("row_key"))
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("row_key"))
    return keyed.join(firsts, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; those left empty go.

    A character that a cut would halve goes with it.  Texts that were null or empty before stay, as empty ones."""
    common.bound_batches(spark)
    cut = suffix_dedup.remove_repeats(docs, extra=("lang", "source"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"])

    rows = cut.select("doc_id", "lang", "source", "n_removed", "kept")
    texts = rows.mapInArrow(common.trimmed(decode), "doc_id long, lang string, source string, n_removed long, text string")
    left = texts.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids; a null text is the end id alone."""
    common.bound_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("ngram_join", stage_ngram_join),
    ("suffix_dedup", stage_suffix_dedup),
    ("packing", stage_packing),
]

#: Trained scores, minimizers and token ids are beyond SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
