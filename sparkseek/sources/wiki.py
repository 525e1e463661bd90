"""Wiki dumps as documents (SRC-1, SRC-2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.keyvalue import ranked

DEFAULTS = ("data/corpus.xml", "corpus.xml")
SCHEMA = "title string, revision struct<text: string>"


def corpus_path() -> str:
    """The first of CORPUS_XML, WIKI_XML and the default places that is set or there."""
    for name in ("CORPUS_XML", "WIKI_XML"):
        if value := os.environ.get(name, "").strip():
            return value
    return next((p for p in DEFAULTS if os.path.exists(p)), DEFAULTS[0])


def pages(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """doc_id (running number of the pages with text), title, text; both trimmed.

    Files are split by the XML reader; numbers follow file order, by ranks within
    ranges of the read order.  Pages without text are skipped, broken ones too."""
    raw = spark.read.format("xml").option("rowTag", "page").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)
    trimmed = raw.select(F.trim("title").alias("title"), F.trim("revision.text").alias("text"), F.monotonically_increasing_id().alias("at"))
    kept = trimmed.filter((F.col("text") != "") & F.col("text").isNotNull())
    numbered = ranked(kept, "at").select((F.col("rank") - 1).cast("long").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return numbered if max_docs is None else numbered.filter(F.col("doc_id") < max_docs)
