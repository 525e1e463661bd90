"""Text queries: tokens, postings, the query language, BM25, set operations."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.catalog.common import table
from sparkseek.operators import sets
from sparkseek.operators import text as t
from sparkseek.sources import shared

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
DOCS = f"d AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents)"
EACH = f"{DOCS}, e AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d)"

SEARCHES = {
    "bool_term": "the",
    "bool_and": "the AND of AND in",
    "bool_or": "que OR thereof OR by",
    "bool_not": "NOT the",
    "bool_complex": "(the OR of) AND NOT (que OR NEAR(3, by, in)) AND NOT LAST(to)",
    "near": "NEAR(4, the, of)",
    "adj": "ADJ(of, the)",
    "msm": "MSM(12, the, the, of, to)",
    "first": "FIRST(the)",
    "last": "LAST(the)",
}
STORED = ("bool_term", "bool_and", "bool_not", "bool_complex", "near", "adj", "msm", "first", "last")
RANKED = "(the OR of) AND NOT que"


def _scan(spark: SparkSession, d: str) -> t.Scan:
    """Without an index: every query of this kind reads all texts."""
    return t.Scan(t.tokenized(table(spark, d, "documents")))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return t.postings(t.tokenized(table(spark, d, "documents")))


def _has(word: str) -> str:
    return f"list_contains(t, '{word}')"


def _at(word: str) -> str:
    return f"list_filter(range(len(t)), lambda i: t[i + 1] = '{word}')"


def _near(k: int, a: str, b: str) -> str:
    return f"len(list_filter({_at(a)}, lambda x: len(list_filter({_at(b)}, lambda y: abs(x - y) <= {k})) > 0)) > 0"


_WINDOW = "list_filter(t[x + 1 : x + 13], lambda w: w = '{}')"
_CONDITIONS = {
    "bool_term": _has("the"),
    "bool_and": f"{_has('the')} AND {_has('of')} AND {_has('in')}",
    "bool_or": f"{_has('que')} OR {_has('thereof')} OR {_has('by')}",
    "bool_not": f"NOT {_has('the')}",
    "bool_complex": f"({_has('the')} OR {_has('of')}) AND NOT ({_has('que')} OR {_near(3, 'by', 'in')}) AND NOT (len(t) > 0 AND t[len(t)] = 'to')",
    "near": _near(4, "the", "of"),
    "adj": "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0",
    "msm": "len(list_filter(range(len(t)), lambda x: t[x + 1] IN ('the', 'of', 'to')"
    f" AND len({_WINDOW.format('the')}) >= 2 AND len({_WINDOW.format('of')}) >= 1 AND len({_WINDOW.format('to')}) >= 1)) > 0",
    "first": "len(t) > 0 AND t[1] = 'the'",
    "last": "len(t) > 0 AND t[len(t)] = 'the'",
}


def _search(text: str):
    return lambda spark, d: t.search(_scan(spark, d), text)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return t.bm25(_scan(spark, d), RANKED).select("doc_id", F.round("score", 6).alias("score"))


def _bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """From postings that are made for this query alone."""
    return t.bm25(t.Index.build(table(spark, d, "documents")), RANKED).select("doc_id", F.round("score", 6).alias("score"))


def stored_index(spark: SparkSession, d: str) -> t.Index:
    """The stored index of documents, written once for each application and table."""
    path = f"{shared.shared_root(spark)}/text-index-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    try:
        return t.open_index(spark, path)
    except (FileNotFoundError, t.IndexError_):
        t.save_index(t.Index.build(table(spark, d, "documents")), path)
    return t.open_index(spark, path)


def _stored(text: str):
    return lambda spark, d: t.search(stored_index(spark, d), text)


def _bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    return t.bm25(stored_index(spark, d), RANKED).select("doc_id", F.round("score", 6).alias("score"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    split = t.tokenized(table(spark, d, "documents"))
    return t.statistics(split, t.postings(split)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _scan(spark, d)
    return t.search(s, "the OR que"), t.search(s, "of AND in")


QUERIES = {
    "tokens": lambda s, d: t.tokenized(table(s, d, "documents")).select("doc_id", F.posexplode("tokens").alias("pos", "term")),
    "postings": lambda s, d: _index(s, d).select("term", "doc_id", "tf", F.array_join(F.col("poss").cast("array<string>"), ",").alias("poss")),
    "term_df": lambda s, d: t.document_frequency(_index(s, d)),
    "doc_len": lambda s, d: t.tokenized(table(s, d, "documents")).select("doc_id", F.col("n_tok").cast("long").alias("n_tok")),
    "index_stats": _stats,
    **{name: _search(text) for name, text in SEARCHES.items()},
    "bm25": _bm25,
    "bm25_indexed": _bm25_indexed,
    "bm25_stored": _bm25_stored,
    **{f"{name}_stored": _stored(SEARCHES[name]) for name in STORED},
    "hit_lines_stored": lambda s, d: t.hit_lines(stored_index(s, d), RANKED).withColumn("score", F.round("score", 6)),
    "term_df_stored": lambda s, d: stored_index(s, d).terms.select("term", "df"),
    "look_up": lambda s, d: t.look_up(stored_index(s, d).postings, "of").withColumn("poss", F.array_join(F.col("poss").cast("array<string>"), ",")),
    "set_uniq": lambda s, d: t.tokenized(table(s, d, "documents")).select("doc_id", F.array_join(sets.first_seen(F.col("tokens")), " ").alias("terms")),
    "bm25_topk": lambda s, d: t.top(t.bm25(_scan(s, d), RANKED).select("doc_id", F.round("score", 6).alias("score")), 20),
    "hit_lines": lambda s, d: t.hit_lines(_scan(s, d), RANKED).withColumn("score", F.round("score", 6)),
    "set_intersect": lambda s, d: sets.intersection(*_two(s, d)),
    "set_union": lambda s, d: sets.union(*_two(s, d)),
    "set_except": lambda s, d: sets.difference(*_two(s, d)),
}

_TF = "len(list_filter(t, lambda w: w = '{}'))"
_IDF = "ln(1 + (n - {0} + 0.5e0) / ({0} + 0.5e0))"
_PART = "{idf} * {tf} * 2.2e0 / ({tf} + 1.2e0 * (0.25e0 + 0.75e0 * len(t) / avgdl))"
_SCORE = " + ".join(_PART.format(idf=_IDF.format(df), tf=f"{tf}::DOUBLE") for df, tf in (("df0", "tf0"), ("df1", "tf1")))
_RANKED = f"""WITH {DOCS}, f AS (SELECT *, {_TF.format('the')} AS tf0, {_TF.format('of')} AS tf1 FROM d),
 s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f),
 r AS (SELECT doc_id, tf0, tf1, round({_SCORE}, 6) AS score FROM f, s WHERE (tf0 > 0 OR tf1 > 0) AND NOT {_has('que')})"""
_HIT_LINES = f"""{_RANKED} SELECT doc_id, '(doc ' || doc_id || ')' AS title,
 concat_ws(', ', CASE WHEN tf1 > 0 THEN 'of×' || tf1 END, CASE WHEN tf0 > 0 THEN 'the×' || tf0 END) AS matched,
 tf0 + tf1 AS total_tf, score FROM r"""
_A = f"SELECT doc_id FROM d WHERE {_has('the')} OR {_has('que')}"
_B = f"SELECT doc_id FROM d WHERE {_has('of')} AND {_has('in')}"

ORACLE_SQL = {
    "tokens": f"WITH {EACH} SELECT doc_id, pos::INTEGER AS pos, term FROM e",
    "postings": f"WITH {EACH} SELECT term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS poss FROM e GROUP BY term, doc_id",
    "term_df": f"WITH {EACH} SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY term",
    "doc_len": f"WITH {DOCS} SELECT doc_id, len(t) AS n_tok FROM d",
    "index_stats": f"""WITH {EACH}, p AS (SELECT term, count(DISTINCT doc_id) AS n, count(*) AS tf FROM e GROUP BY term)
 SELECT * FROM (SELECT count(*) AS docs, sum(len(t))::BIGINT AS tokens, round(avg(len(t)), 6) AS avg_doc_len FROM d),
 (SELECT count(*) AS terms, sum(n)::BIGINT AS postings, sum(octet_length(encode(term)) + 8 * n + 4 * tf)::BIGINT AS raw_bytes FROM p)""",
    **{name: f"WITH {DOCS} SELECT doc_id FROM d WHERE {condition}" for name, condition in _CONDITIONS.items()},
    "bm25": f"{_RANKED} SELECT doc_id, score FROM r",
    "bm25_indexed": f"{_RANKED} SELECT doc_id, score FROM r",
    "bm25_stored": f"{_RANKED} SELECT doc_id, score FROM r",
    **{f"{name}_stored": f"WITH {DOCS} SELECT doc_id FROM d WHERE {_CONDITIONS[name]}" for name in STORED},
    "hit_lines_stored": _HIT_LINES,
    "term_df_stored": f"WITH {EACH} SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY term",
    "look_up": f"WITH {EACH} SELECT doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS poss FROM e WHERE term = 'of' GROUP BY doc_id",
    "set_uniq": f"""WITH {EACH}, f AS (SELECT doc_id, term, min(pos) AS pos FROM e GROUP BY doc_id, term)
 SELECT doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS terms FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "bm25_topk": f"{_RANKED} SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20",
    "hit_lines": _HIT_LINES,
    "set_intersect": f"WITH {DOCS} {_A} INTERSECT {_B}",
    "set_union": f"WITH {DOCS} {_A} UNION {_B}",
    "set_except": f"WITH {DOCS} {_A} EXCEPT {_B}",
}
