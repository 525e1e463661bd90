"""Vector and LSH queries.  Queries are the rows whose id is divisible by 100, against all rows.

The 3-D LSH operators take points of three coordinates: their queries use the first three of the 64."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.catalog.common import table
from sparkseek.operators import lsh3d
from sparkseek.operators import vectors as v
from sparkseek.sources import shared

K, DIM, BITS = 10, 64, 64
LISTS, PROBES = 16, 12
HELD = 400  # found by product codes, then measured exactly
LONG_BITS = 256
LEAST_RECALL = 0.9
CONFIG = lsh3d.Config(tables=6, hashes=3, width=6.0)
NEAR = 4.0


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("vec_id % 100 = 0")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id AS id", *[f"CAST(embedding[{i}] AS DOUBLE) * 100 AS {c}" for i, c in enumerate("xyz")])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def _exact(spark: SparkSession, d: str) -> DataFrame:
    return v.exact(_vectors(spark, d), _queries(spark, d), K)


def _hamming(spark: SparkSession, d: str) -> DataFrame:
    return v.by_hamming(_vectors(spark, d), _queries(spark, d), K, DIM, BITS)


def _recall(spark: SparkSession, d: str) -> DataFrame:
    return v.recall(_hamming(spark, d), _exact(spark, d), K).select(F.round("recall", 6).alias("recall"))


def _ivf(parts: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        index = v.IvfPq.train(_vectors(spark, d), lists=LISTS, parts=parts)
        coded = index.encode(_vectors(spark, d))
        if not parts:
            return _rounded(index.search(coded, _queries(spark, d), K, probes=PROBES))
        return _rounded(index.search_again(coded, _vectors(spark, d), _queries(spark, d), K, probes=PROBES, held=HELD))

    return query


def _hnsw(spark: SparkSession, d: str) -> DataFrame:
    """Graphs are built and written once for each application and table."""
    path = f"{shared.shared_root(spark)}/graphs-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    try:
        shared.content(spark, f"{path}/_SUCCESS")
        graphs = spark.read.schema(v.GRAPHS).parquet(path)
    except FileNotFoundError:
        graphs = v.build_graphs(_vectors(spark, d), path)
    return _rounded(v.by_graphs(graphs, _queries(spark, d), K))


def _reached(query):
    """Whether a search finds LEAST_RECALL of the true neighbours."""
    return lambda spark, d: v.recall(query(spark, d), _exact(spark, d), K).select((F.col("recall") >= LEAST_RECALL).alias("reached"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_brand AS family", "CONCAT('run ', p_partkey) AS params", "p_size / 50D AS recall", "(p_partkey * 7919) % 100003 AS index_bytes",
        "p_retailprice AS build_sec", "(p_partkey % 97) / 10D AS search_sec",
    )


QUERIES = {
    "knn_exact": lambda s, d: _rounded(_exact(s, d)),
    "knn_lsh_hamming": _hamming,
    "recall_at_k": _recall,
    "knn_ivf": _ivf(0),
    "knn_ivfpq": _ivf(8),
    "knn_hnsw": _hnsw,
    "recall_ivf": _reached(_ivf(0)),
    "recall_ivfpq": _reached(_ivf(8)),
    "recall_hnsw": _reached(_hnsw),
    "knn_lsh_long": lambda s, d: v.by_hamming(_vectors(s, d), _queries(s, d), K, DIM, LONG_BITS),
    "pick_queries": lambda s, d: v.pick_queries(_vectors(s, d), 25).select("vec_id"),
    "usable_lists": lambda s, d: s.createDataFrame([(x,) for x in v.usable_lists(_vectors(s, d).count(), [1, 2, 4, 16, 64, 256])], "lists int"),
    "ann_summary": lambda s, d: v.best_runs(_runs(s, d)).withColumn("score", F.round("score", 6)),
    "lsh_candidates": lambda s, d: _rounded(lsh3d.candidates(_points(s, d), _points(s, d).filter("id % 100 = 0"), CONFIG)),
    "lsh_duplicates": lambda s, d: _rounded(lsh3d.duplicates(_points(s, d), NEAR, CONFIG)),
    "ci95": lambda s, d: v.confidence(table(s, d, "events"), "value", ["event_type"]).select("event_type", F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95")),
}

_E = "e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_PAIRS = "list_sum(list_transform(range(1, 65), lambda i: pow(q.v[i] - e.v[i], 2)))"
_EXACT = f"""{_E}, x AS (SELECT q.vec_id AS q_id, e.vec_id, {_PAIRS} AS distance FROM e q, e WHERE q.vec_id % 100 = 0),
 exact AS (SELECT q_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id)::INTEGER AS rank FROM x) WHERE rank <= {K})"""
_SIGN = "list_reduce(list_prepend(0e0, list_transform(range(1, 65), lambda j: e.v[j] * r[j])), lambda a, b: a + b)"
_RULE = "list_transform(range({0}), lambda i: list_transform(range(64), lambda j: ((i * 7919 + j * 104729 + i * j * 31) % 2001 - 1000)::DOUBLE))"
_CODES = f"""planes AS (SELECT {_RULE.format(BITS)} AS m), codes AS MATERIALIZED (SELECT vec_id, list_transform(m, lambda r: {_SIGN} >= 0) AS c FROM e, planes),
 h AS (SELECT q.vec_id AS q_id, k.vec_id, len(list_filter(range(1, len(q.c) + 1), lambda i: q.c[i] <> k.c[i]))::DOUBLE AS distance FROM codes q, codes k WHERE q.vec_id % 100 = 0),
 hamming AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id)::INTEGER AS rank FROM h) WHERE rank <= {K})"""
_RUNS = """r AS (SELECT p_brand AS family, 'run ' || p_partkey AS params, p_size / 50e0 AS recall, (p_partkey * 7919) % 100003 AS index_bytes,
 p_retailprice AS build_sec, (p_partkey % 97) / 10e0 AS search_sec FROM part)"""
_SHARE = "CASE WHEN max({0}) OVER () > min({0}) OVER () THEN (max({0}) OVER () - {0}) / (max({0}) OVER () - min({0}) OVER ())::DOUBLE ELSE 1 END"
_FILES = " UNION ALL ".join(
    f"SELECT id, x, y, z, {t} AS t, [" + ", ".join(f"floor((x * {ax:.6f}e0 + y * {ay:.6f}e0 + z * {az:.6f}e0 + {b:.6f}e0) / 6e0)" for ax, ay, az, b in rows) + "] AS key FROM p"
    for t, rows in enumerate(CONFIG.projections().tolist())
)
_P3 = "p AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"
_D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"

ORACLE_SQL = {
    "knn_exact": f"WITH {_EXACT} SELECT q_id, vec_id, distance, rank FROM exact",
    "knn_lsh_hamming": f"WITH {_E}, {_CODES} SELECT q_id, vec_id, distance, rank FROM hamming",
    "knn_lsh_long": f"WITH {_E}, {_CODES.replace(_RULE.format(BITS), _RULE.format(LONG_BITS))} SELECT q_id, vec_id, distance, rank FROM hamming",
    **{name: "SELECT true AS reached" for name in ("recall_ivf", "recall_ivfpq", "recall_hnsw")},
    "pick_queries": "SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 25",
    "usable_lists": "SELECT lists::INTEGER AS lists FROM (VALUES (1), (2), (4), (16), (64), (256)) AS t(lists) WHERE (SELECT count(*) FROM embeddings) >= 80 * lists",
    "recall_at_k": f"""WITH {_EXACT}, {_CODES} SELECT round((SELECT count(*) FROM exact JOIN hamming USING (q_id, vec_id)) / (count(DISTINCT q_id) * {K}e0), 6) AS recall FROM exact""",
    "ann_summary": f"""WITH {_RUNS}, s AS (SELECT *, 0.4e0 * recall / max(recall) OVER () + 0.2e0 * ({_SHARE.format('index_bytes')} + {_SHARE.format('build_sec')} + {_SHARE.format('search_sec')}) AS score FROM r),
 g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY recall DESC, index_bytes, build_sec, params) AS place, row_number() OVER (ORDER BY score DESC, family, params) = 1 AS global_best FROM s)
 SELECT family, params, recall, index_bytes, build_sec, search_sec, round(score, 6) AS score, global_best FROM g WHERE place = 1 OR global_best""",
    "lsh_candidates": f"WITH {_P3}, f AS MATERIALIZED ({_FILES}) SELECT DISTINCT a.id AS q_id, b.id, round({_D3}, 6) AS distance FROM f a JOIN f b ON a.t = b.t AND a.key = b.key AND a.id <> b.id WHERE a.id % 100 = 0",
    "lsh_duplicates": f"WITH {_P3}, f AS MATERIALIZED ({_FILES}) SELECT DISTINCT a.id AS id1, b.id AS id2, round({_D3}, 6) AS distance FROM f a JOIN f b ON a.t = b.t AND a.key = b.key AND a.id < b.id WHERE {_D3} <= {NEAR}",
    "ci95": "SELECT event_type, round(avg(value), 6) AS mean, round(1.96e0 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95 FROM events GROUP BY event_type",
}
