"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from sparkseek.llm import bpe, lm, media, ngram_join, packing, quality, sharding, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_token_files": token_files.op3_token_files,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_media": media.op7_media,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_toxicity": toxicity.op10_toxicity,
}

QUERIES["pipeline"] = corpus_pipeline.run

_SPACE = r"[\x20\x09-\x0D]+"

#: What SQL cannot express is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    # all pairs that share a shingle, and the least id that links lead to
    "op2_ngram_join": f"""WITH RECURSIVE
 w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
   SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
   FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
 r AS (SELECT a AS doc_id, a AS top FROM l UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id)
 SELECT doc_id, coalesce(top, doc_id) AS class_id, coalesce(links, 0) AS n_links, coalesce(copies, 0) + 1 AS n_copies
 FROM documents LEFT JOIN (SELECT doc_id, min(top) AS top FROM r GROUP BY doc_id) USING (doc_id)
 LEFT JOIN (SELECT a AS doc_id, count(*) AS links, count(*) FILTER (same) AS copies FROM l GROUP BY a) USING (doc_id)""",
    "op5_quality": quality.ORACLE_SQL,
    # every window of 50 bytes with the least id that has it, then runs of covered bytes
    "op8_suffix_dedup": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d)),
 m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
 c AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
 i AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS run
   FROM (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new FROM c)),
 r AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
 g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM r
   UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(len(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id),
 k AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY from_) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id),
 t AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM r GROUP BY doc_id)
 SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
 FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
