"""Codec queries: gaps, sizes, and bytes there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.catalog import text
from sparkseek.functions import codecs


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return codecs.with_gaps(text._index(spark, d))


def _size(name: str):
    return lambda s, d: codecs.list_sizes(_gaps(s, d)).select("term", "values", F.col(name).alias("bytes"))


def _round_trip(version: int):
    """Postings encoded in a version and decoded."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        out = codecs.decode_index(codecs.encode_index(text._index(spark, d), version))
        return out.select("term", "doc_id", "tf", F.array_join(F.col("poss").cast("array<string>"), ",").alias("poss"))

    return query


QUERIES = {
    "delta_gaps": lambda s, d: _gaps(s, d).select("term", "doc_id", "gap", "rank"),
    "varint_bytes": _size("varint"),
    "bitpack_bytes": _size("bitpack"),
    "pfordelta_bytes": _size("pfordelta"),
    "codec_breakdown": lambda s, d: codecs.breakdown(codecs.list_sizes(_gaps(s, d))),
    "codec_round_trip": _round_trip(4),
    **{f"codec_round_trip_v{n}": _round_trip(n) for n in (1, 2, 3)},
    "codec_payload": lambda s, d: codecs.payload_bytes(text._index(s, d)),
}

_BITS = "CASE WHEN gap = 0 THEN 0 ELSE length(bin(gap)) END"
_GAPS = f"""WITH {text.EACH}, p AS (SELECT DISTINCT term, doc_id FROM e),
 g AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER w AS gap, row_number() OVER w - 1 AS rank
 FROM p WINDOW w AS (PARTITION BY term ORDER BY doc_id)), b AS (SELECT *, {_BITS} AS bits FROM g)"""
_CEIL = lambda x: f"ceil(({x})::DOUBLE)::BIGINT"
_OVER = "count(*) FILTER (bits > {0})"
_COSTS = ", ".join(f"CASE WHEN {_OVER.format(i)} <= 32 THEN 3 + {_CEIL(f'count(*) * {i} / 8.0e0')} + 5 * {_OVER.format(i)} END" for i in range(33))
_SIZES = f"""{_GAPS}, blocks AS (SELECT term, rank // 128 AS block, least({_COSTS}) AS bytes FROM b GROUP BY ALL),
 x AS (SELECT term, count(*) AS values, sum(greatest(1, {_CEIL('bits / 7.0e0')}))::BIGINT AS varint,
 1 + {_CEIL('count(*) * max(bits) / 8.0e0')} AS bitpack FROM b GROUP BY term),
 y AS (SELECT term, (4 + sum(bytes))::BIGINT AS pfordelta FROM blocks GROUP BY term), sizes AS (SELECT * FROM x JOIN y USING (term))"""

ORACLE_SQL = {
    "delta_gaps": f"{_GAPS} SELECT term, doc_id, gap, rank FROM g",
    "varint_bytes": f"{_SIZES} SELECT term, values, varint AS bytes FROM sizes",
    "bitpack_bytes": f"{_SIZES} SELECT term, values, bitpack AS bytes FROM sizes",
    "pfordelta_bytes": f"{_SIZES} SELECT term, values, pfordelta AS bytes FROM sizes",
    "codec_breakdown": f"""{_SIZES} SELECT sum(varint)::BIGINT AS varint_total, sum(bitpack)::BIGINT AS bitpack_total,
 sum(pfordelta)::BIGINT AS pfordelta_total, sum(least(varint, bitpack) + 1)::BIGINT AS optimal_total,
 count(*) FILTER (pfordelta < bitpack) AS wins, count(*) FILTER (pfordelta > bitpack) AS losses,
 count(*) FILTER (pfordelta = bitpack) AS ties FROM sizes""",
    "codec_round_trip": text.ORACLE_SQL["postings"],
}
ORACLE_SQL |= {f"codec_round_trip_v{n}": ORACLE_SQL["codec_round_trip"] for n in (1, 2, 3)}
