"""Key-value, merge-map and dictionary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.catalog.common import table
from sparkseek.operators import keyvalue as kv


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id AS key", "event_id AS seq", "value", "event_type = 'error' AS is_tombstone")


def _after_delete(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    gone = log.filter("key % 10 = 3").select("key").distinct().withColumn("seq", F.lit(1 << 40))
    return kv.latest(kv.delete(log, gone))


def _merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "part").selectExpr("p_partkey AS key", "CAST(p_size AS DOUBLE) AS value")
    new = table(spark, d, "lineitem").selectExpr("l_partkey AS key", "l_quantity AS value")
    return kv.merge(old, new).select("key", F.round("value", 4).alias("value"))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return kv.build_dictionary(table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS key", "c_custkey AS ordinal"))


def _look_up(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_custkey + 1 AS STRING) AS key")
    return kv.look_up(_dictionary(spark, d), probes)


def _in_order(spark: SparkSession, d: str) -> DataFrame:
    """A merger that does not commute: the old value halved, plus the new."""
    return kv.merge_in_order(_log(spark, d), lambda old, new: old / 2 + new).select("key", F.round("value", 4).alias("value"))


def _put(spark: SparkSession, d: str) -> DataFrame:
    """A second value for some keys, first ones for new keys, and a log that was reset before."""
    rows = table(spark, d, "customer").selectExpr("c_custkey AS key", "CAST(c_custkey % 7 AS BIGINT) + (1L << 41) AS seq", "c_acctbal AS value").filter("key % 3 = 0")
    return kv.latest(kv.put(_log(spark, d), rows))


def _reset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_suppkey AS seq", "s_acctbal AS value")
    return kv.latest(kv.put(kv.reset(_log(spark, d)), rows))


QUERIES = {
    "kv_put": _put,
    "kv_reset": _reset,
    "map_size": lambda s, d: s.range(1).select(F.lit(kv.size(kv.latest(_log(s, d)))).cast("long").alias("n")),
    "kv_latest": lambda s, d: kv.latest(_log(s, d)),
    "kv_get": lambda s, d: kv.get(_log(s, d), table(s, d, "customer").selectExpr("c_custkey AS key")),
    "kv_after_delete": _after_delete,
    "map_merge": _merge,
    "map_merge_in_order": _in_order,
    "dict_build": _dictionary,
    "dict_lookup": _look_up,
}

_LATEST = """l AS (SELECT user_id AS key, event_id AS seq, value, event_type = 'error' AS gone FROM events),
 n AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(gone, seq) AS gone FROM l GROUP BY key)"""
_DICT = "k AS (SELECT CAST(c_custkey AS VARCHAR) AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)"

ORACLE_SQL = {
    "kv_put": f"""WITH {_LATEST}, p AS (SELECT c_custkey AS key, (c_custkey % 7) + (1::BIGINT << 41) AS seq, c_acctbal AS value FROM customer WHERE c_custkey % 3 = 0)
 SELECT key, seq, value FROM n WHERE NOT gone AND key NOT IN (SELECT key FROM p) UNION ALL SELECT key, seq, value FROM p""",
    "kv_reset": "SELECT s_suppkey AS key, s_suppkey AS seq, s_acctbal AS value FROM supplier",
    "map_size": f"WITH {_LATEST} SELECT count(*) AS n FROM n WHERE NOT gone",
    "kv_latest": f"WITH {_LATEST} SELECT key, seq, value FROM n WHERE NOT gone",
    "kv_get": f"""WITH {_LATEST} SELECT c.key, n.key IS NOT NULL AS found, n.value
 FROM (SELECT DISTINCT c_custkey AS key FROM customer) c LEFT JOIN (SELECT * FROM n WHERE NOT gone) n ON c.key = n.key""",
    "kv_after_delete": f"WITH {_LATEST} SELECT key, seq, value FROM n WHERE NOT gone AND key % 10 <> 3",
    "map_merge": """SELECT key, round(sum(value), 4) AS value FROM (SELECT p_partkey AS key, p_size::DOUBLE AS value FROM part
 UNION ALL SELECT l_partkey, l_quantity FROM lineitem) GROUP BY key""",
    "map_merge_in_order": """SELECT user_id AS key, round(list_reduce(list(value ORDER BY event_id), lambda a, b: a / 2 + b), 4) AS value
 FROM events GROUP BY user_id""",
    "dict_build": f"WITH {_DICT} SELECT key, idx FROM k",
    "dict_lookup": f"""WITH {_DICT} SELECT o_orderkey, p.key, idx, idx IS NOT NULL AS found
 FROM (SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR) AS key FROM orders) p LEFT JOIN k ON p.key = k.key""",
}
