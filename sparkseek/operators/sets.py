"""Set operations on tables of document ids and on arrays (SET-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct keys in both: a semi join, so only b's keys are shuffled beside a's."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def union(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def difference(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def first_seen(array: Column) -> Column:
    """SET-4: distinct values in the order in which they first occur."""
    return F.array_distinct(array)
