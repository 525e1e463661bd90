"""Near-duplicate points in three dimensions by random projections (LSH-1..6).

Each of `tables` hash tables files a point under `hashes` numbers
floor((a.x + b) / width); points that share a file in some table are candidates.
The key is the struct of these numbers, so nothing collides beyond the method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    tables: int = 10
    hashes: int = 3
    width: float = 5.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.tables < 1 or self.hashes < 1 or not self.width > 0:
            raise ValueError("tables and hashes must be 1 or more, width above 0")

    def projections(self) -> np.ndarray:
        """tables x hashes x (ax, ay, az, b), rounded so that they can be written as SQL literals."""
        rng = np.random.default_rng(self.seed)
        a = rng.standard_normal((self.tables, self.hashes, 3))
        b = rng.uniform(0, self.width, (self.tables, self.hashes, 1))
        return np.round(np.concatenate([a, b], axis=2), 6)


def keys(config: Config) -> Column:
    """LSH-2, LSH-3: one struct (table, h1, h2, ...) per table, to explode."""
    out = []
    for t, rows in enumerate(config.projections().tolist()):
        parts = [F.floor((F.col("x") * ax + F.col("y") * ay + F.col("z") * az + b) / config.width).alias(f"h{i}") for i, (ax, ay, az, b) in enumerate(rows)]
        out.append(F.struct(F.lit(t).alias("t"), *parts))
    return F.array(*out)


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"))


def _filed(points: DataFrame, config: Config) -> DataFrame:
    return points.select("id", "x", "y", "z", F.explode(keys(config)).alias("key"))


def candidates(points: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """LSH-4: (q_id, id, distance) of all points that share a file with the query, itself excluded."""
    q, p = _filed(queries, config).alias("q"), _filed(points, config).alias("p")
    met = q.join(p, (F.col("q.key") == F.col("p.key")) & (F.col("q.id") != F.col("p.id")))
    return met.select(F.col("q.id").alias("q_id"), F.col("p.id").alias("id"), distance("q", "p").alias("distance")).distinct()


def duplicates(points: DataFrame, max_distance: float, config: Config = Config()) -> DataFrame:
    """LSH-5: (id1 < id2, distance) of filed pairs within max_distance, each once.

    A pair is kept in the first table where it meets, so no distinct is needed;
    distance is tested before anything is shuffled again.  Points at one place
    are paired by their distinct places only through this join: give distinct
    points where many coincide."""
    slim = points.select("id", "x", "y", "z", keys(config).alias("keys"))
    filed = slim.select("id", "x", "y", "z", "keys", F.posexplode("keys").alias("t", "key"))
    a, b = filed.alias("a"), filed.alias("b")
    first = F.array_position(F.zip_with("a.keys", "b.keys", lambda x, y: x == y), True) - 1
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    pairs = met.withColumn("distance", distance("a", "b")).filter((F.col("distance") <= max_distance) & (first == F.col("a.t")))
    return pairs.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance")
