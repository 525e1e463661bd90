"""Synthetic inputs made on the executors (SRC-12..15): the same rows for the same seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.geo import RADIUS_KM

KM_PER_DEGREE = math.pi * RADIUS_KM / 180
ENDINGS = ("example.org", "example.net", "test", "invalid")
#: City boxes as (lat_lo, lat_hi, lng_lo, lng_hi): a choice of our own.
CITIES = ((55.5, 56.0, 37.3, 37.9), (59.8, 60.1, 30.1, 30.6), (51.3, 51.7, -0.5, 0.3), (48.7, 49.0, 2.1, 2.6), (52.3, 52.7, 13.1, 13.8),
          (40.3, 40.6, -3.9, -3.5), (41.8, 42.0, 12.3, 12.7), (59.2, 59.5, 17.8, 18.3), (45.3, 45.7, -73.9, -73.4), (-34.1, -33.6, 150.8, 151.4))
WORDS = ("amber", "birch", "cloud", "delta", "ember", "fjord", "grove", "heron", "inlet", "jetty", "knoll", "larch", "meadow", "north", "orchard", "prairie")


def points(spark: SparkSession, n: int, seed: int = 42, city_share: float = 0.8) -> DataFrame:
    """(id, lat, lng): most in the city boxes, the rest uniform in latitude +-85."""
    boxes = F.array(*[F.array(*[F.lit(float(x)) for x in box]) for box in CITIES])
    box = F.element_at(boxes, (F.floor(F.rand(seed) * len(CITIES)) + 1).cast("int"))
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), box.alias("b"), F.rand(seed + 1).alias("u"), F.rand(seed + 2).alias("v"), F.rand(seed + 3).alias("w"))
    inside = F.col("w") < city_share
    lat = F.when(inside, F.col("b")[0] + F.col("u") * (F.col("b")[1] - F.col("b")[0])).otherwise(F.col("u") * 170 - 85)
    lng = F.when(inside, F.col("b")[2] + F.col("v") * (F.col("b")[3] - F.col("b")[2])).otherwise(F.col("v") * 360 - 180)
    return rows.select("id", lat.alias("lat"), lng.alias("lng"))


def near_points(points: DataFrame, within_km: float, seed: int = 42) -> DataFrame:
    """Each point again as "<id>~near", moved by up to within_km in a random direction."""
    turn, far = F.rand(seed) * 2 * math.pi, F.sqrt(F.rand(seed + 1)) * within_km * 0.999
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + far * F.cos(turn) / KM_PER_DEGREE))
    lng = F.col("lng") + far * F.sin(turn) / (KM_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    lng = F.pmod(lng + 180, F.lit(360.0)) - 180
    return points.select(F.concat("id", F.lit("~near")).alias("id"), lat.alias("lat"), lng.alias("lng"))


def points3d(spark: SparkSession, n: int, seed: int = 42, side: float = 100.0) -> DataFrame:
    return spark.range(n).select("id", *[(F.rand(seed + i) * side).alias(c) for i, c in enumerate("xyz")])


def near_points3d(points: DataFrame, share: float, sigma: float, seed: int = 42) -> DataFrame:
    """Some points again, with ids from 2**40 on, moved by normal noise."""
    some = points.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
    moved = [(F.col(c) + F.randn(seed + i) * sigma).alias(c) for i, c in enumerate("xyz")]
    return some.select((F.col("id") + F.lit(1 << 40)).alias("id"), *moved)


def documents(spark: SparkSession, n: int, seed: int = 42, words: tuple[str, ...] = WORDS, least_chars: int = 96) -> DataFrame:
    """(doc_id, text): random words, enough of them for least_chars characters."""
    longest = -(-least_chars // (min(map(len, words)) + 1)) + 1
    pool = F.array(*[F.lit(w) for w in words])
    picks = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda i: F.element_at(pool, (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(words))) + 1).cast("int")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(picks, " ").alias("text"))


def key_values(spark: SparkSession, n: int, seed: int = 42, large: bool = False) -> DataFrame:
    """(key, seq, value, is_tombstone): keys like user:0000012:profile, values small JSON or long text."""
    key = F.format_string("user:%07d:profile", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))))
    small = F.to_json(F.struct(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("token")))
    value = F.repeat(small, 64) if large else small
    return spark.range(n).select(key.alias("key"), F.col("id").alias("seq"), value.alias("value"), F.lit(False).alias("is_tombstone"))


def near_texts(docs: DataFrame, share: float = 0.1, seed: int = 42, words: tuple[str, ...] = WORDS) -> DataFrame:
    """Each text again with about this share of its words replaced; ids from 2**40 on."""
    pool = F.array(*[F.lit(w) for w in words])
    own = F.split("text", " ")

    def changed(word, i):
        h = F.xxhash64("doc_id", i, F.lit(seed))
        other = F.element_at(pool, (F.pmod(F.shiftright(h, 20), F.lit(len(words))) + 1).cast("int"))
        return F.when(F.pmod(h, F.lit(10_000)) < int(share * 10_000), other).otherwise(word)

    return docs.select((F.col("doc_id") + F.lit(1 << 40)).alias("doc_id"), F.array_join(F.transform(own, changed), " ").alias("text"))


def domain_keys(spark: SparkSession, n: int, seed: int = 42, words: tuple[str, ...] = WORDS) -> DataFrame:
    """(key): host names of two words and a number below a few ending domains."""
    pick = lambda pool, salt: F.element_at(F.array(*[F.lit(x) for x in pool]), (F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(pool))) + 1).cast("int"))
    return spark.range(n).select(F.concat(pick(words, 1), F.lit("-"), pick(words, 2), F.col("id"), F.lit("."), pick(ENDINGS, 3)).alias("key"))


def gaussian(spark: SparkSession, n: int, dim: int = 128, seed: int = 42) -> DataFrame:
    """(vec_id, embedding) of independent normal numbers."""
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed + i).cast("float") for i in range(dim)]).alias("embedding"))
