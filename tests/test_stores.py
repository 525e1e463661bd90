import random

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import keyvalue as kv
from sparkseek.operators import lsh3d, sets
from sparkseek.sources import files
from sparkseek.streaming import upsert


def test_log_against_dict(spark):
    rng, model, rows = random.Random(3), {}, []
    for seq in range(3000):
        key = f"k{rng.randrange(200)}"
        if rng.random() < 0.3:
            model.pop(key, None)
            rows.append((key, seq, None, True))
        else:
            value = str(rng.random())[: rng.randrange(4)]
            model[key] = value
            rows.append((key, seq, value, False))
    log = spark.createDataFrame(rows, "key string, seq long, value string, is_tombstone boolean")
    assert {r.key: r.value for r in kv.latest(log).collect()} == model
    asked = spark.createDataFrame([(f"k{i}",) for i in range(0, 250, 5)], "key string")
    for r in kv.get(log, asked).collect():
        assert (r.found, r.value) == (r.key in model, model.get(r.key))
    gone = kv.delete(log, asked.withColumn("seq", F.lit(10_000)))
    assert {r.key for r in kv.latest(gone).collect()} == {k for k in model if int(k[1:]) % 5}
    assert kv.reset(log).isEmpty()
    with pytest.raises(Exception, match="too large"):
        kv.put(log, spark.createDataFrame([("k", 1, "x" * 20)], "key string, seq long, value string"), 10).collect()


def test_merge(spark):
    old = spark.createDataFrame([(f"k_{i}", i) for i in range(20)], "key string, value long")
    new = spark.createDataFrame([("k_0", 7), ("new", 3)], "key string, value long")
    merged = {r.key: r.value for r in kv.merge(old, new).collect()}
    assert (len(merged), merged["k_0"], merged["new"]) == (21, 7, 3)
    ops = spark.createDataFrame([("a", 2, 10.0), ("a", 1, 4.0), ("a", 3, 1.0), ("b", 1, 5.0)], "key string, seq long, value double")
    assert {r.key: r.value for r in kv.merge_in_order(ops, lambda o, n: o / 2 + n).collect()} == {"a": 7.0, "b": 5.0}


def test_dictionary(spark):
    keys = spark.createDataFrame([(i * 3, f"key{i * 7 % 500:03d}") for i in range(500)], "ordinal long, key string")
    built = kv.build_dictionary(keys)
    assert {r.key: r.idx for r in built.collect()} == {f"key{i * 7 % 500:03d}": i for i in range(500)}
    probes = spark.createDataFrame([("key007",), ("nope",)], "key string")
    assert {r.key: r.found for r in kv.look_up(built, probes).collect()} == {"key007": True, "nope": False}
    with pytest.raises(ValueError):
        kv.build_dictionary(keys.union(keys))
    entries = {"b": 1, "a": 0, "": 2}
    assert files.unpack_dictionary(files.pack_dictionary(entries)) == entries and files.unpack_dictionary(b"") == {}
    for bad in (b"\1", files.pack_dictionary(entries)[:-1]):
        with pytest.raises(ValueError):
            files.unpack_dictionary(bad)


def test_fnv_and_buckets():
    assert kv.fnv1a(b"") == 0xCBF29CE484222325 and kv.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(ValueError):
        kv.bucket(None, 3)


def test_sets(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "doc_id long")
    b = spark.createDataFrame([(2,), (4,)], "doc_id long")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert (ids(sets.intersection(a, b)), ids(sets.union(a, b)), ids(sets.difference(a, b))) == ([2], [1, 2, 3, 4], [1, 3])


def test_lsh(spark):
    rng = random.Random(7)
    base = [(i, *(rng.uniform(0, 100) for _ in range(3))) for i in range(500)]
    twins = [(1000 + i, *(c + rng.gauss(0, 0.3) for c in base[i][1:])) for i in range(8)]
    df = spark.createDataFrame(base + twins, "id long, x double, y double, z double")
    pairs = lsh3d.duplicates(df, 5.0).collect()
    assert {(i, 1000 + i) for i in range(8)} <= {(r.id1, r.id2) for r in pairs}
    assert len({(r.id1, r.id2) for r in pairs}) == len(pairs) and all(r.distance <= 5 for r in pairs)
    found = lsh3d.candidates(df, df.filter("id >= 1000")).collect()
    assert all(r.q_id != r.id for r in found) and {(r.q_id, r.id) for r in found} >= {(1000 + i, i) for i in range(8)}
    for bad in ({"tables": 0}, {"hashes": 0}, {"width": 0}, {"width": -1}):
        with pytest.raises(ValueError):
            lsh3d.Config(**bad)


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "key string, seq long, value string, is_tombstone boolean"
    spark.createDataFrame([("a", 1, "x", False), ("b", 2, "y", False)], schema).write.parquet(src)
    run = lambda: upsert.upsert(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([("a", 3, None, True), ("c", 4, "z", False)], schema).write.mode("append").parquet(src)
    run()
    assert {r.key: r.value for r in upsert.live(spark, out).collect()} == {"b": "y", "c": "z"}
    assert upsert.live(spark, str(tmp_path / "none")) is None


def test_saved_log(spark):
    """A log written in two goes, opened again, and what is no log."""
    log = spark.createDataFrame([("a", 1, "x", False), ("b", 2, "y", False)], "key string, seq long, value string, is_tombstone boolean")
    kv.save_log(log, "saved_log", 4)
    kv.save_log(kv.delete(kv.empty(spark), spark.createDataFrame([("a", 3)], "key string, seq long")), "saved_log", 4)
    again = kv.open_log(spark, "saved_log")
    assert [(r.key, r.seq, r.value) for r in kv.latest(again).collect()] == [("b", 2, "y")]
    assert "Exchange" not in kv.latest(again)._jdf.queryExecution().sparkPlan().toString()
    with pytest.raises(ValueError):
        kv.save_log(log, "other_log", 3)
    with pytest.raises(FileNotFoundError):
        kv.open_log(spark, "no_such_log")
    spark.range(3).write.mode("overwrite").saveAsTable("no_log")
    with pytest.raises(ValueError):
        kv.open_log(spark, "no_log")


def test_iterate_and_buckets(spark):
    rows = kv.iterate(spark.range(100))
    assert [next(rows)[0] for _ in range(3)] == [0, 1, 2]
    got = spark.range(1000).select(kv.bucket(F.col("id"), 16).alias("b")).groupBy("b").count().collect()
    assert {r.b for r in got} == set(range(16)) and max(r["count"] for r in got) < 120
