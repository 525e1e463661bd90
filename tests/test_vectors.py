import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import geo
from sparkseek.operators import vectors as v
from sparkseek.sources import fvecs, generators


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32)) * 3
    x = (centres[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).cache()
    return x.astype(np.float64), df, df.filter("vec_id % 100 = 0")


def _truth(x, k):
    return {q: sorted((float(((x[q] - y) ** 2).sum()), i) for i, y in enumerate(x))[:k] for q in range(0, len(x), 100)}


def test_exact_and_approximate(data):
    x, df, queries = data
    truth = _truth(x, 10)
    exact = v.exact(df, queries, 10).cache()
    rows = exact.orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.vec_id) for r in rows] == [(q, i) for q in truth for _, i in truth[q]]
    index = v.IvfPq.train(df, lists=16)
    assert v.recall(index.search(index.encode(df), queries, 10, 6), exact, 10).first()[0] >= 0.9
    coded = v.IvfPq.train(df, lists=8, parts=8)
    assert v.recall(coded.search(coded.encode(df), queries, 10, 8), exact, 10).first()[0] >= 0.5
    assert coded.encode(df).count() == 1500
    assert v.recall(exact, exact, 10).first()[0] == 1.0
    with pytest.raises(ValueError):
        v.IvfPq.train(df, lists=4, parts=5)


def test_fewer_rows_than_k(data, spark):
    _, df, queries = data
    few = df.filter("vec_id < 3")
    assert v.exact(few, few, 10).count() == 9
    assert v.exact(df, queries.limit(0), 10).isEmpty()


def test_exact_among_equal_vectors(spark):
    """Hundreds of copies of one vector: the least ids are kept, wherever they stand."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[rng.permutation(3000)[:1000]] = x[7]
    order = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<float>").coalesce(1)
    queries = df.filter("vec_id % 100 = 0 OR vec_id = 7")
    rows = v.exact(df, queries, 10).orderBy("q_id", "rank").collect()
    y = x.astype(np.float64)
    want = [(q, i) for q in sorted({*range(0, 3000, 100), 7}) for i in np.lexsort((np.arange(3000), ((y - y[q]) ** 2).sum(axis=1)))[:10].tolist()]
    assert [(r.q_id, r.vec_id) for r in rows] == want


def test_stored_graphs(data, tmp_path, monkeypatch):
    """Built once, asked at two widths; several graphs are asked together."""
    x, df, queries = data
    exact = v.exact(df, queries, 10).cache()
    graphs = v.build_graphs(df, str(tmp_path / "one"))
    assert graphs.count() == 1
    wide, narrow = (v.recall(v.by_graphs(graphs, queries, 10, width), exact, 10).first()[0] for width in (100, 10))
    assert wide >= 0.95 and wide >= narrow
    monkeypatch.setattr(v, "GRAPH_ROWS", 400)
    several = v.build_graphs(df, str(tmp_path / "several"), links=8, build=40)
    assert several.count() == 4 and v.recall(v.by_graphs(several, queries, 10), exact, 10).first()[0] >= 0.95
    assert v.graph_bytes(graphs) > 1500 * (8 + 4 * 32)
    graph = v.Graph(x[:200], 8, 40)
    again = v.Graph.restored(x[:200], graph.entry, graph.stored())
    assert all(again.search(q, 5, 30) == graph.search(q, 5, 30) for q in x[200:220])
    assert v.by_graphs(v.build_graphs(df.limit(0), str(tmp_path / "none")), queries, 10).isEmpty()


@pytest.mark.parametrize("bits", [64, 200, 512])
def test_codes_of_several_words(data, bits):
    x, df, queries = data
    signs = x @ np.array(v.projection(32, bits), dtype=np.float64).T >= 0
    got = {}
    for r in v.by_hamming(df, queries, 5, 32, bits).collect():
        got.setdefault(r.q_id, {})[r.rank] = (r.distance, r.vec_id)
    for q, ranks in got.items():
        apart = (signs != signs[q]).sum(axis=1)
        assert [ranks[i + 1] for i in range(5)] == sorted((float(d), i) for i, d in enumerate(apart))[:5]


def test_registered_indexes_reach_their_recall(spark):
    """On the largest registered table; the distances of product codes are measured exactly."""
    from sparkseek.catalog.vectors import QUERIES

    d = "/root/testdata/sf0.1"
    exact, codes = (QUERIES[q](spark, d).cache() for q in ("knn_exact", "knn_ivfpq"))
    found = {q: v.recall(codes if q == "knn_ivfpq" else QUERIES[q](spark, d), exact, 10).first()[0] for q in ("knn_ivf", "knn_ivfpq", "knn_hnsw")}
    print("recall:", found)
    assert min(found.values()) >= 0.9
    same = codes.join(exact.select("q_id", "vec_id", F.col("distance").alias("sure")), ["q_id", "vec_id"])
    assert same.filter("abs(distance - sure) > 2e-6").isEmpty()


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((50, 7)).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    fvecs.write(path, x)
    with open(path, "ab") as f:
        f.write(b"\7\0\0\0cut")
    rows = fvecs.read(spark, path).orderBy("vec_id").collect()
    assert np.allclose([r.embedding for r in rows], x) and fvecs.read(spark, path, 5).count() == 5
    (tmp_path / "empty").touch()
    with pytest.raises(ValueError):
        fvecs.read(spark, str(tmp_path / "empty"))


def test_generators(spark):
    assert generators.gaussian(spark, 10, 4).first().embedding.__len__() == 4
    texts = [r.text for r in generators.documents(spark, 20).collect()]
    assert all(len(x) >= 96 for x in texts) and texts == [r.text for r in generators.documents(spark, 20).collect()]
    assert generators.points(spark, 100).filter("abs(lat) > 85 or abs(lng) > 180").isEmpty()
    assert generators.key_values(spark, 10).count() == 10
    docs = generators.documents(spark, 50)
    near = {r.doc_id - (1 << 40): r.text.split() for r in generators.near_texts(docs, 0.2).collect()}
    same = [sum(a == b for a, b in zip(r.text.split(), near[r.doc_id], strict=True)) / len(near[r.doc_id]) for r in docs.collect()]
    assert 0.7 < sum(same) / len(same) < 0.95
    assert generators.domain_keys(spark, 200).distinct().count() == 200
    here = generators.points(spark, 200)
    moved = {r.id.removesuffix("~near"): r for r in generators.near_points(here, 2.0).collect()}
    both = spark.createDataFrame([(r.lat, r.lng, moved[r.id].lat, moved[r.id].lng) for r in here.collect()], "a double, b double, c double, d double")
    assert both.filter(geo.distance_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")) > 2.01).isEmpty()


def test_benchmark(spark, tmp_path, capsys):
    from sparkseek import cli

    cli.main(["vectors", "--synthetic", "1500", "--out", str(tmp_path), "--queries", "5"])
    out = capsys.readouterr().out
    assert all(family in out for family in ("IVF ", "IVF_PQ", "LSH", "HNSW"))
    assert spark.read.json(str(tmp_path / "summary")).filter("global_best").count() == 1


def test_lists_are_held_against_few_queries_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(700, 8)), rng.normal(size=(5000, 8)).astype(np.float32)
    index = v.IvfPq(np.zeros((1, 8)), None)
    pairs, own = [], v.IvfPq._distances
    monkeypatch.setattr(v.IvfPq, "_distances", lambda self, q, i, codes: pairs.append(len(q) * len(codes)) or own(self, q, i, codes))
    who = np.arange(0, 700, 2)
    near, names = index._nearest(q, who, 0, x, np.arange(5000), 10)
    assert max(pairs) <= v.PAIRS_AT_ONCE < len(who) * len(x) == sum(pairs)
    d = ((q[who, None] - x[None, :].astype(np.float64)) ** 2).sum(axis=2)
    assert np.sort(names[who]).tolist() == np.sort(np.argsort(d, axis=1)[:, :10]).tolist()
    assert np.isinf(near[1::2]).all()
