"""Vector index benchmark: a grid of settings, timed, with recall and size (VEC-8, VEC-11, SRC-9, SRC-10)."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators import vectors as v
from sparkseek.sources import files

RUNS = "family string, params string, recall double, index_bytes long, build_sec double, search_sec double"
QUICK = {"lists": (16,), "parts": (8,), "probes": (4, 8), "bits": (64,), "links": (16,), "build": (100,), "width": (64,)}
FULL = {"lists": (64, 256, 512), "parts": (8, 16, 32, 64), "probes": (4, 16, 64), "bits": (64, 128, 256, 512), "links": (8, 16, 48), "build": (100, 200), "width": (32, 128, 256)}


def _timed(make) -> tuple[DataFrame, float]:
    """The result, computed and kept, and the seconds it took."""
    began = time.perf_counter()
    out = make().cache()
    out.count()
    return out, time.perf_counter() - began


def code_bytes(coded: DataFrame) -> int:
    """SRC-9: bytes of all codes."""
    return coded.agg(F.coalesce(F.sum(F.octet_length("code")), F.lit(0))).first()[0]


def runs(data: DataFrame, queries: DataFrame, k: int, grid: dict[str, tuple], folder: str) -> Iterator[tuple]:
    """A row of RUNS for each setting; graphs are written below folder."""
    truth, _ = _timed(lambda: v.exact(data, queries, k))
    n = data.count()
    dim = len(data.first().embedding)

    def row(family: str, params: dict, size: int, build: float, search) -> tuple:
        found, seconds = _timed(search)
        out = (family, json.dumps(params, sort_keys=True), v.recall(found, truth, k).first()[0], size, build, seconds)
        found.unpersist()
        return out

    parts = (0, *[p for p in grid["parts"] if dim % p == 0])
    for lists, m in itertools.product(v.usable_lists(n, list(grid["lists"])), parts):
        began = time.perf_counter()
        index = v.IvfPq.train(data, lists, m)
        coded, _ = _timed(lambda index=index: index.encode(data))
        build, size = time.perf_counter() - began, code_bytes(coded)
        for probes in (p for p in grid["probes"] if p <= lists):
            params = {"lists": lists, "parts": m, "probes": probes}
            yield row("IVF_PQ" if m else "IVF", params, size, build, lambda index=index, coded=coded, probes=probes: index.search(coded, queries, k, probes))
        coded.unpersist()
    for bits in grid["bits"]:
        coded, build = _timed(lambda bits=bits: v.sign_codes(data, dim, bits))
        asked, _ = _timed(lambda bits=bits: v.sign_codes(queries, dim, bits))
        size = coded.agg(F.sum(8 * F.size("embedding"))).first()[0]
        yield row("LSH", {"bits": bits}, size, build, lambda coded=coded, asked=asked: v.by_code(coded, asked, k))
        coded.unpersist()
        asked.unpersist()
    for links, width in itertools.product(grid["links"], grid["build"]):
        began = time.perf_counter()
        graphs = v.build_graphs(data, f"{folder}/graphs-{links}-{width}", links, width)
        build, size = time.perf_counter() - began, v.graph_bytes(graphs)
        for search in grid["width"]:
            params = {"links": links, "build": width, "width": search}
            yield row("HNSW", params, size, build, lambda graphs=graphs, search=search: v.by_graphs(graphs, queries, k, search))


def run(spark: SparkSession, data: DataFrame, out: str, k: int = 10, n_queries: int = 100, full: bool = False, seed: int = 42) -> DataFrame:
    """Write results (CSV, TSV), the best of each family and a manifest (JSON) below out; the results."""
    queries = v.pick_queries(data, n_queries, seed).cache()
    rows = list(runs(data.select("vec_id", "embedding").cache(), queries, k, FULL if full else QUICK, out))
    table = spark.createDataFrame(rows, RUNS)
    files.write_csv(table, f"{out}/results")
    files.write_tsv(table, f"{out}/plot_series")
    files.write_json(v.best_runs(table), f"{out}/summary")
    manifest = [(data.count(), n_queries, k, seed, full)]
    files.write_json(spark.createDataFrame(manifest, "vectors long, queries int, k int, seed int, full boolean"), f"{out}/manifest")
    return table
