"""Exact and approximate nearest vectors, and how good they are (VEC-1..9, STAT-1).

Vectors are (vec_id, embedding).  Queries are a stated set held against all
rows, in blocks of at most QUERY_BLOCK: a block is a matrix of bounded size that
is sent to every task, each task keeps its best k for each query, and the few
survivors are merged by a window over the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
PAIRS_AT_ONCE = 1 << 20  # of a query and a row, held against each other together
SUMS = 1 << 16  # distances taken as sums of squares together
PAIRS = "q_id long, vec_id long, distance double"


def pick_queries(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """VEC-2: n rows in the order of a hash, so the same each time."""
    return vectors.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "vec_id").cast("binary")), "vec_id").limit(n)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most QUERY_BLOCK queries at a time; the driver holds one block."""
    ids, rows = [], []
    for row in queries.select("vec_id", "embedding").toLocalIterator(prefetchPartitions=True):
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)


class Best:
    """The k best of each query so far, by distance and then id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.d = np.full((n_queries, 0), np.inf)
        self.i = np.zeros((n_queries, 0), dtype=np.int64)

    def add(self, distances: np.ndarray, ids: np.ndarray) -> None:
        d = np.concatenate([self.d, distances], axis=1)
        i = np.concatenate([self.i, np.broadcast_to(ids, distances.shape)], axis=1)
        if d.shape[1] > self.k:
            # equal distances at the border are all kept before ids decide
            border = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((d <= border).sum(axis=1).max())
            keep = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            d, i = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)
            order = np.lexsort((i, d), axis=1)[:, : self.k]
            d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        self.d, self.i = d, i

    def rows(self, q_ids: np.ndarray) -> pa.RecordBatch:
        n = self.d.shape[1]
        real = np.isfinite(self.d).ravel()
        columns = [np.repeat(q_ids, n)[real], self.i.ravel()[real], self.d.ravel()[real]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_id", "vec_id", "distance"])


def _in_blocks(queries: DataFrame, one_block, spark: SparkSession) -> DataFrame:
    parts = [one_block(ids, m) for ids, m in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PAIRS)


def merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; the tasks' own best before it."""
    order = Window.partitionBy("q_id").orderBy("distance", "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest rows of each query, equal ones by id.

    Matrix products only rule out rows that are farther than the k-th by more than
    both may be off; all others, however many are equal, are measured again."""
    m = min(k, len(x))
    near, names = np.full((len(q), m), np.inf), np.zeros((len(q), m), dtype=np.int64)
    sizes = (x * x).sum(1)
    step = max(1, PAIRS_AT_ONCE // max(len(x), 1))
    for a in range(0, len(q), step):
        some = q[a : a + step]
        d = squared_distances(some, x)
        off = 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps * ((some * some).sum(1)[:, None] + sizes)
        border = np.partition(np.where(np.isnan(d), np.inf, d + off), m - 1, axis=1)[:, m - 1 : m]
        who, row = np.nonzero(d - off <= border)
        sure = np.concatenate([((some[who[c : c + SUMS]] - x[row[c : c + SUMS]]) ** 2).sum(axis=1) for c in range(0, max(len(who), 1), SUMS)])
        order = np.lexsort((ids[row], sure, who))
        who, row, sure = who[order], row[order], sure[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = place < k
        near[a + who[first], place[first]], names[a + who[first], place[first]] = sure[first], ids[row[first]]
    return near, names


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """VEC-1: (q_id, vec_id, distance, rank): squared L2, by matrix products.

    Distances of the kept are taken again as sums of squares, which do not cancel."""

    def block(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q_ids), k)
            for batch in batches:
                x, ids = matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
                for a in range(0, len(x), 2048):
                    part = x[a : a + 2048]
                    best.add(*_nearest(q, part, ids[a : a + 2048], k))
            yield best.rows(q_ids)

        return vectors.select("vec_id", "embedding").mapInArrow(run, PAIRS)

    return merged(_in_blocks(queries, block, vectors.sparkSession), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """VEC-3: mean share of each query's k true neighbours that were found."""
    hit = truth.select("q_id", "vec_id").join(found.select("q_id", "vec_id").distinct(), ["q_id", "vec_id"], "left_semi")
    n = truth.agg(F.countDistinct("q_id").alias("nq"))
    return hit.agg(F.count("*").alias("hits")).crossJoin(F.broadcast(n)).select((F.col("hits") / (F.col("nq") * k)).alias("recall"))  # one row each


WORD = 64  # bits of one number of a code


def projection(dim: int, bits: int) -> list[list[int]]:
    """Fixed integer directions from a rule, so that SQL can state them too."""
    return [[(i * 7919 + j * 104729 + i * j * 31) % 2001 - 1000 for j in range(dim)] for i in range(bits)]


def sign_code(embedding: Column, dim: int, bits: int = WORD) -> Column:
    """VEC-6: the signs of the projections, WORD in each BIGINT of an array."""

    def dot(row: Column) -> Column:
        return F.aggregate(F.zip_with(embedding, row, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, v: a + v)

    def word(rows: list[list[int]]) -> Column:
        planes = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])
        return F.aggregate(
            F.transform(planes, lambda row, i: F.when(dot(row) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda a, v: a.bitwiseOR(v),
        )

    rows = projection(dim, bits)
    return F.array(*[word(rows[a : a + WORD]) for a in range(0, bits, WORD)])


def sign_codes(vectors: DataFrame, dim: int, bits: int = WORD) -> DataFrame:
    """VEC-6, the index: (vec_id, embedding) with the code of each vector as its embedding."""
    return vectors.select("vec_id", sign_code(F.col("embedding"), dim, bits).alias("embedding"))


def _words(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1).view(np.uint64) if len(column) else np.zeros((0, 1), np.uint64)


def by_code(coded: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """VEC-6, the search: the k least Hamming distances between sign_codes(); ties by id."""

    def parts() -> Iterator[DataFrame]:
        ids, codes = [], []
        for row in asked.toLocalIterator():
            ids.append(row[0])
            codes.append(row[1])
            if len(ids) == QUERY_BLOCK:
                yield block(np.array(ids, dtype=np.int64), np.array(codes, dtype=np.int64).view(np.uint64))
                ids, codes = [], []
        if ids:
            yield block(np.array(ids, dtype=np.int64), np.array(codes, dtype=np.int64).view(np.uint64))

    def block(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q_ids), k)
            for batch in batches:
                codes, ids = _words(batch.column("embedding")), batch.column("vec_id").to_numpy()
                for a in range(0, len(codes), 1024):
                    part = codes[a : a + 1024]
                    d = np.zeros((len(q), len(part)))
                    for w in range(q.shape[1]):
                        d += np.bitwise_count(q[:, w, None] ^ part[:, w])
                    best.add(d, ids[a : a + 1024])
            yield best.rows(q_ids)

        return coded.select("vec_id", "embedding").mapInArrow(run, PAIRS)

    found = list(parts())
    if not found:
        return merged(coded.sparkSession.createDataFrame([], PAIRS), k)
    return merged(reduce(DataFrame.unionByName, found), k)


def by_hamming(vectors: DataFrame, queries: DataFrame, k: int, dim: int, bits: int = WORD) -> DataFrame:
    return by_code(sign_codes(vectors, dim, bits), sign_codes(queries, dim, bits), k)


def k_means(x: np.ndarray, n: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centroids of a sample: Lloyd's rounds from random rows; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = squared_distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n_own = np.bincount(own, minlength=len(centres))
        centres[n_own > 0] = sums[n_own > 0] / n_own[n_own > 0, None]
    return centres


@dataclass(frozen=True)
class IvfPq:
    """VEC-5: coarse lists and, if parts > 0, product codes of the residuals."""

    centres: np.ndarray
    books: np.ndarray | None  # parts x 256 x (dim / parts)

    @staticmethod
    def train(vectors: DataFrame, lists: int, parts: int = 0, sample: int = 8192, seed: int = 42) -> IvfPq:
        """From at most max(sample, 80 * lists) rows; the bound holds the driver's memory."""
        rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(max(sample, 80 * lists)).select("embedding").collect()
        x = np.array([r[0] for r in rows], dtype=np.float64)
        centres = k_means(x, lists, seed=seed)
        if not parts:
            return IvfPq(centres, None)
        if x.shape[1] % parts:
            raise ValueError("the parts must divide the dimension")
        rest = x - centres[squared_distances(x, centres).argmin(axis=1)]
        books = []
        for block in np.split(rest, parts, axis=1):
            book = k_means(block, 256, seed=seed)
            books.append(np.concatenate([book, np.repeat(book[:1], 256 - len(book), axis=0)]))
        return IvfPq(centres, np.stack(books))

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, list, code); code is the vector itself without product codes.

        Every row is filed.  Written out partitioned by list, a probe reads its lists only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("embedding"))
                if not len(x):
                    continue
                own = squared_distances(x, self.centres).argmin(axis=1)
                if self.books is None:
                    code = [v.tobytes() for v in x.astype(np.float32)]
                else:
                    rest = np.split(x - self.centres[own], len(self.books), axis=1)
                    code = np.stack([squared_distances(r, b).argmin(axis=1) for r, b in zip(rest, self.books, strict=True)], axis=1)
                    code = [c.tobytes() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(code, pa.binary())], ["vec_id", "list", "code"])

        return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, list int, code binary")

    def search(self, coded: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k best of the lists nearest to each query; with product codes, by the distance of codes."""

        def block(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
            near = np.argsort(squared_distances(q, self.centres), axis=1, kind="stable")[:, :probes]
            wanted = np.zeros((len(self.centres), len(q)), dtype=bool)
            wanted[near, np.arange(len(q))[:, None]] = True
            lists = np.flatnonzero(wanted.any(axis=1)).tolist()

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Best(len(q_ids), k)
                for batch in batches:
                    own = batch.column("list").to_numpy()
                    ids = batch.column("vec_id").to_numpy()
                    width = 1 if self.books is not None else 4
                    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8 if width == 1 else np.float32)
                    codes = codes.reshape(len(ids), -1) if len(ids) else codes
                    for i in np.unique(own):
                        who = np.flatnonzero(wanted[i])
                        if not len(who):
                            continue
                        rows = np.flatnonzero(own == i)
                        best.add(*self._nearest(q, who, int(i), codes[rows], ids[rows], k))
                yield best.rows(q_ids)

            return coded.filter(F.col("list").isin(lists)).mapInArrow(run, PAIRS)

        return merged(_in_blocks(queries, block, coded.sparkSession), k)

    def search_again(self, coded: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, probes: int, held: int) -> DataFrame:
        """The k best by exact distance among the `held` best by code."""
        found = self.search(coded, queries, held, probes).select("q_id", "vec_id")
        asked = queries.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
        pairs = found.join(asked, "q_id").join(vectors.select("vec_id", "embedding"), "vec_id")
        apart = F.zip_with("q", "embedding", lambda x, y: x.cast("double") - y)
        return merged(pairs.select("q_id", "vec_id", F.aggregate(apart, F.lit(0.0), lambda a, x: a + x * x).alias("distance")), k)

    def _nearest(self, q: np.ndarray, who: np.ndarray, i: int, codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows of list i for the queries that ask it, infinite for the others;
        so many queries at once that their pairs with the rows are PAIRS_AT_ONCE."""
        m = min(k, len(ids))
        near, names = np.full((len(q), m), np.inf), np.zeros((len(q), m), dtype=np.int64)
        step = max(1, PAIRS_AT_ONCE // len(ids))
        for a in range(0, len(who), step):
            some = who[a : a + step]
            best = Best(len(some), k)
            best.add(self._distances(q[some], i, codes), ids)
            near[some], names[some] = best.d, best.i
        return near, names

    def _distances(self, q: np.ndarray, i: int, codes: np.ndarray) -> np.ndarray:
        if self.books is None:
            return squared_distances(q, codes.astype(np.float64))
        rest = np.split(q - self.centres[i], len(self.books), axis=1)
        return sum(squared_distances(r, b)[:, codes[:, p]] for p, (r, b) in enumerate(zip(rest, self.books, strict=True)))


class Graph:
    """A navigable small-world graph over some vectors (VEC-4), in layers."""

    @staticmethod
    def restored(x: np.ndarray, entry: int, layers: list[tuple[bytes, bytes, bytes]]) -> Graph:
        """The graph that stored() has taken apart."""
        self = object.__new__(Graph)
        self.x, self.entry, self.top, self.layers = x, entry, len(layers) - 1, []
        for parts in layers:
            nodes, ends, links = (np.frombuffer(p, "<i4") for p in parts)
            self.layers.append({int(i): own.tolist() for i, own in zip(nodes, np.split(links, ends[:-1]), strict=True)} if len(nodes) else {})
        return self

    def stored(self) -> list[tuple[bytes, bytes, bytes]]:
        """Of each layer the nodes, the end of each one's links, and the links."""
        out = []
        for layer in self.layers[: self.top + 1]:
            links = [np.array(own, dtype="<i4") for own in layer.values()]
            ends = np.cumsum([len(x) for x in links]).astype("<i4")
            out.append((np.array(list(layer), dtype="<i4").tobytes(), ends.tobytes(), np.concatenate([*links, np.zeros(0, "<i4")]).astype("<i4").tobytes()))
        return out

    def __init__(self, x: np.ndarray, links: int, width: int, seed: int = 42):
        self.x, self.links, self.width = x, links, width
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.uniform(1e-12, 1, len(x))) / np.log(max(links, 2))).astype(int), 8)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry, self.top = 0, int(levels[0]) if len(x) else 0
        for i in range(len(x)):
            self._insert(i, int(levels[i]))

    def _distances(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        rest = self.x[ids] - q
        return np.einsum("ij,ij->i", rest, rest)

    def _walk(self, q: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        from heapq import heappop, heappush, heapreplace

        seen = set(starts)
        near = list(zip(self._distances(q, starts).tolist(), starts, strict=True))
        open_ = sorted(near)
        best = [(-d, i) for d, i in near]
        best.sort()
        while open_:
            d, i = heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [j for j in self.layers[layer].get(i, ()) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._distances(q, new).tolist(), new, strict=True):
                if len(best) < width:
                    heappush(best, (-dj, j))
                    heappush(open_, (dj, j))
                elif dj < -best[0][0]:
                    heapreplace(best, (-dj, j))
                    heappush(open_, (dj, j))
        return sorted((-d, i) for d, i in best)

    def _insert(self, i: int, level: int) -> None:
        if i == 0:
            for layer in range(level + 1):
                self.layers[layer][0] = []
            return
        starts = [self.entry]
        for layer in range(self.top, level, -1):
            starts = [self._walk(self.x[i], starts, 1, layer)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            found = self._walk(self.x[i], starts, self.width, layer)
            most = 2 * self.links if layer == 0 else self.links
            own = [j for _, j in found[: self.links]]
            self.layers[layer][i] = own
            for j in own:
                back = self.layers[layer].setdefault(j, [])
                back.append(i)
                if len(back) > most:
                    order = np.argsort(self._distances(self.x[j], back), kind="stable")[:most]
                    self.layers[layer][j] = [back[o] for o in order]
            starts = [j for _, j in found]
        if level > self.top:
            for layer in range(self.top + 1, level + 1):
                self.layers[layer][i] = []
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        starts = [self.entry]
        for layer in range(self.top, 0, -1):
            starts = [self._walk(q, starts, 1, layer)[0][1]]
        return self._walk(q, starts, max(width, k), 0)[:k]


GRAPH_ROWS = 4096  # vectors of one graph; all tables are cut into graphs of about this size, by a hash of the id
GRAPHS = "graph int, entry int, ids binary, vectors binary, layers array<struct<nodes: binary, ends: binary, links: binary>>"


def build_graphs(vectors: DataFrame, path: str, links: int = 16, build: int = 100) -> DataFrame:
    """VEC-4, the index: a row per graph, written to `path`; links and build are M and efConstruction.

    A graph holds its own vectors (4 bytes a number) and needs no other table."""
    n = max(1, -(-vectors.count() // GRAPH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            x, ids = np.concatenate([matrix(b.column("embedding")) for b in held]), np.concatenate([b.column("vec_id").to_numpy() for b in held])
            graph = Graph(x, links, build)
            layers = [dict(zip(("nodes", "ends", "links"), parts, strict=True)) for parts in graph.stored()]
            row = {"graph": held[0].column("graph")[0].as_py(), "entry": graph.entry, "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f4").tobytes(), "layers": layers}
            kinds = pa.schema([("graph", pa.int32()), ("entry", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.struct([(n, pa.binary()) for n in ("nodes", "ends", "links")])))])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            cuts = [0, *(np.flatnonzero(np.diff(batch.column("graph").to_numpy())) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    if held and held[0].column("graph")[0] != part.column("graph")[0]:
                        yield done()
                        held = []
                    held.append(part)
        if held:
            yield done()

    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("graph"))
    rows = dealt.repartition(n, "graph").sortWithinPartitions("graph", "vec_id").mapInArrow(run, GRAPHS)
    rows.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.schema(GRAPHS).parquet(path)


def by_graphs(graphs: DataFrame, queries: DataFrame, k: int, width: int = 100) -> DataFrame:
    """VEC-4, the search: every graph is asked, the best are merged; width is efSearch."""

    def block(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], "<i8")
                    x = np.frombuffer(row["vectors"], "<f4").astype(np.float64).reshape(len(ids), -1)
                    graph = Graph.restored(x, row["entry"], [(p["nodes"], p["ends"], p["links"]) for p in row["layers"]])
                    best = [(q_id, int(ids[i]), d) for q_id, v in zip(q_ids.tolist(), q, strict=True) for d, i in graph.search(v, k, width)]
                    a, b, c = zip(*best, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["q_id", "vec_id", "distance"])

        return graphs.mapInArrow(run, PAIRS)

    return merged(_in_blocks(queries, block, graphs.sparkSession), k)


def graph_bytes(graphs: DataFrame) -> int:
    """SRC-9: bytes of all graphs, as they are stored before compression."""
    links = F.aggregate("layers", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["nodes"]) + F.octet_length(x["ends"]) + F.octet_length(x["links"]))
    return graphs.agg(F.coalesce(F.sum(F.octet_length("ids") + F.octet_length("vectors") + links), F.lit(0))).first()[0]


def usable_lists(n: int, lists: list[int]) -> list[int]:
    """VEC-7: list counts with at least 80 vectors each."""
    return [x for x in lists if n >= 80 * x]


def best_runs(runs: DataFrame) -> DataFrame:
    """VEC-9: each family's best (recall desc, bytes asc, build asc), and the best trade-off of all:
    0.4 recall / max, and 0.2 for each of size, build and search, scaled from best 1 to worst 0."""
    spans = runs.agg(
        F.max("recall").alias("top"), *[f(c).alias(f"{n}_{c}") for c in ("index_bytes", "build_sec", "search_sec") for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def share(c: str) -> Column:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(span > 0, (F.col(f"hi_{c}") - F.col(c)) / span).otherwise(1.0)

    score = 0.4 * F.when(F.col("top") > 0, F.col("recall") / F.col("top")).otherwise(0.0) + 0.2 * (share("index_bytes") + share("build_sec") + share("search_sec"))
    scored = runs.crossJoin(F.broadcast(spans)).select(*runs.columns, score.alias("score"))  # one row
    row = F.struct(*runs.columns, "score")
    of_family = scored.groupBy("family").agg(F.min_by(row, F.struct(-F.col("recall"), "index_bytes", "build_sec", "params")).alias("r")).select("r.*")
    of_all = scored.agg(F.min_by(row, F.struct(-F.col("score"), "family", "params")).alias("r")).select("r.*")
    both = of_family.withColumn("g", F.lit(False)).unionByName(of_all.withColumn("g", F.lit(True)))
    return both.groupBy(*runs.columns, "score").agg(F.max("g").alias("global_best"))


def confidence(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """STAT-1: mean, and half the width of its 95 % interval."""
    grouped = values.groupBy(*(by or []))
    return grouped.agg(F.avg(column).alias("mean"), (1.96 * F.stddev_samp(column) / F.sqrt(F.count(column))).alias("ci95"))
