"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

Two documents are linked when their sets of word 5-shingles have a Jaccard
similarity of SIMILARITY or more.  The result has one row per document: its
class (the least id of its connected component of links) and how many documents
it is linked to.

1. Documents with equal sets are one node; only nodes are compared.
2. A node has TREES labels of DEPTH minhashes of 16 bits each.  A tree is the
   prefix trie of its labels; the nodes below a prefix are candidates.  The
   forest is climbed from the full labels up, one minhash shorter at each level.
   A node climbs until a pair at the least similarity that its set can have with
   another linked one is found with probability TARGET: 1 - (1 - s^k)^trees.
   For most sets that is the threshold itself; sets of few shingles have coarser
   similarities and stop at longer prefixes.  Both nodes of a pair reach the
   level at which the pair's own least similarity is found.
3. What a level brings together is contracted before the next: a subtrie holds
   distinct roots only, each tied to the least, so one in which all is joined
   already costs nothing more.  The first level takes its first few trees alone,
   which contract large groups before all trees are looked at.
4. A candidate group is verified as a whole.  Up to BLOCK nodes, or
   BLOCK_SHINGLES, go to one task; larger groups are cut by hash into blocks, and
   each pair of blocks is a task of its own.  Intersections are counted there
   exactly: shingles of few sets pair by pair, others by a product of 0/1
   matrices.  A task hands over, for each node with links, the number of
   documents it is linked to and the root of its links; a pair of blocks ties no
   more than the roots of either, so ties grow with nodes, not with pairs.
5. Components of the roots are the classes.

No bucket, group or number of partners is capped.  A null or empty text, or one
without words, has no shingles: it is its own class with no links.  A text of
fewer than five words has one shingle, all its words.  Rows with one id are
separate documents.  Other columns of the table are not read, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, encoding, graph, shingles

WORDS = 5
SIMILARITY = 0.8
TREES = 24
FIRST_TREES = 3  # looked at before the others at the deepest level
DEPTH = 7
TARGET = 0.9999
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
NULL_ID = (1 << 63) - 1  # a null id comes last
COLUMNS = 4096  # shingles of one matrix product
RARE = 24  # sets; what fewer have is counted pair by pair
PAIRS = 1 << 21  # counted at once
_ROWS = 1024  # shingles hashed at once
_FINE = 60  # shingles from which on every similarity counts as possible


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair of this similarity shares a prefix of this depth."""
    return 1 - (1 - similarity**depth) ** trees


@lru_cache(maxsize=None)
def least_similarity(n: int, similarity: float) -> float:
    """The least similarity, at the threshold or more, of a set of n shingles with another; 1 if there is none."""
    if n >= _FINE:
        return similarity
    found = [1.0]
    for m in range(1, int(n / similarity) + 1):
        a = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
        if a <= min(n, m):
            found.append(a / (n + m - a))
    return min(found)


@lru_cache(maxsize=None)
def stop_depth(n: int, similarity: float = SIMILARITY, target: float = TARGET, depth: int = DEPTH, trees: int = TREES) -> int:
    """Where a set of n shingles stops climbing: the longest prefix that reaches the target recall."""
    while depth > 1 and recall(least_similarity(min(n, _FINE), similarity), depth, trees) < target:
        depth -= 1
    return depth


def _factors() -> np.ndarray:
    return shingles.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """TREES x DEPTH labels of 16 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(own), _ROWS):
        np.minimum(least, (own[a : a + _ROWS, None] * factors).min(axis=0), out=least)
    return (shingles.mix(least) >> np.uint64(48)).astype("<u2")


def describe(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set; null without words), size, stop and label."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    names = ["doc_id", "text_hash", "node", "size", "stop", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            for part in encoding.slices(batch):
                sets = shingles.shingle_sets(part.column("text"), WORDS)
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                labels = [signature(s, factors).tobytes() if len(s) else None for s in sets]
                stops = [stop_depth(min(len(s), _FINE), similarity) for s in sets]
                own = [pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(stops, pa.int32()), pa.array(labels, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *own], names)

    return rows.mapInArrow(common.trimmed(run), "doc_id long, text_hash long, node long, size long, stop int, label binary")


def candidate_groups(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that share a prefix with another, closed over components."""
    roots = None
    for depth in range(DEPTH, stop_depth(_FINE, similarity) - 1, -1):
        for first, last in ((0, FIRST_TREES), (FIRST_TREES, TREES)) if depth == DEPTH else ((0, TREES),):
            at = nodes.filter(F.col("stop") <= depth).select("node", "label")
            if roots is not None:
                at = at.join(roots, "node", "left").select(F.coalesce("component", "node").alias("node"), "label")
            prefix = f"explode(transform(sequence({first}, {last - 1}), t -> xxhash64(t, substring(label, t * {2 * DEPTH} + 1, {2 * depth}))))"
            below = at.select("node", F.expr(prefix).alias("prefix")).distinct()
            tops = below.groupBy("prefix").agg(F.min("node").alias("top"), F.max("node").alias("last")).filter("top < last").drop("last")
            ties = below.join(tops, "prefix").filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"))
            found = common.stored(graph.components(ties), "forest-level")
            roots = found if roots is None else graph.merged(roots, found)
    return roots


class Links:
    """Exact links among sets held by one task: counts, and roots by union-find."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def find(self, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """side: the block of each set, of two whose own pairs are another task's;
        None: all pairs.  (documents linked to, first set of the component)."""
        n = len(sets)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        common_to = np.zeros((n, n), dtype=np.float32)
        owner = np.repeat(np.arange(n), sizes.astype(int))
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        number = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])]) if len(flat) else np.zeros(0, int)
        often = np.bincount(number)[number]
        few = (often > 1) & (often <= RARE)  # a shingle of one set alone counts for no pair
        _count_pairs(common_to, number[few], owner[few], often[few])
        number, owner = number[often > RARE], owner[often > RARE]
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
        for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            lo, hi = np.searchsorted(number, (a, a + COLUMNS))
            has = np.zeros((n, min(COLUMNS, int(number[hi - 1]) - a + 1)), dtype=np.float32)
            has[owner[lo:hi], number[lo:hi] - a] = 1
            common_to += has @ has.T
        linked = common_to >= self.similarity * (sizes[:, None] + sizes - common_to) - 1e-9
        np.fill_diagonal(linked, False)
        if side is None:
            return linked @ copies, _roots(linked, np.arange(n))
        # sets linked within a block are tied there; here one set speaks for them
        across = side[:, None] != side
        own = _roots(linked & ~across, np.arange(n))
        root = _roots(linked & across, own)
        return (linked & across) @ copies, np.where(own == np.arange(n), root, np.arange(n))


def _count_pairs(common_to: np.ndarray, number: np.ndarray, owner: np.ndarray, often: np.ndarray) -> None:
    """Adds one to both cells of each two sets that have a shingle; entries of one shingle stand together."""
    n = len(common_to)
    for lag in range(1, RARE):
        longer = often > lag
        number, owner, often = number[longer], owner[longer], often[longer]
        for a in range(0, max(len(number) - lag, 0), PAIRS):
            i, j = owner[a : a + PAIRS], owner[a + lag : a + lag + PAIRS]
            same = number[a : a + len(j)] == number[a + lag : a + lag + len(j)]
            cells, times = np.unique(i[: len(j)][same] * n + j[same], return_counts=True)
            common_to.ravel()[cells] += times
    rare = np.triu(common_to, 1)
    common_to[:] = rare + rare.T


def _roots(linked: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The first member of each component, given those of components known before."""
    root = root.copy()
    for i in range(len(root)):
        near = np.flatnonzero(linked[i, :i])
        if len(near):
            old = np.unique(np.append(root[near], root[i]))
            if len(old) > 1:
                root[np.isin(root, old)] = old[0]
    return root


def _verify(groups: DataFrame, similarity: float) -> DataFrame:
    """A row per node with links and task: node, links, root; with the first ids of both.

    groups: grp, i, j, blk, node, doc, copies, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, key, held = Links(similarity), None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([h[0] for h in held], dtype=np.int64)
            side = np.array([h[3] for h in held]) if key[1] != key[2] else None
            links, root = finder.find([h[2] for h in held], np.array([h[1] for h in held], dtype=np.int64), side)
            docs = np.array([h[4] for h in held], dtype=np.int64)
            some = (links > 0) | (root != np.arange(len(root)))
            columns = (nodes[some], docs[some], links[some], nodes[root][some], docs[root][some])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "doc", "links", "root", "root_doc"])

        for batch in batches:
            for part in encoding.slices(batch):
                sets = shingles.shingle_sets(part.column("text"), WORDS)
                for grp, i, j, blk, node, copies, doc, own in zip(
                    *(part.column(c).to_pylist() for c in ("grp", "i", "j", "blk", "node", "copies", "doc")), sets, strict=True
                ):
                    if (grp, i, j) != key and held:
                        yield done()
                        held = []
                    if held and held[-1][0] == node:  # a repeated row
                        continue
                    key = (grp, i, j)
                    held.append((node, copies, own, blk, doc))
        if held:
            yield done()

    cut = groups.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    return cut.mapInArrow(common.trimmed(run), "node long, doc long, links long, root long, root_doc long")


def join_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64), class_id, n_links, n_copies of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = common.stored(describe(rows, similarity), "forest-labels")
    nodes = known.filter("node IS NOT NULL").groupBy("node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = nodes.agg(first, F.count("*").alias("copies"), F.max("size").alias("size"), F.max("stop").alias("stop"), F.max("label").alias("label"))
    nodes = common.stored(nodes, "forest-nodes")
    groups = candidate_groups(nodes, similarity).join(nodes.drop("label", "stop"), "node")
    groups = common.stored(groups, "forest-groups")
    # few groups need more than one block: theirs is a small table of its own
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    large = common.stored(groups.groupBy("component").agg(blocks).filter("blocks > 1"), "forest-large")
    groups = groups.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    groups = groups.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    members = groups.select(
        F.col("component").alias("grp"), "node", "copies", "first.doc_id", "first.text_hash", "blk", "blocks"
    )
    texts = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = members.join(texts, members.doc_id.eqNullSafe(texts.doc_id) & (members.text_hash == texts.text_hash))
    doc = F.coalesce(members.doc_id, F.lit(NULL_ID)).alias("doc")
    held = held.select("grp", "node", doc, "copies", "blk", "blocks", "text")
    paired = held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select(
        "grp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "doc", "copies", "text"
    )
    found = common.stored(_verify(paired, similarity), "forest-links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    # nodes go by (first id, hash), so that the least of a component names its class
    named = lambda doc, node: F.struct(F.col(doc).alias("doc"), F.col(node).alias("node"))
    classes = graph.components(found.filter("node <> root").select(named("doc", "node").alias("a"), named("root_doc", "root").alias("b")).distinct())
    classes = classes.select(F.col("node.node").alias("node"), F.col("component.doc").alias("class"))
    at = nodes.join(counted, "node", "left").join(classes, "node", "left")
    least = F.coalesce("class", "first.doc_id")
    at = at.select("node", F.when(least != NULL_ID, least).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    at = common.stored(at, "forest-classes")  # a plain exchange on either side, so that the node of many copies can be split
    return known.join(at, "node", "left").select(
        "doc_id",
        "text_hash",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(common.table(spark, sf_dir, "documents")).drop("text_hash")
