"""Command line: build an index, ask it, or benchmark vector indexes (SRC-18, SRC-19, VEC-11).

    python -m sparkseek.cli index (--xml DUMP | --parquet DOCS) --out DIR [--max-docs N]
    python -m sparkseek.cli query --index DIR [-q QUERY] [--rank] [--limit N] [--k1 X] [--b X]
    python -m sparkseek.cli vectors (--fvecs FILE | --parquet VECTORS | --synthetic N) --out DIR [--full]

Without -q, queries are read line by line; `:rank on|off`, `:help` and `:q` are commands.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkseek.operators import benchmark
from sparkseek.operators import text as t
from sparkseek.plans.query import QueryError
from sparkseek.sources import fvecs, generators, wiki


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.time()
    docs = spark.read.parquet(args.parquet) if args.parquet else wiki.pages(spark, args.xml or wiki.corpus_path(), args.max_docs)
    t.save_index(t.Index.build(docs), args.out)
    stored = t.open_index(spark, args.out)
    row = t.statistics(stored.docs, stored.postings).first()
    print(f"{row.docs} documents, {row.terms} terms, {row.postings} postings in {time.time() - began:.1f} s")


def show(index: t.Index, query: str, rank: bool, limit: int, k1: float, b: float) -> None:
    hits = t.hit_lines(index, query, rank, k1, b)
    order = [F.desc("score"), F.col("doc_id")] if rank else [F.col("doc_id")]
    rows = hits.orderBy(*order).limit(limit + 1).collect()
    for row in rows[:limit]:
        score = f"  {row.score:.4f}" if rank else ""
        print(f"{row.doc_id}  {row.title}  [{row.matched}]{score}")
    if len(rows) > limit:
        print(f"... (+{hits.count() - limit})")


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    index, rank = t.open_index(spark, args.index), args.rank
    for line in [args.q] if args.q else map(str.strip, sys.stdin):
        if line == ":q":
            return
        if line == ":help":
            print(__doc__)
        elif line.startswith(":rank"):
            rank = line.endswith("on")
        elif line:
            try:
                show(index, line, rank, args.limit, args.k1, args.b)
            except QueryError as e:
                print(f"error: {e}")


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.fvecs:
        data = fvecs.read(spark, args.fvecs)
    elif args.parquet:
        data = spark.read.parquet(args.parquet)
    else:
        data = generators.gaussian(spark, args.synthetic or 10_000)
    table = benchmark.run(spark, data, args.out, args.k, args.queries, args.full)
    for r in table.orderBy("family", F.desc("recall")).collect():
        print(f"{r.family}  {r.params}  recall {r.recall:.4f}  {r.index_bytes} bytes  build {r.build_sec:.2f} s  search {r.search_sec:.2f} s")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkseek", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("--xml")
    index.add_argument("--parquet")
    index.add_argument("--out", required=True)
    index.add_argument("--max-docs", type=int)
    query = commands.add_parser("query")
    query.add_argument("--index", required=True)
    query.add_argument("-q")
    query.add_argument("--rank", action="store_true")
    query.add_argument("--limit", type=int, default=20)
    query.add_argument("--k1", type=float, default=t.K1)
    query.add_argument("--b", type=float, default=t.B)
    bench = commands.add_parser("vectors")
    bench.add_argument("--fvecs")
    bench.add_argument("--parquet")
    bench.add_argument("--synthetic", type=int)
    bench.add_argument("--out", required=True)
    bench.add_argument("--k", type=int, default=10)
    bench.add_argument("--queries", type=int, default=100)
    bench.add_argument("--full", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkseek").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    {"index": build, "query": ask, "vectors": compare}[args.command](spark, args)


if __name__ == "__main__":
    main()
