"""Command line: python -m tesserine.cli VERB ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from .operators import index, storage
from .plans import build
from .session import local_session, ship
from .sources import readers

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *paths: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for x in paths:
            v.add_argument(x)
        v.add_argument("--overwrite", action="store_true")
        return v

    kinds = ("auto", "flat", "ivfpq")
    v = verb("pipeline", "raw", "dumps", "out")
    v.add_argument("--index-type", choices=kinds, default="auto")
    v.add_argument("--with-triplets", action="store_true")
    verb("extract", "raw", "out")
    verb("build-linkgraph", "dumps", "out")
    verb("build-backlinks", "out")
    verb("embed", "out")
    verb("build-index", "out").add_argument("--index-type", choices=kinds, default="auto")
    verb("mine-triplets", "out", "target")
    v = verb("search", "out", "query")
    v.add_argument("-k", type=int, default=5)
    v.add_argument("--no-rerank", action="store_true")
    verb("evaluate", "out", "queries")
    verb("inspect-index", "out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = ship(local_session())
    if args.verb == "pipeline":
        build.run(spark, args.raw, args.dumps, args.out, args.index_type, args.with_triplets, overwrite=args.overwrite)
    elif args.verb == "extract":
        build.build_articles(spark, args.raw, args.out, overwrite=args.overwrite)
    elif args.verb == "build-linkgraph":
        build.build_link_graph(spark, args.dumps, args.out, args.overwrite)
    elif args.verb == "build-backlinks":
        build.build_backlinks(spark, args.out, args.overwrite)
    elif args.verb == "embed":
        print(build.build_passages(spark, args.out, overwrite=args.overwrite))
    elif args.verb == "build-index":
        print(build.build_index(spark, args.out, args.index_type, overwrite=args.overwrite))
    elif args.verb == "mine-triplets":
        build.mine(spark, args.out, args.target, overwrite=args.overwrite)
    elif args.verb == "search":
        asked = spark.createDataFrame([(0, args.query)], "qid long, query string")
        for r in build.Engine(spark, args.out).search(asked, args.k, rerank=not args.no_rerank).orderBy("rank").collect():
            print(f"{r['rank']}. {r['title']} {r['score']:.4f} (cosine {r['cosine']:.4f}) {r['url']}\n   {r['snippet'][:220]}")
    elif args.verb == "evaluate":
        for r in build.Engine(spark, args.out).evaluate(readers.read_test_queries(spark, args.queries)).collect():
            print(f"{r['metric']}: {r['value']}")
    elif args.verb == "inspect-index":
        index.inspect(storage.open_table(spark, f"{args.out}/passages").select("idx", F.col("embedding"))).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
