"""V7: ``python -m helixframe.cli ingest USER FILE`` and ``query USER TARGET``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from helixframe.operators.evidence import evidence
from helixframe.plans.ingest import Ingestion
from helixframe.sources.annotations import read_annotations
from helixframe.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="helixframe")
    parser.add_argument("--store", default="helix-store")
    parser.add_argument("--annotations", help="a tab-separated file, stored if the store has none")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("user"), ingest.add_argument("file")
    query = commands.add_parser("query")
    query.add_argument("user"), query.add_argument("target")
    query.add_argument("--profile", default="cli")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    store = Store(spark, args.store)
    if args.annotations:
        store.write_annotations(read_annotations(spark, args.annotations))
    if args.command == "ingest":
        print(json.dumps(Ingestion(spark, store, lambda p: print(f"{p.percentage:.0f}% {p.step} {p.message}")).run(args.user, args.file)))
    else:
        rows = evidence(store.variants(args.user), store.annotations(), args.target, args.profile).collect()
        print(json.dumps([r.asDict() for r in rows], indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
