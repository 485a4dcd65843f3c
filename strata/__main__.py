"""python -m strata STORE search|restore|ingest|reset ...: S19, with its exit codes: 2 for bad input or a failure, 3 for no hits, 4 for a missing id."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from strata.operators import parse
from strata.plans import service
from strata.sources.store import Store


def parse_stdin(argv: list[str], spark: SparkSession | None = None) -> int:
    """Python -m strata parse --lang python|go|typescript < FILE: the file's table of contents and lines as JSON."""
    parser = argparse.ArgumentParser(prog="strata parse")
    parser.add_argument("--lang", required=True, choices=["python", "go", "typescript"])
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    rows = spark.createDataFrame([(0, sys.stdin.read(), a.lang)], "k int, content string, lang string")
    print(parse.source_json(rows, "k", "content", "lang").first()["json"])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["parse"]:
        return parse_stdin(argv[1:], spark)
    parser = argparse.ArgumentParser(prog="strata")
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("search")
    p.add_argument("q")
    p.add_argument("--format", default="json")
    p.add_argument("--detail", default="")
    p.add_argument("--fields", default="")
    p.add_argument("--project-id")
    p.add_argument("--top-k", default=5)
    p = commands.add_parser("restore")
    p.add_argument("--l1-id", default="")
    p.add_argument("--l2-id", default="")
    p = commands.add_parser("ingest")
    p.add_argument("path")
    p = commands.add_parser("reset")
    p.add_argument("--project-id")
    p.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(argv)
    store = Store(spark or SparkSession.builder.getOrCreate(), a.store)
    try:
        if a.command == "search":
            rows = service.search(store, a.q, a.format, a.detail, a.fields, a.project_id, a.top_k).collect()
            if not rows or (a.format == "markdown" and not rows[0]["markdown"]):
                return 3
            print(rows[0]["markdown"] if a.format == "markdown" else json.dumps([r.asDict() for r in rows], ensure_ascii=False))
        elif a.command == "restore":
            rows = service.restore(store, a.l1_id, a.l2_id).collect()
            if not rows:
                return 4
            print(rows[0]["content"])
        elif a.command == "ingest":
            print(json.dumps(service.ingest(store, a.path)))
        else:
            print(json.dumps(service.reset(store, a.project_id, a.dry_run)))
    except service.ServiceError as e:
        print(json.dumps(e.as_dict()), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
