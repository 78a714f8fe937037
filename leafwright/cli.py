"""Command line: ``python -m leafwright.cli COMMAND BOOK``; ``--json`` for JSON."""

from __future__ import annotations

import argparse
import json
import sys

from leafwright import __version__
from leafwright.errors import LeafwrightError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafwright")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("book")
        c.add_argument("--json", action="store_true")
        return c

    add("info")
    add("doctor")
    add("outline").add_argument("--depth", type=int, default=2)
    c = add("read")
    c.add_argument("anchor")
    c.add_argument("--max-tokens", type=int)
    c = add("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--all-terms", action="store_true")
    c.add_argument("--regex", action="store_true")
    c.add_argument("--max-tokens", type=int, default=400)
    c.add_argument("--chapter")
    c = add("chunks")
    c.add_argument("--max-tokens", type=int, default=800)
    c.add_argument("--overlap", type=int, default=0)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--jsonl", action="store_true")
    c = add("md")
    c.add_argument("-o", "--output")
    c.add_argument("--anchors", action="store_true")
    c.add_argument("--start", type=int, default=0)
    c.add_argument("--end", type=int)
    c.add_argument("--max-tokens", type=int)
    return p


def answer(a: argparse.Namespace, spark) -> object:
    from leafwright import api

    b = api.open_book(spark, a.book)
    if a.command == "info":
        return b.info()
    if a.command == "doctor":
        return b.doctor()
    if a.command == "outline":
        return b.outline(a.depth)
    if a.command == "read":
        return b.read(a.anchor, a.max_tokens)
    if a.command == "search":
        return b.search(a.query, a.limit, a.all_terms, a.regex, a.max_tokens, a.chapter)
    if a.command == "chunks":
        return b.chunks(a.max_tokens, a.overlap, a.offset, a.limit or None)
    return b.markdown(a.max_tokens, a.anchors, a.start, a.end)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("leafwright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = answer(a, spark)
    except LeafwrightError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    dump = lambda x, **k: json.dumps(x, ensure_ascii=False, default=str, **k)
    if a.command == "md" and a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out["text"])
    elif a.command == "chunks" and a.jsonl:
        print("\n".join(dump(x) for x in out))
    elif a.json or a.command not in ("md", "read"):
        print(dump(out, indent=2))
    else:
        print(out["text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
