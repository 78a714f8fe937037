"""A server of tools over packaged books: JSON-RPC 2.0, one message a line, on standard input and output.

``python -m leafwright.server``. Answers are bounded by default: ten chunks, 4,000 tokens of Markdown. It answers for one reader;
many books are a job over ``leafwright.sources.epub``.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import BinaryIO

from leafwright import __version__, api
from leafwright.errors import LeafwrightError, NotABookError

# Versions of the protocol, the newest last; names, arguments and default limits of the tools; codes of errors.
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18")
OPEN_BOOKS, HITS, SNIPPET, CHUNK, CHUNKS, MARKDOWN = 4, 20, 400, 800, 10, 4000
UNREADABLE, NOT_A_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

ABOUT = "Books with addresses: c3 is a chapter, c3p12 a block. Ask epub_info and epub_outline first: they are cheap. Find places by epub_search, read on from them by epub_read and its next_anchor. Markdown and chunks are for whole texts; take them page by page."


class Shelf:
    """The books opened last, each until its file changes; beyond ``most`` the one that came first goes."""

    def __init__(self, spark, most: int = OPEN_BOOKS) -> None:
        self.spark, self.most = spark, most
        self._books: dict[str, tuple[tuple[int, int], api.Book]] = {}

    def get(self, path: object) -> api.Book:
        if not path:
            raise NotABookError("which book? its path is missing")
        at = os.path.abspath(os.path.expanduser(str(path)))
        if not os.path.isfile(at):
            raise NotABookError(f"no such file: {at}")
        info = os.stat(at)
        version = info.st_mtime_ns, info.st_size
        held = self._books.get(at)
        if held is None or held[0] != version:
            held = self._books[at] = version, api.open_book(self.spark, at)
            for old in list(self._books)[: max(0, len(self._books) - self.most)]:
                del self._books[old]
        return held[1]

    def __len__(self) -> int:
        return len(self._books)


@dataclass(frozen=True)
class Tool:
    about: str
    run: Callable[[Shelf, dict], dict]
    #: argument: (JSON type, what it is)
    takes: dict[str, tuple[str, str]] = field(default_factory=dict)
    needs: tuple[str, ...] = ("book",)

    def schema(self) -> dict:
        every = {**({"book": ("string", "path of the book's file")} if "book" in self.needs else {}), **self.takes}
        return {"type": "object", "properties": {n: {"type": t, "description": d} for n, (t, d) in every.items()}, "required": list(self.needs)}


def _number(given: dict, name: str, default: int | None) -> int | None:
    """A whole number; missing, null and 0 are the default."""
    return int(given.get(name) or 0) or default


def _outline(shelf: Shelf, a: dict) -> dict:
    book = shelf.get(a.get("book"))
    entries = book.outline(_number(a, "depth", 2))
    return {"title": book.name, "chapters": len(book.chapters), "tokens": sum(e["tokens"] for e in entries), "outline": entries}


def _search(shelf: Shelf, a: dict) -> dict:
    hits = shelf.get(a.get("book")).search(a.get("query") or "", _number(a, "limit", HITS), bool(a.get("all_terms")), bool(a.get("regex")), _number(a, "snippet_tokens", SNIPPET))
    return {"query": a.get("query"), "count": len(hits), "hits": hits}


def _chunks(shelf: Shelf, a: dict) -> dict:
    book, size, offset = shelf.get(a.get("book")), _number(a, "max_tokens", CHUNK), _number(a, "offset", 0)
    total, rows = book.chunk_count(size), book.chunks(size, 0, offset, _number(a, "limit", CHUNKS))
    end = offset + len(rows)
    return {"total_chunks": total, "offset": offset, "returned": len(rows), "next_offset": end if end < total else None, "chunks": rows}


def _markdown(shelf: Shelf, a: dict) -> dict:
    # an explicit 0 asks for everything
    most = MARKDOWN if a.get("max_tokens") is None else int(a["max_tokens"]) or None
    end = a.get("end_chapter")
    return shelf.get(a.get("book")).markdown(most, bool(a.get("anchors")), _number(a, "start_chapter", 0), None if end is None else int(end))


def _read(shelf: Shelf, a: dict) -> dict:
    if a.get("anchor") is None:
        raise ValueError("anchor is missing")
    return shelf.get(a.get("book")).read(a["anchor"], _number(a, "max_tokens", None))


def _list(shelf: Shelf, a: dict) -> dict:
    top = os.path.abspath(os.path.expanduser(str(a.get("directory") or ".")))
    if not os.path.isdir(top):
        raise NotABookError(f"no such directory: {top}")
    paths = sorted(os.path.join(at, n) for at, _, names in os.walk(top) for n in names if n.lower().endswith(".epub"))
    return {"directory": top, "count": len(paths), "books": [{"path": p, "bytes": os.path.getsize(p)} for p in paths]}


TOOLS = {
    "epub_info": Tool("Metadata, sizes and warnings of a book.", lambda shelf, a: shelf.get(a.get("book")).info()),
    "epub_outline": Tool("Chapters with anchors, tokens, pages and sections.", _outline, {"depth": ("integer", "1 for chapters only; 2, the default, with sections")}),
    "epub_read": Tool("Text from a place on, and where to go on.", _read, {"anchor": ("string", "c3, c3p12 or a chapter's title"), "max_tokens": ("integer", "stop after about so many; without it at the chapter's end")}, ("book", "anchor")),
    "epub_search": Tool(
        "Blocks, with their notes, that hold a text.", _search,
        {"query": ("string", "what to find"), "limit": ("integer", f"hits at most, {HITS}"), "all_terms": ("boolean", "each word anywhere in the block"), "regex": ("boolean", "the query is a pattern"), "snippet_tokens": ("integer", f"tokens of a hit at most, {SNIPPET}")}, ("book", "query"),
    ),
    "epub_chunks": Tool("Pieces of bounded size, a page of them.", _chunks, {"max_tokens": ("integer", f"tokens of a piece, {CHUNK}"), "offset": ("integer", "pieces to pass over"), "limit": ("integer", f"pieces to return, {CHUNKS}")}),
    "epub_markdown": Tool(
        "Chapters as Markdown, and the chapter where it stopped.", _markdown,
        {"anchors": ("boolean", "anchors as comments"), "start_chapter": ("integer", "number of the first"), "end_chapter": ("integer", "number of the last"), "max_tokens": ("integer", f"tokens at most, {MARKDOWN}; 0 for no limit")},
    ),
    "epub_list": Tool("Book files under a directory.", _list, {"directory": ("string", "where to look; the working directory without it")}, ()),
}


class Server:
    def __init__(self, shelf: Shelf) -> None:
        self.shelf = shelf
        self.protocol = PROTOCOLS[-1]

    def answer(self, message: object) -> dict | None:
        """The response to a message; None for a notification."""
        if not isinstance(message, dict):
            return _failure(None, NOT_A_REQUEST, "a request is an object")
        method, id_, params = message.get("method"), message.get("id"), message.get("params") or {}
        methods = {"initialize": self._hello, "ping": lambda p: {}, "tools/list": self._tools, "tools/call": self._call}
        if method not in methods:
            return None if id_ is None else _failure(id_, NO_METHOD, f"no such method: {method}")
        try:
            if not isinstance(params, dict):
                raise _Refused("params must be an object")
            return {"jsonrpc": "2.0", "id": id_, "result": methods[method](params)}
        except _Refused as e:
            return _failure(id_, BAD_PARAMS, str(e))

    def _hello(self, params: dict) -> dict:
        if params.get("protocolVersion") in PROTOCOLS:
            self.protocol = params["protocolVersion"]
        return {"protocolVersion": self.protocol, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "leafwright", "version": __version__}, "instructions": ABOUT}

    def _tools(self, params: dict) -> dict:
        return {"tools": [{"name": n, "description": t.about, "inputSchema": t.schema()} for n, t in TOOLS.items()]}

    def _call(self, params: dict) -> dict:
        tool, given = TOOLS.get(params.get("name")), params.get("arguments") or {}
        if tool is None:
            raise _Refused(f"no such tool: {params.get('name')}")
        if not isinstance(given, dict):
            raise _Refused("arguments must be an object")
        try:
            text, failed = _json(tool.run(self.shelf, given), indent=2), False
        except LeafwrightError as e:
            text, failed = f"{type(e).__name__}: {e}", True
        except (ValueError, TypeError, KeyError) as e:
            text, failed = f"bad arguments: {e}", True
        except Exception as e:  # one failed call does not end the server
            text, failed = f"internal error: {type(e).__name__}: {e}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}


class _Refused(Exception):
    """The parameters of a request can't be used."""


def _failure(id_: object, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def _json(value: object, **more) -> str:
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.asDict(True) if hasattr(x, "asDict") else str(x), **more)


def serve(server: Server, lines: BinaryIO, out: BinaryIO) -> None:
    """Answers each line until the input ends; blank lines are passed over."""
    for raw in lines:
        if not raw.strip():
            continue
        try:
            reply = server.answer(json.loads(raw.decode("utf-8")))
        except ValueError:
            reply = _failure(None, UNREADABLE, "a line is not JSON")
        if reply is not None:
            out.write(_json(reply).encode() + b"\n")
            out.flush()


def main(argv: list[str] | None = None) -> int:
    import argparse

    p = argparse.ArgumentParser(prog="leafwright.server", description="Tools over packaged books on standard input and output: " + ", ".join(TOOLS))
    p.add_argument("--version", action="version", version=__version__)
    p.parse_args(argv)
    from pyspark.sql import SparkSession

    # the protocol owns standard output: whatever else would print there goes to standard error
    out = os.fdopen(os.dup(sys.stdout.fileno()), "wb")
    os.dup2(sys.stderr.fileno(), sys.stdout.fileno())
    spark = SparkSession.builder.appName("leafwright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with contextlib.suppress(KeyboardInterrupt, BrokenPipeError):
        serve(Server(Shelf(spark)), sys.stdin.buffer, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
