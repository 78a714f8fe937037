"""The server of tools and the command line, over small books."""

import io
import json
import os

import books
import pytest

from leafwright import api, cli, server


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("shelf")
    for name in ("a", "b", "c", "d", "e"):
        (at / f"{name}.epub").write_bytes(books.clean())
    (at / "bad.epub").write_bytes(b"no zip")
    return server.Shelf(spark), at


def talk(shelf, *messages):
    """Replies to messages; a str goes as it is."""
    lines = b"".join((m if isinstance(m, bytes) else json.dumps(m).encode()) + b"\n" for m in messages)
    out = io.BytesIO()
    server.serve(server.Server(shelf), io.BytesIO(lines), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def call(shelf, name, **arguments):
    reply = talk(shelf, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})[0]["result"]
    text = reply["content"][0]["text"]
    return text if reply["isError"] else json.loads(text)


def test_protocol(shelf):
    own = shelf[0]
    hello = {"id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}
    got = talk(own, hello, {"method": "notifications/initialized"}, b"", b"{no", b"\xff", [1], {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, {"id": 4, "method": "x"}, {"method": "x"}, {"id": 5, "method": "tools/call", "params": {"name": "x"}}, {"id": 6, "method": "tools/call", "params": {"name": "epub_list", "arguments": [1]}}, {"id": 7, "method": "initialize", "params": {"protocolVersion": "1"}})
    assert [(g["id"], g["error"]["code"] if "error" in g else 0) for g in got] == [(1, 0), (None, -32700), (None, -32700), (None, -32600), (2, 0), (3, 0), (4, -32601), (5, -32602), (6, -32602), (7, 0)]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" == got[-1]["result"]["protocolVersion"] and got[4]["result"] == {}
    tools = {t["name"]: t["inputSchema"] for t in got[5]["result"]["tools"]}
    assert len(tools) == 7 and tools["epub_read"]["required"] == ["book", "anchor"] and "book" not in tools["epub_list"]["properties"]


def test_tools(shelf):
    own, at = shelf
    path = str(at / "e.epub")
    assert call(own, "epub_info", book=path)["chapters"] == 3
    outline = call(own, "epub_outline", book=path)
    assert outline["title"] == "A Title" and [e["anchor"] for e in outline["outline"]] == ["c0", "c1", "c2"] and outline["tokens"] == call(own, "epub_info", book=path)["tokens"]
    assert [h["anchor"] for h in call(own, "epub_search", book=path, query="goes on")["hits"]] == ["c0p1"]
    one = call(own, "epub_read", book=path, anchor="c0", max_tokens=10)
    assert one["truncated"] and one["next_anchor"]
    first = call(own, "epub_chunks", book=path, max_tokens=100, limit=2)
    assert first["returned"] == 2 and first["next_offset"] == 2 < first["total_chunks"]
    rest = call(own, "epub_chunks", book=path, max_tokens=100, offset=2, limit=1000)
    assert rest["next_offset"] is None and rest["returned"] == first["total_chunks"] - 2
    capped, whole = call(own, "epub_markdown", book=path, max_tokens=40), call(own, "epub_markdown", book=path, max_tokens=0)
    assert capped["truncated"] and not whole["truncated"] and whole["characters"] > capped["characters"]
    assert call(own, "epub_list", directory=str(at))["count"] == 6


def test_failures_are_answers(shelf):
    own, at = shelf
    path = str(at / "e.epub")
    assert "NotABookError" in call(own, "epub_info") and "NotABookError" in call(own, "epub_info", book=str(at / "none.epub")) and "NotABookError" in call(own, "epub_info", book=str(at / "bad.epub"))
    assert "AnchorError" in call(own, "epub_read", book=path, anchor="c99") and "PatternError" in call(own, "epub_search", book=path, query="(", regex=True)
    assert "bad arguments" in call(own, "epub_chunks", book=path, limit="many") and "bad arguments" in call(own, "epub_read", book=path)


def test_shelf_keeps_the_last_books_until_they_change(shelf, monkeypatch):
    at = shelf[1]
    monkeypatch.setattr(api, "open_book", lambda spark, path: [path])
    own = server.Shelf(None)
    first = own.get(at / "a.epub")
    assert own.get(at / "a.epub") is first
    os.utime(at / "a.epub", ns=(1, 1))
    again = own.get(at / "a.epub")
    assert again is not first
    for name in "bcde":
        own.get(at / f"{name}.epub")
    assert len(own) == 4 and own.get(at / "a.epub") is not again


def test_command_line(shelf, tmp_path, capsys, monkeypatch):
    path = shelf[1] / "e.epub"
    held, really = shelf[0].get(path), api.open_book
    monkeypatch.setattr(api, "open_book", lambda spark, p: held if p == str(path) else really(spark, p))
    assert cli.main(["info", str(path)]) == 0 and json.loads(capsys.readouterr().out)["chapters"] == 3
    assert cli.main(["read", str(path), "Two"]) == 0 and "Before." in capsys.readouterr().out
    assert cli.main(["chunks", str(path), "--jsonl", "--limit", "2"]) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["md", str(path), "-o", str(tmp_path / "a.md"), "--anchors"]) == 0 and "<!-- c0p1 -->" in (tmp_path / "a.md").read_text()
    capsys.readouterr()
    assert cli.main(["read", str(path), "c99"]) == 1 and capsys.readouterr().err
    assert cli.main(["info", str(tmp_path / "none.epub")]) == 1


def test_ingest_takes_each_file_once(spark, tmp_path):
    from leafwright.streaming.ingest import ingest

    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    count = lambda name: spark.read.option("basePath", str(tmp_path / "out" / name)).parquet(str(tmp_path / "out" / name)).count()
    (source / "a.epub").write_bytes(books.clean())
    run()
    was = count("blocks")
    run()
    assert count("blocks") == was and count("books") == 1
    (source / "b.epub").write_bytes(books.split_chapter())
    run()
    assert count("books") == 2 and count("blocks") > was and count("chapters") == 5
