"""Packaged books: containers, structure, notes, pages, errors."""

import pytest
from pyspark.sql import functions as F

import books
from leafwright import api
from leafwright.errors import AnchorError, NotABookError, ProtectedError
from leafwright.sources import epub


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    made = {"clean": books.clean(), "ncx": books.ncx_only(), "stub": books.stub_toc(), "split": books.split_chapter(), "drm": books.encrypted(), "font": books.encrypted("http://www.idpf.org/2008/embedding"), "bad": b"no zip", "blob": books.blob(), "paragraphs": books.paragraphs(), "whole": books.long_but_whole(), "sections": books.toc_only_sections()}
    for name, raw in made.items():
        (path / f"{name}.epub").write_bytes(raw)
    return path


@pytest.fixture(scope="module")
def built(spark, library):
    rows = epub.unpack(epub.scan(spark, str(library))).withColumn("book", F.regexp_extract("book", "([a-z]+)[.]epub", 1)).cache()
    out = epub.build(rows)
    return {k: v.cache() for k, v in out.items()} | {"rows": rows}


def test_status_of_each_file(built):
    got = {r["book"]: r["status"] for r in epub.of(built["rows"], "status").collect()}
    assert got == {"clean": "ok", "ncx": "ok", "stub": "ok", "split": "ok", "drm": "protected", "font": "ok", "bad": "not_a_book", **dict.fromkeys(("blob", "paragraphs", "whole", "sections"), "ok")}


def test_titles(built):
    got = {}
    for r in built["chapters"].orderBy("book", "chapter").collect():
        got.setdefault(r["book"], []).append(r["title"])
    assert got["clean"] == ["One", "Two", "Three"] == got["font"]
    assert got["ncx"] == ["Eins", "Zwei"]
    assert got["stub"] == ["H A", "H B"]
    assert got["split"] == ["One", "Two"]


def test_chapter_over_several_files(built):
    row = built["chapters"].where("book = 'split' AND chapter = 0").first()
    assert row["paths"] == ["OPS/a.xhtml", "OPS/b.xhtml"]


def test_notes_leave_the_prose_and_are_numbered(built):
    blocks = built["blocks"].where("book = 'clean' AND chapter = 0").orderBy("block").collect()
    assert blocks[1]["text"] == "First text[^1] goes on."
    assert [(n["number"], n["text"]) for n in blocks[1]["footnotes"]] == [(1, "The note.")]
    assert not any("The note." in b["text"] for b in blocks)


def test_markup_of_any_depth():
    import time

    from leafwright.sources import markup

    begun = time.process_time()
    rows = markup.records("x", "<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000 + "<p>after</p>")
    assert [r["text"] for r in rows if r["record"] == "block"] == ["deep", "after"] and time.process_time() - begun < 20


def test_page_marks_and_note_holders():
    from leafwright.sources import markup

    page = '<p id="a">zero <span epub:type="pagebreak" id="p7" title="7"/> still</p><p>same</p><div id="p8"><p>eight</p></div><span epub:type="pagebreak" id="p9">9</span><p>nine<a href="#n1">1</a></p><div class="footnotes"><p id="n1">The note.</p></div>'
    rows = markup.records("x", f"<body>{page}</body>", {"p8": "viii"})
    assert [(r["text"].split()[0][:4], r["page"]) for r in rows if r["record"] == "block"][:4] == [("zero", None), ("same", None), ("eigh", "viii"), ("9", "9")]
    assert [(r["id"], r["kind"], r["text"]) for r in rows if r["record"] == "note"] == [("n1", "strong", "The note.")]


def test_warnings(built):
    got = {}
    for r in built["warnings"].orderBy("book", "ord").collect():
        got.setdefault(r["book"], []).append(r["message"])
    assert "stub" in got["stub"][0] and "clean" not in got and "split" not in got


def test_pages_ruby_and_tables(built):
    blocks = built["blocks"].where("book = 'clean' AND chapter = 1").orderBy("block").collect()
    by = {b["text"]: b for b in blocks}
    assert by["Before."]["page"] is None and by["After 漢(kan)."]["page"] == "7"
    assert by["| h\\|1 | h2 |\n| --- | --- |\n| v |  |"]["kind"] == "table"


def test_anchors_are_unique_and_dense(built):
    assert built["blocks"].groupBy("book", "anchor").count().where("count > 1").count() == 0


def test_long_blocks_are_split_within_budget(built):
    rows = built["blocks"].where("book = 'clean' AND chapter = 2").collect()
    assert len(rows) > 4 and max(r["tokens"] for r in rows) <= 800
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: r["block"]) if r["text"].strip().startswith("Long")).count("Long one!") == 900


def test_metadata(built):
    row = epub.metadata(built["rows"]).where("book = 'clean'").first()
    assert (row["title"], row["authors"], row["language"]) == ("A Title", ["One", "Two"], "en")


def test_listing_reads_no_contents(spark, library):
    rows = epub.listing(spark, str(library)).collect()
    assert len(rows) == 11 and all(r["bytes"] > 0 for r in rows)


def test_container_only(spark, library):
    rows = epub.unpack(epub.scan(spark, str(library)), container_only=True)
    assert epub.of(rows, "block").count() == 0 and epub.of(rows, "spine").count() == 17


def test_chapters_from_prose(built):
    rows = built["chapters"].where("book IN ('blob', 'paragraphs', 'whole')").orderBy("book", "chapter").collect()
    got = {}
    for r in rows:
        got.setdefault(r["book"], []).append(r["title"])
        assert r["book"] == "whole" or (r["synthetic"] and r["paths"] == [] and r["depth"] == 0 and r["grp"] == "" and not r["title_from_toc"])
    assert got["blob"] == ["第一回 松下問童子 言師採藥去", "第二回 只在此山中 雲深不知處", "第三回 空山不見人 但聞人語響"]
    assert got["paragraphs"] == ["CHAPTER 1 The first part", "CHAPTER 2 The second part", "CHAPTER 3 The third part"]
    assert got["whole"] == ["Whole"]
    blocks = built["blocks"].where("book IN ('blob', 'paragraphs')").orderBy("book", "chapter", "block").collect()
    assert not any("———" in b["text"] or "-----" in b["text"] for b in blocks)
    heads = [b for b in blocks if b["block"] == 0]
    assert len(heads) == 6 and all(b["dedup"] and b["kind"] == "heading" and b["text"] == b["title"] for b in heads)
    said = "".join(b["text"] for b in blocks if b["book"] == "blob" and b["block"] > 0)
    assert said == books._prose(8000) * 2 + "第四回中又說起那童子來。" + books._prose(8000)
    assert max(b["tokens"] for b in blocks) <= 800
    warned = {r["book"] for r in built["warnings"].where("message LIKE '%prose%'").collect()}
    assert warned == {"blob", "paragraphs"}


def test_sections_of_the_table_of_contents(spark, library):
    found = api.open_book(spark, str(library / "sections.epub")).outline(2)[0]["sections"]
    assert [(s["title"], s["level"], s["source"], s["tokens"]) for s in found] == [("One", 1, "heading", 0), ("By the table", 0, "toc", 4), ("Heading", 2, "heading", 2)][1:]


def test_single_book_calls(spark, library):
    b = api.open_book(spark, str(library / "clean.epub"))
    assert b.stats()["chapters"] == 3
    assert [n["title"] for n in b.outline(1)] == ["One", "Two", "Three"]
    assert b.outline(2)[1]["sections"][0]["title"] == "Inner"
    assert [h["anchor"] for h in b.search("goes on")] == ["c0p1"]
    one = b.read("c0", max_tokens=10)
    assert one["truncated"] and one["next_anchor"]
    assert b.read("Two")["chapter_title"] == "Two"
    assert all(c["tokens"] <= 800 for c in b.chunks())
    assert b.markdown()["text"].startswith("# A Title")
    assert b.read("c0p4", max_tokens=50)["next_anchor"] == "c1p1"
    with pytest.raises(AnchorError):
        b.read("c9")
    with pytest.raises(AnchorError):
        b.read("no such title")


def test_single_book_errors(spark, library):
    with pytest.raises(NotABookError):
        api.open_book(spark, str(library / "bad.epub"))
    with pytest.raises(NotABookError):
        api.open_book(spark, str(library / "missing.epub"))
    with pytest.raises(ProtectedError):
        api.open_book(spark, str(library / "drm.epub"))
