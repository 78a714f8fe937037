"""Packaged books: one row per file in, plain relations out.

``scan`` lists files, ``unpack`` parses each file once into rows of all kinds (``RECORD``), and the functions below it
build the relations of a book by joins and windows: chapters, blocks with anchors, numbered notes, pages.
Whatever goes wrong in one file ends up in its ``status`` and stops nothing else.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import rescue, structure
from leafwright.sources import markup as M
from leafwright.sources.shared import Tables

MAX_MEMBER_BYTES, MAX_RATIO = 64 << 20, 200
# Namespaces of encryption that only hides fonts, and the types that hold prose.
FONT_SCHEMES = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
PROSE_TYPES = ("application/xhtml+xml", "text/html", "application/x-dtbook+xml", "text/x-oeb1-document", "")
FIELDS = ("title", "creator", "language", "identifier", "publisher", "date", "description", "rights", "subject")
RECORD = "book string, status string, record string, path string, pos long, ord long, kind string, level long, depth long, id string, text string, page string, inside array<string>, raw string, extra string, flag boolean"
_NAMES = [x.strip().split(" ")[0] for x in RECORD.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _ARROW[x.strip().split(" ", 1)[1]]) for n, x in zip(_NAMES, RECORD.split(", "), strict=True)])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all ``.epub`` files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes only; contents are not read."""
    return scan(spark, path).select("path", F.col("length").alias("bytes")).orderBy("path")


def resolve(base: str, href: str) -> tuple[str, str]:
    """(path in the archive, fragment) of a link: split at the first ``#`` before both parts are unquoted."""
    path, _, fragment = href.partition("#")
    path = unquote(path)
    if not path:
        return "", unquote(fragment)
    joined = path.lstrip("/") if path.startswith("/") else posixpath.join(base, path)
    return posixpath.normpath(joined).lstrip("/"), unquote(fragment)


class Archive:
    """Members of a zip, found by name, else by name in any case."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.info = {i.filename: i for i in self.zip.infolist()}
        self.lower: dict[str, str] = {}
        for name in self.info:
            self.lower.setdefault(name.lower(), name)

    def read(self, path: str) -> bytes | None:
        info = self.info.get(path) or self.info.get(self.lower.get(path.lower(), ""))
        if info is None:
            return None
        if info.file_size > MAX_MEMBER_BYTES or info.file_size > MAX_RATIO * max(info.compress_size, 1) + (1 << 20):
            raise ValueError(f"{path} is too large or too densely packed")
        return self.zip.read(info)

    def tree(self, path: str) -> M.Node | None:
        raw = self.read(path)
        return None if raw is None else M.parse(M.decode(raw))


def _protected(archive: Archive) -> bool:
    tree = archive.tree("META-INF/encryption.xml")
    if tree is None:
        return False
    for data in tree.all("encrypteddata"):
        method = data.find("encryptionmethod")
        scheme = method.attrs.get("algorithm", "") if method else ""
        uri = next((n.attrs.get("uri", "") for n in data.all("cipherreference")), "")
        if scheme not in FONT_SCHEMES and not re.search(r"\.(otf|ttf|ttc|eot|woff2?)$", uri, re.I):
            return True
    return False


def _list_entries(node: M.Node, depth: int, base: str, out: list[dict]) -> None:
    for item in (c for c in node.children if isinstance(c, M.Node)):
        if item.tag != "li":
            if item.tag in ("ol", "ul"):
                _list_entries(item, depth, base, out)
            continue
        own = [c for c in item.children if isinstance(c, M.Node)]
        link = next((c for c in own if c.tag == "a"), None) or next((c for c in own if c.tag not in ("ol", "ul")), None)
        if link is not None and M.collapse(link.text()):
            inner = link if link.tag == "a" else link.find("a")
            path, fragment = resolve(base, inner.attrs.get("href", "")) if inner is not None else ("", "")
            out.append({"depth": depth, "text": M.collapse(link.text()), "path": path, "id": fragment})
        for c in own:
            if c.tag in ("ol", "ul"):
                _list_entries(c, depth + 1, base, out)


def _nav(tree: M.Node, base: str) -> tuple[list[dict], list[dict]]:
    navs = tree.all("nav")
    typed = lambda n: n.attrs.get("epub:type", n.attrs.get("role", ""))
    toc = next((n for n in navs if "toc" in typed(n)), None) or next((n for n in navs if not typed(n)), None)
    pages = next((n for n in navs if "page-list" in typed(n)), None)
    out: list[list[dict]] = [[], []]
    for k, nav in enumerate((toc, pages)):
        if nav is None:
            continue
        lists = nav.find("ol", "ul")
        if lists is not None:
            _list_entries(lists, 0, base, out[k])
        else:
            for a in nav.all("a"):
                path, fragment = resolve(base, a.attrs.get("href", ""))
                out[k].append({"depth": 0, "text": M.collapse(a.text()), "path": path, "id": fragment})
    return out[0], out[1]


def _ncx(tree: M.Node, base: str) -> list[dict]:
    out: list[dict] = []

    def go(node: M.Node, depth: int) -> None:
        for c in (x for x in node.children if isinstance(x, M.Node)):
            if c.tag != "navpoint":
                go(c, depth)
                continue
            label = next((x for x in c.children if isinstance(x, M.Node) and x.tag == "navlabel"), None)
            content = next((x for x in c.children if isinstance(x, M.Node) and x.tag == "content"), None)
            if label is not None and M.collapse(label.text()):
                path, fragment = resolve(base, content.attrs.get("src", "")) if content is not None else ("", "")
                out.append({"depth": depth, "text": M.collapse(label.text()), "path": path, "id": fragment})
            go(c, depth + 1)

    if (top := tree.find("navmap")) is not None:
        go(top, 0)
    return out


def unpack_one(book: str, content: bytes | None, container_only: bool = False) -> list[dict]:
    """All rows of one file. The first is its status: ok, not_a_book, protected or an error's text."""
    try:
        archive = Archive(content or b"")
        container = archive.tree("META-INF/container.xml")
    except Exception:
        return [{"book": book, "status": "not_a_book", "record": "status"}]
    if container is None:
        return [{"book": book, "status": "not_a_book", "record": "status"}]
    try:
        if _protected(archive):
            return [{"book": book, "status": "protected", "record": "status"}]
        rows = list(_rows(archive, container, container_only))
    except Exception as e:
        return [{"book": book, "status": f"error: {e}", "record": "status"}]
    return [{"book": book, "status": "ok", "record": "status", "level": len(archive.info)}, *({"book": book, "status": "ok", **r} for r in rows)]


def _rows(archive: Archive, container: M.Node, container_only: bool) -> Iterator[dict]:
    opf = next((posixpath.normpath(unquote(n.attrs["full-path"])).lstrip("/") for n in container.all("rootfile") if n.attrs.get("full-path")), "")
    package = archive.tree(opf)
    if package is None:
        raise ValueError("the package document is missing")
    base = posixpath.dirname(opf)
    yield {"record": "meta", "kind": "opf_path", "text": opf, "pos": 0}
    head = package.find("metadata")
    for pos, n in enumerate(head.walk() if head is not None else ()):
        if n.tag in FIELDS and (value := M.collapse(n.text())):
            yield {"record": "meta", "kind": n.tag, "text": value, "pos": pos}
        elif n.tag == "meta":
            name = n.attrs.get("name") or n.attrs.get("property") or ""
            value = n.attrs.get("content") or M.collapse(n.text())
            kind = {"calibre:series": "series", "calibre:series_index": "series_index", "dcterms:modified": "modified"}.get(name)
            if kind and value:
                yield {"record": "meta", "kind": kind, "text": value, "pos": pos}
    top = package.find("package")
    yield {"record": "meta", "kind": "version", "text": (top.attrs.get("version", "") if top is not None else ""), "pos": 0}
    manifest: dict[str, dict] = {}
    for pos, n in enumerate(package.all("item")):
        if n.attrs.get("id") and n.attrs.get("href"):
            manifest[n.attrs["id"]] = {"record": "manifest", "id": n.attrs["id"], "path": resolve(base, n.attrs["href"])[0], "kind": n.attrs.get("media-type", ""), "extra": n.attrs.get("properties", ""), "pos": pos}
    yield from manifest.values()
    spine_node = package.find("spine")
    spine = [{"record": "spine", "id": n.attrs["idref"], "path": manifest[n.attrs["idref"]]["path"], "flag": n.attrs.get("linear", "yes").lower() != "no"} for n in package.all("itemref") if n.attrs.get("idref") in manifest]
    for pos, s in enumerate(spine):
        s["pos"] = pos
        yield s
    if container_only:
        return
    labels: dict[str, dict[str, str]] = {}
    nav = next((m for m in manifest.values() if "nav" in m["extra"].split()), None)
    ncx = manifest.get(spine_node.attrs.get("toc", "")) if spine_node is not None else None
    ncx = ncx or next((m for m in manifest.values() if "dtbncx" in m["kind"]), None)
    for src, entry in (("nav", nav), ("ncx", ncx)):
        tree = archive.tree(entry["path"]) if entry else None
        if entry and tree is None:
            yield {"record": "warning", "text": f"{src} document is missing: {entry['path']}", "ord": 0}
        if tree is None:
            continue
        found, pages = _nav(tree, posixpath.dirname(entry["path"])) if src == "nav" else (_ncx(tree, posixpath.dirname(entry["path"])), [])
        for ord_, e in enumerate(found):
            yield {"record": "toc", "kind": src, "ord": ord_, **e}
        for e in pages:  # entries of a page list, the first of each place
            labels.setdefault(e["path"], {}).setdefault(e["id"], e["text"])
        for ord_, e in enumerate(pages):
            yield {"record": "page", "ord": ord_, "path": e["path"], "id": e["id"], "text": e["text"]}
    apart = {m["path"] for m in (nav, ncx) if m}
    for s in spine:
        if s["path"] in apart or manifest[s["id"]]["kind"] not in PROSE_TYPES:
            continue
        raw = archive.read(s["path"])
        if raw is None:
            yield {"record": "warning", "text": f"missing document: {s['path']}", "ord": s["pos"] + 1}
            continue
        for r in M.records(s["path"], M.decode(raw), {**labels.get("", {}), **labels.get(s["path"], {})}):
            yield {**r, "ord": s["pos"]}


def unpack(files: DataFrame, container_only: bool = False) -> DataFrame:
    """Rows (``RECORD``) of all files, from ``path`` and ``content``; each file is parsed once, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = unpack_one(path, content.as_py(), container_only)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _NAMES} for r in rows[at : at + 10_000]], _SCHEMA)

    return files.select("path", "content").mapInArrow(run, RECORD)


def of(rows: DataFrame, record: str) -> DataFrame:
    return rows.where(F.col("record") == record)


def metadata(rows: DataFrame) -> DataFrame:
    """One row per book: the first value of each field, and all distinct creators and subjects in order."""
    meta = of(rows, "meta")
    one = meta.groupBy("book").pivot("kind", [*(f for f in FIELDS if f not in ("creator", "subject")), "series", "series_index", "modified", "version", "opf_path"]).agg(F.min_by("text", "pos"))
    many = meta.groupBy("book").agg(*(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "text")))), lambda x: x["text"])).alias(n) for k, n in (("creator", "authors"), ("subject", "subjects"))))
    return one.join(many, "book")


def build(rows: DataFrame, tables: Tables | None = None) -> dict[str, DataFrame]:
    """The relations of all books in ``rows``: chapters, blocks, toc, notes, warnings.

    What is read more than once is written as ``tables``, so that it is made once; discard them when the relations have been
    used. ``rows`` should be persisted.
    """
    tables = tables or Tables(rows.sparkSession)
    toc_all = of(rows, "toc").select("book", F.col("kind").alias("src"), "ord", "depth", F.col("text").alias("title"), "path", F.col("id").alias("fragment"))
    toc = structure.toc_ancestors(toc_all.join(structure.choose_toc(toc_all), ["book", "src"]))
    toc = tables.write(toc, "toc")
    spine = of(rows, "spine").select("book", "path", F.col("pos").alias("spine_pos"))
    raw = of(rows, "block").select("book", F.col("ord").alias("spine_pos"), "path", F.col("pos").alias("block_pos"), "kind", "level", "text", "page", F.col("id").alias("src_id"), "inside", "raw")

    # notes: a strong body goes out of the prose; the first definition in the same document counts, else in the book
    notes = of(rows, "note").select("book", "path", "id", "kind", "text", "ord", "pos")
    strong = notes.where("kind = 'strong'").select("book", "path", "id").distinct()
    hidden = raw.select("book", "path", "block_pos", F.explode("inside").alias("id")).join(strong, ["book", "path", "id"]).select("book", "path", "block_pos").distinct()
    raw = tables.write(raw.join(hidden, ["book", "path", "block_pos"], "left_anti"), "raw")

    # starts: by the table of contents; by headings if it has none, or one only where headings have more
    ids = of(rows, "id").groupBy("book", "path", "id").agg(F.min("pos").alias("block_pos"))
    by_toc = structure.chapter_starts(toc, spine).select("book", "path", F.col("fragment").alias("id"), "title", "depth", F.array_join("ancestors", " > ").alias("grp"), "ord")
    by_toc = structure.resolve_cuts(by_toc, ids, ["book", "path"], "id", "block_pos", "ord").select("book", "path", "block_pos", "title", "depth", "grp")
    low = raw.where("kind = 'heading'").withColumn("low", F.min("level").over(Window.partitionBy("book", "path"))).where("level = low AND low <= 2")
    by_heading = low.select("book", "path", "block_pos", F.col("text").alias("title"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("grp"))
    n_toc, n_head = (d.groupBy("book").agg(F.count("*").alias(n)) for d, n in ((by_toc, "nt"), (by_heading, "nh")))
    books = of(rows, "status").where("status = 'ok'").select("book")
    choice = books.join(n_toc, "book", "left").join(n_head, "book", "left").select("book", F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("nh", F.lit(0)).alias("nh"))
    choice = choice.withColumn("headings", (F.col("nt") == 0) | ((F.col("nt") == 1) & (F.col("nh") > 1)))
    starts = by_toc.join(choice.where("NOT headings").select("book"), "book").withColumn("from_toc", F.lit(True)).unionByName(by_heading.join(choice.where("headings").select("book"), "book").withColumn("from_toc", F.lit(False)))
    starts = tables.write(starts, "starts")

    # segments: everything up to the next start belongs to the open chapter
    # a start whose block was hidden or empty opens at the next block of its document
    missing = starts.join(raw, ["book", "path", "block_pos"], "left_anti")
    later = missing.alias("m").join(raw.alias("r"), F.expr("m.book = r.book AND m.path = r.path AND r.block_pos > m.block_pos")).groupBy("m.book", "m.path", F.col("m.block_pos").alias("was"), "m.title", "m.depth", "m.grp", "m.from_toc").agg(F.min("r.block_pos").alias("block_pos"))
    moved = later.join(starts.select("book", "path", "block_pos"), ["book", "path", "block_pos"], "left_anti").select("book", "path", "block_pos", "title", "depth", "grp", "from_toc")
    marked = raw.join(starts.unionByName(moved).withColumn("n", F.row_number().over(Window.partitionBy("book", "path", "block_pos").orderBy("title"))).where("n = 1").drop("n"), ["book", "path", "block_pos"], "left").withColumn("start", F.col("from_toc").isNotNull())
    segs = structure.islands(marked, ["book"], ["spine_pos", "block_pos"], "start", "seg").where("text <> '' OR kind = 'hr'")
    segs = tables.write(segs, "segments")
    heads = segs.groupBy("book", "seg").agg(
        F.max("title").alias("toc_title"), F.max("depth").alias("depth"), F.max("grp").alias("grp"), F.coalesce(F.bool_or("from_toc"), F.lit(False)).alias("title_from_toc"),
        F.min_by("text", F.when(F.col("kind") == "heading", F.struct("spine_pos", "block_pos"))).alias("head"), F.bool_and(F.col("kind").isin("image", "figure", "hr")).alias("pictures"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("spine_pos", "path"))), lambda x: x["path"])).alias("paths"),
    )
    number = F.row_number().over(Window.partitionBy("book").orderBy("seg")) - 1
    heads = heads.withColumn("chapter", number.cast("long"))
    title = F.coalesce(F.nullif(F.col("toc_title"), F.lit("")), F.col("head"), F.when(F.col("pictures"), "Cover"), F.concat(F.lit("Untitled section "), (F.col("chapter") + 1).cast("string")))
    heads = heads.select("book", "seg", "chapter", title.alias("title"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("grp", F.lit("")).alias("grp"), "title_from_toc", "paths")
    body = segs.drop("title", "depth", "grp", "from_toc", "start").join(heads.select("book", "seg", "chapter", "title", "grp"), ["book", "seg"])
    body, missing_notes = _notes(body, notes)
    opens = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("spine_pos", "block_pos")) - 1
    same = (F.col("kind") == "heading") & (T.same_title(F.col("text")) == T.same_title(F.col("title")))
    body = body.withColumns({"tokens": T.count_tokens(F.col("text")), "block": opens.cast("long")}).withColumn("dedup", (F.col("block") == 0) & same)
    # chapters that only the prose tells apart; what they are called and numbered follows
    body = rescue.rebuild(tables.write(body, "body"))
    body = body.withColumn("number", (F.dense_rank().over(Window.partitionBy("book").orderBy("chapter", "part")) - 1).cast("long"))
    own = F.col("rescued")
    body = body.withColumns({"was": F.col("chapter"), "chapter": F.col("number"), "title": F.coalesce("part_title", "title"), "grp": F.when(own, F.lit("")).otherwise(F.col("grp"))})
    body = tables.write(body, "parts")
    parts = body.groupBy("book", "was", "number").agg(F.max("rescued").alias("rescued"), F.max("part_title").alias("part_title"))
    heads = heads.join(parts.withColumnRenamed("was", "chapter"), ["book", "chapter"]).select(
        "book", F.col("number").alias("chapter"), F.coalesce("part_title", "title").alias("title"), F.when(own, F.lit(0)).otherwise(F.col("depth")).alias("depth"), F.when(own, F.lit("")).otherwise(F.col("grp")).alias("grp"),
        (F.col("title_from_toc") & ~own).alias("title_from_toc"), F.when(own, F.array().cast("array<string>")).otherwise(F.col("paths")).alias("paths"), own.alias("synthetic"),
    )
    rescued = parts.where("rescued").groupBy("book").agg(F.countDistinct("was").alias("n")).select("book", F.concat(F.lit("chapters were found in the prose of "), F.col("n").cast("string"), F.lit(" long chapter(s)")).alias("message"), F.lit(2 * _LATE).alias("ord"))
    body = rescue.split_blocks(body)
    order = Window.partitionBy("book", "chapter").orderBy("spine_pos", "block_pos", "sub", "piece")
    body = body.withColumn("block", (F.row_number().over(order) - 1).cast("long")).withColumn("dedup", (F.col("block") == 0) & same)
    body = body.withColumns({"anchor": T.anchor(F.col("chapter"), F.col("block")), "src_path": F.col("path")})
    return {
        "blocks": body.select("book", "chapter", "title", "grp", "block", "anchor", "kind", "level", "dedup", "text", "tokens", "page", "footnotes", "src_path", "src_id"),
        "chapters": heads.withColumn("anchor", T.anchor(F.col("chapter"))), "toc": toc, "notes": notes,
        "warnings": structure.dedupe_warnings(of(rows, "warning").select("book", F.col("text").alias("message"), "ord").unionByName(_structure_warnings(choice)).unionByName(missing_notes).unionByName(rescued)),
    }


_LATE = 1 << 40  # warnings of a whole book come after those of its files


def _structure_warnings(choice: DataFrame) -> DataFrame:
    """Books whose chapters start at headings, and why."""
    said = F.when(F.col("nt") == 0, "no TOC: chapters start at headings").otherwise("the TOC is a stub: chapters start at headings")
    return choice.where("headings").select("book", said.alias("message"), F.lit(_LATE).alias("ord"))


def _notes(body: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placeholders become ``[^n]``, numbered by first reference in the book, or what they showed; adds ``footnotes``. And a warning
    for each reference to a note that is not there."""
    shape = f"{M.OPEN}([!?])([^{M.MIDDLE}]*){M.MIDDLE}([^{M.SHUT}]*){M.SHUT}"
    refs = body.where(F.col("text").contains(M.OPEN)).select("book", "chapter", "spine_pos", "block_pos", "path", F.posexplode(F.regexp_extract_all("text", F.lit(f"{M.OPEN}[^{M.SHUT}]*{M.SHUT}"), F.lit(0))).alias("nth", "mark"))
    refs = refs.select("*", (F.regexp_extract("mark", shape, 1) == "!").alias("forced"), T.resolve_href(F.regexp_extract("path", "^(.*)/", 1), F.regexp_extract("mark", shape, 2)).alias("to"))
    refs = refs.withColumns({"to_path": F.when(F.col("to.path") == "", F.col("path")).otherwise(F.col("to.path")), "id": F.col("to.fragment")})
    rank = lambda part: F.row_number().over(Window.partitionBy(*part).orderBy(F.when(F.col("kind") == "strong", 0).otherwise(1), "ord", "pos"))
    own = notes.withColumn("n", rank(["book", "path", "id"])).where("n = 1").select("book", F.col("path").alias("to_path"), "id", F.col("text").alias("own"))
    far = notes.withColumn("n", rank(["book", "id"])).where("n = 1").select("book", "id", F.col("text").alias("far"))
    refs = refs.join(own, ["book", "to_path", "id"], "left").join(far, ["book", "id"], "left").withColumn("said", F.coalesce("own", "far"))
    refs = refs.where("forced OR said IS NOT NULL")
    firsts = refs.groupBy("book", "to_path", "id").agg(F.min(F.struct("spine_pos", "block_pos", "nth")).alias("at"))
    numbers = firsts.withColumn("number", F.rank().over(Window.partitionBy("book").orderBy("at"))).drop("at")
    used = refs.join(numbers, ["book", "to_path", "id"])
    per = used.groupBy("book", "spine_pos", "block_pos").agg(F.array_sort(F.collect_list(F.struct("nth", "mark", "number", F.coalesce("said", F.lit("")).alias("text")))).alias("u"))
    out = body.join(per, ["book", "spine_pos", "block_pos"], "left")
    numbered = F.aggregate("u", F.col("text"), lambda a, x: F.replace(a, x["mark"], F.concat(F.lit("[^"), x["number"].cast("string"), F.lit("]"))))
    text = F.when(F.col("u").isNotNull(), numbered).otherwise(F.col("text"))
    listed = F.array_distinct(F.transform("u", lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"))))
    lost = used.where("said IS NULL").groupBy("book", "to_path", "id").agg(F.min("number").alias("n")).select("book", F.concat(F.lit("note without a body: "), "to_path", F.lit("#"), "id").alias("message"), (F.col("n") + _LATE).cast("long").alias("ord"))
    return out.withColumns({"text": F.regexp_replace(text, shape, "$3"), "raw": F.regexp_replace(F.coalesce("raw", F.lit("")), shape, "$3"), "footnotes": F.coalesce(listed, F.array().cast("array<struct<number:int,text:string>>"))}).drop("u"), lost
