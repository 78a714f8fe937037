"""Markup into rows: a tolerant parser and the blocks of text that reading order gives.

The tree lives inside one call and is never a column. ``records`` yields plain rows, so that notes, pages and chapters
can be resolved by joins and windows afterwards. Note references stay in the text as placeholders
``\\ue000target\\ue001fallback\\ue002``.
"""

from __future__ import annotations


import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head title nav".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
TEXTS = {"p": "para", "pre": "code", "blockquote": "quote", "figcaption": "para", "caption": "para", "summary": "para", "td": "para", "th": "para"}
ITEMS = frozenset("li dd dt".split())
BLOCKS = frozenset((*HEADINGS, *TEXTS, *ITEMS, *"table hr figure div section article aside ul ol dl thead tbody tfoot tr main header footer body html address form nav".split()))
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl div section article aside main body html".split())
MAX_DEPTH = 150
NOTE_HOLDERS = ("footnote", "endnote", "rearnote")
NOTEREF_HINTS = ("noteref", "note-ref", "fnref", "fn-ref", "footnoteref")
_WHITE = re.compile("[ \t\r\n\f\v 　]+")
OPEN, MIDDLE, SHUT = "", "", ""


class Node:
    """An element; text runs are strings among its children."""

    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in order."""
        left = [self]
        while left:
            n = left.pop()
            yield n
            left.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def all(self, tag: str) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag]

    def text(self) -> str:
        out, left = [], self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                left.extend(reversed(c.children))
        return "".join(out)

    def kind(self) -> str:
        """The element's ``epub:type``."""
        return next((v for k, v in self.attrs.items() if k in ("epub:type", "type") and self.tag not in ("a", "input", "ol", "script", "link") or k == "epub:type"), "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.depth, self.flat = 0, Counter()  # elements below MAX_DEPTH stay empty, and their end tags close nothing

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = tag.rpartition(":")[2]
        e = self.at
        while e.up is not None and e.tag not in FENCES:
            if tag in CLOSED_BY.get(e.tag, ()):
                self._leave(e)
                break
            e = e.up
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k.lower(), v or "")
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            if self.depth < MAX_DEPTH:
                self.at, self.depth = node, self.depth + 1
            else:
                self.flat[tag] += 1

    def _leave(self, e: Node) -> None:
        while self.at is not e:
            self.at, self.depth = self.at.up, self.depth - 1
        self.at, self.depth = e.up, self.depth - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag.rpartition(":")[2] not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        tag, e = tag.rpartition(":")[2], self.at
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        while e.up is not None and e.tag != tag:
            e = e.up
        if e.up is not None:
            self._leave(e)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def decode(raw: bytes) -> str:
    """By byte order mark, declared encoding, UTF-8, or UTF-8 with marks for what is wrong."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    tries = ["utf-8"]
    if found := re.search(rb"encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", raw[:200]):
        tries.insert(0, found[1].decode())
    for name in tries:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def parse(text: str) -> Node:
    """The tree of any text; never fails. Below ``MAX_DEPTH`` elements lie side by side. Declarations and processing instructions are left out, entities are never expanded."""
    b = _Builder()
    b.feed(re.sub(r"<\?.*?\?>", "", text, flags=re.S))
    b.close()
    return b.root


def collapse(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ")


def note_kind(node: Node) -> str:
    from leafwright.operators.structure import NOTE_TYPES, STRONG_NOTES, WEAK_NOTES

    kind = node.attrs.get("epub:type", "").lower()
    if "noteref" in kind:
        return ""
    classes = node.attrs.get("class", "").lower()
    tokens = {*re.split(r"[\s\-_]+", classes), *classes.split()}
    if any(t in kind for t in NOTE_TYPES) or tokens & set(STRONG_NOTES):
        return "strong"
    return "weak" if tokens & set(WEAK_NOTES) else ""


class Extractor:
    """Rows of one document: blocks, first places of ids, bodies of notes, page marks."""

    def __init__(self, path: str, labels: dict[str, str] | None = None) -> None:
        self.path, self.rows = path, []
        self.blocks = 0
        self.page: str | None = None
        self.labels = dict(labels or {})  # page labels by id: of a page list first, then of page breaks

    def page_breaks(self, root: Node) -> None:
        for n in root.walk():
            if "pagebreak" in n.attrs.get("epub:type", "") or n.attrs.get("role") == "doc-pagebreak":
                at = n.attrs.get("id") or n.attrs.get("href", "").rpartition("#")[2]
                said = n.attrs.get("title") or n.attrs.get("aria-label") or collapse(n.text())
                if at and said:
                    self.labels.setdefault(at, said)

    def _emit(self, kind: str, text: str, level: int = 0, node: Node | None = None, raw: str = "") -> None:
        inside = []
        e = node
        while e is not None:
            if "id" in e.attrs:
                inside.append(e.attrs["id"])
            e = e.up
        self.rows.append({"record": "block", "path": self.path, "pos": self.blocks, "kind": kind, "level": level, "text": text, "page": self.page, "id": node.attrs.get("id", "") if node is not None else "", "inside": inside, "raw": raw})
        self.blocks += 1

    def _note(self, node: Node, kind: str) -> None:
        self.rows.append({"record": "note", "path": self.path, "pos": self.blocks, "id": node.attrs["id"], "kind": kind, "text": collapse(node.text())})

    def _enter(self, node: Node, inline: bool = False) -> None:
        """An element's id, page and note. A page starts where its element stands among blocks; inside a block's text it starts nothing."""
        if "id" in node.attrs:
            self.rows.append({"record": "id", "path": self.path, "pos": self.blocks, "id": node.attrs["id"]})
            if not inline:
                self.page = self.labels.get(node.attrs["id"], self.page)
        if (note := note_kind(node)) and "id" in node.attrs:
            self._note(node, note)
        if any(w in node.attrs.get("class", "").lower() for w in NOTE_HOLDERS):
            for c in node.children:
                if isinstance(c, Node) and "id" in c.attrs and not note_kind(c):
                    self._note(c, "strong")

    def inline(self, node: Node) -> tuple[str, str]:
        """(text, raw) of an element without the blocks inside it; raw is kept where it has line breaks."""
        out: list[str] = []

        def go(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    out.append(c)
                    continue
                if c.tag in BLOCKS or c.tag in SKIPPED:
                    continue
                self._enter(c, inline=True)
                if c.tag == "br":
                    out.append(" ")
                elif c.tag in ("img", "image"):
                    out.append(c.attrs.get("alt", ""))
                elif c.tag == "ruby":
                    base = "".join(x if isinstance(x, str) else x.text() for x in c.children if isinstance(x, str) or x.tag not in ("rt", "rp"))
                    reading = "".join(x.text() for x in c.children if isinstance(x, Node) and x.tag == "rt")
                    out.append(f"{base}({reading})" if reading else base)
                elif c.tag == "a" and c.attrs.get("href", "").find("#") >= 0:
                    forced = "noteref" in c.attrs.get("epub:type", "") or any(h in c.attrs.get("class", "").lower() for h in NOTEREF_HINTS)
                    out.append(f"{OPEN}{'!' if forced else '?'}{c.attrs['href']}{MIDDLE}{collapse(c.text())}{SHUT}")
                else:
                    go(c)

        go(node)
        joined = "".join(out)
        return collapse(joined), joined if "\n" in joined.strip() else ""

    def walk(self, node: Node) -> None:
        stray: list = []

        def flush() -> None:
            if stray:
                holder = Node("span", {}, node)
                holder.children = list(stray)
                stray.clear()
                text, raw = self.inline(holder)
                if text:
                    self._emit("para", text, node=node, raw=raw)

        for c in node.children:
            if isinstance(c, str):
                stray.append(c)
                continue
            if c.tag in SKIPPED:
                continue
            if c.tag not in BLOCKS and c.tag not in ("img", "image", "svg") and not any(n.tag in BLOCKS for n in c.walk()):
                if c.attrs.get("id") in self.labels:
                    flush()
                    self.page = self.labels[c.attrs["id"]]
                stray.append(c)
                continue
            flush()
            self._enter(c)
            self.block(c)
        flush()

    def block(self, c: Node) -> None:
        if c.tag in HEADINGS:
            text, raw = self.inline(c)
            if text:
                self._emit("heading", text, HEADINGS[c.tag], c, raw)
        elif c.tag == "pre":
            lines = [x.rstrip() for x in c.text().split("\n")]
            while lines and not lines[0]:
                lines.pop(0)
            while lines and not lines[-1]:
                lines.pop()
            if lines:
                self._emit("code", "\n".join(lines), node=c)
        elif c.tag in TEXTS or c.tag in ITEMS:
            text, raw = self.inline(c)
            if text:
                up = c.up.tag if c.up is not None else ""
                lead = "" if c.tag in TEXTS or c.tag == "dt" else "1. " if up == "ol" else "- "
                self._emit("list" if c.tag in ITEMS else TEXTS[c.tag], lead + text, node=c, raw=raw)
            for inner in c.children:
                if isinstance(inner, Node) and inner.tag in BLOCKS:
                    self._enter(inner)
                    self.block(inner)
                elif isinstance(inner, Node) and any(n.tag in BLOCKS for n in inner.walk()):
                    self.walk(inner)
        elif c.tag == "table":
            self.table(c)
        elif c.tag == "hr":
            self._emit("hr", "", node=c)
        elif c.tag in ("img", "image", "svg"):
            self.image(c)
        elif c.tag == "figure" and (image := c.find("img", "image")) is not None and (caption := c.find("figcaption")) is not None:
            self._emit("figure", f"![{collapse(image.attrs.get('alt', ''))}]({image.attrs.get('src', '')})\n{self.inline(caption)[0]}", node=c)
        else:
            self.walk(c)

    def image(self, c: Node) -> None:
        one = c if c.tag != "svg" else c.find("image") or c
        src = one.attrs.get("src") or one.attrs.get("href") or one.attrs.get("xlink:href") or ""
        alt = collapse(one.attrs.get("alt") or one.attrs.get("title") or "")
        if src or alt:
            self._emit("image", f"![{alt}]({src})" if src else alt, node=c)

    def table(self, c: Node) -> None:
        rows = [[collapse(x.text()).replace("|", "\\|") for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.all("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return
        wide = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
        lines.insert(1, "| " + " | ".join(["---"] * wide) + " |")
        self._emit("table", "\n".join(lines), node=c)


def records(path: str, markup: str, labels: dict[str, str] | None = None) -> list[dict]:
    """All rows of one document; ``labels`` are the page labels that a page list gives to its ids."""
    root = parse(markup)
    e = Extractor(path, labels)
    e.page_breaks(root)
    e.walk(root.find("body") or root)
    return e.rows


def readable(text: str) -> str:
    """A block's text with placeholders replaced by what they show."""
    return re.sub(f"{OPEN}[!?][^{MIDDLE}]*{MIDDLE}([^{SHUT}]*){SHUT}", r"\1", text)


def html_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, pos, kind, level, text`` of each page's blocks in reading order. A null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"page_id": [], "pos": [], "kind": [], "level": [], "text": []}
            for i, page in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                for r in records("", page or ""):
                    if r["record"] == "block":
                        out["page_id"].append(i)
                        for k in ("pos", "kind", "level"):
                            out[k].append(r[k])
                        out["text"].append(readable(r["text"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos long, kind string, level long, text string")
