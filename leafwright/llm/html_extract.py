"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of block elements from the root to it. Per path, the
text outside links and the punctuation are added up and divided by the count of blocks; both ratios are smoothed over
neighbouring paths in page order, multiplied, and held against a share of the page's highest value. Blocks on paths
that pass are content nodes and all belong to the text, unless they are mostly links. So do the other blocks of the element
that holds most of their weight, and headings inside the lowest element that holds all of them. Menus, headers, footers, sidebars, notices, adverts,
forms and comments, known by element, role, class or id, take no part from the start. Inside an article a name decides only
if it says nothing else (``share-buttons``, but not ``share-price``); text under other names in doubt must pass by its path.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：،؛؟।]")

# Elements of HTML by kind.
_RAW = frozenset("script style noscript template textarea iframe svg math object select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var picture".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_FENCES = frozenset("ul ol dl table article section div aside main nav form blockquote body html".split())
_APART = frozenset("nav footer aside form head button dialog menu input title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
# Words of class and id names. The first kind is never part of an article, the second may be inside one if the
# name has a word that is of no kind here.
_STRONG = frozenset(
    "advert adverts advertisement advertisements advertising adsense comment comments commentlist disqus respond reply replies gdpr newsletter sidebar sidebars nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead login signin signup pagination pager toolbar topbar taglist modal popup overlay".split()
)
_WEAK = frozenset(
    "ad ads adv banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent notice notices notification alert subscribe subscription share sharing social related recommended "
    "recommendations widget widgets copyright disclaimer legal skip tags header".split()
)
_GENERIC = frozenset("area articles bar block bottom box button buttons col column container group icon icons inner item items label left link links list outer panel posts right row site slot stories top unit wrap wrapper".split())
_EXEMPT = frozenset("html body main".split())
PATH_SHARE = 0.1


class _Element:
    """An element with what is inherited from above, so that nothing has to look up for it; ``first`` to ``last`` are the numbers of all inside."""

    __slots__ = ("apart", "doubt", "first", "holder", "inline", "inside", "last", "link", "path", "tag", "up")

    def __init__(self, tag: str, up: _Element | None, first: int, paths: dict[tuple[int, str], int], apart: bool = False, doubt: bool = False) -> None:
        self.tag, self.up, self.apart, self.doubt, self.first, self.last = tag, up, apart, doubt, first, first
        self.inside = up is not None and up.inside or tag in ("article", "main")
        if tag in _INLINE and up is not None:
            self.holder, self.path, self.inline, self.link = up.holder, up.path, None, up.link or tag == "a"
        else:
            self.holder, self.inline, self.link = self, {}, False
            self.path = paths.setdefault((up.path if up is not None else -1, tag), len(paths))

    def holds(self, other: _Element) -> bool:
        return self.first <= other.first <= self.last


def _judge(tag: str, attrs: str, up: _Element) -> tuple[bool, bool]:
    """(apart, doubt): does this element start something that is no part of an article, or that may be none?"""
    if tag in _APART or tag == "header" and not up.inside:
        return True, False
    if not attrs or tag in _EXEMPT:
        return False, False
    doubt = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for one in value.split():
                words = set(re.split(r"[_\-:]+", one)) - {""}
                strong, weak = words & _STRONG, words & _WEAK
                if up.inside:
                    weak -= {"header"}
                if strong or weak and not (up.inside or tag == "article") or weak and words <= _WEAK | _GENERIC:
                    if tag != "article" or strong & {"comment", "comments", "reply", "advert", "advertisement"} or weak & {"ad", "ads", "sponsored", "promo", "related"}:
                        return True, False
                doubt = doubt or bool(weak)
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
    return False, doubt


def _marks(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(first, last, name, is an end tag, attributes) of all markup in page order; comments and declarations have no name.

    One scan forwards: no place is looked at more often than a fixed number of times, whatever is left open.
    """
    pos, quotes = 0, True
    while (at := page.find("<", pos)) >= 0:
        pos = at + 1
        if page.startswith(("<!", "<?"), at):
            shut = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(shut, at + 2)
            pos = len(page) if end < 0 else end + len(shut)
            yield at, pos, None, False, ""
            continue
        is_end = page.startswith("/", pos)
        name = _NAME.match(page, pos + is_end)
        if name is None:
            continue
        end = name.end()
        while quotes:
            q = _QUOTE_OR_END.search(page, end)
            if q is not None and q[1] is None:
                end = q.end()
                break
            close = -1 if q is None else page.find(q[1], q.end())
            quotes = close >= 0  # a quote that nothing ends: from here on quotes hide nothing
            end = close + 1
        else:
            end = page.find(">", name.end()) + 1
        if not end:  # a tag that nothing ends takes the rest of the page
            yield at, len(page), None, False, ""
            return
        pos = end
        yield at, end, name[0].lower(), is_end, page[name.end() : end - 1]


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """The page's blocks of text outside of what is apart: (element, text, characters inside links)."""
    paths: dict[tuple[int, str], int] = {}
    at = _Element("", None, 0, paths)
    made, opened = [at], {}
    out: list[tuple[_Element, str, int]] = []
    pieces: list[str] = []
    owner: _Element | None = None
    links = pos = 0

    def flush() -> None:
        nonlocal pieces, owner, links
        if pieces:
            text = _SPACES.sub(" ", "".join(pieces)).strip()
            if text:
                out.append((owner, text, min(links, len(text))))
            pieces, links = [], 0
        owner = None

    def add(raw: str) -> None:
        nonlocal owner, links
        if at.apart or not raw:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        if owner is None:
            if not text.strip():
                return
            owner = at.holder
        pieces.append(text)
        if at.link:
            links += len(text.strip())

    def leave(top: _Element) -> None:
        """Closes all elements below ``top``; each is closed once."""
        nonlocal at
        while at is not top:
            (opened if at.inline is not None else at.holder.inline)[at.tag] -= 1
            at = at.up

    def find(tag: str, fences: frozenset = frozenset()) -> _Element | None:
        """The lowest open element of that name below the next fence. What is found is closed, so looking up pays for itself."""
        e = at if opened.get(tag, 0) else None
        while e is not None and e.tag != tag:
            e = None if e.up is None or e.tag in fences else e.up
        return e

    skip = 0
    for first, last, tag, is_end, attrs in _marks(page):
        if first < skip:
            continue
        if first > max(pos, skip):
            add(page[max(pos, skip) : first])
        pos = last
        if tag is None:
            continue
        if is_end:
            if tag in _INLINE:
                if at.holder.inline.get(tag, 0):
                    e = at
                    while e.tag != tag:
                        e = e.up
                    leave(e.up)
            elif tag not in _VOID:
                flush()
                if (e := find(tag)) is not None:
                    leave(e.up)
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                skip = _after_raw(page, tag, pos)
            continue
        if tag in _VOID:
            if tag == "br" and pieces:
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            leave(at.holder)
            if tag in _CLOSES_P and (e := find("p", _FENCES)) is not None:
                leave(e.up)
            for other in (tag,) if tag in _HEADINGS and at.tag in _HEADINGS else _ENDS.get(tag, ()):
                if (e := find(other, _FENCES)) is not None:
                    leave(e.up)
            if tag == "body" and at.tag == "head":
                leave(at.up)
        apart, doubt = (True, False) if at.apart else _judge(tag, attrs, at)
        at = _Element(tag, at, len(made), paths, apart, doubt or at.doubt)
        made.append(at)
        count = opened if at.inline is not None else at.holder.inline
        count[tag] = count.get(tag, 0) + 1
    if max(pos, skip) < len(page):
        add(page[max(pos, skip) :])
    flush()
    for e in reversed(made[1:]):
        e.up.last = max(e.up.last, e.last)
    return out


def _after_raw(page: str, tag: str, pos: int) -> int:
    """Where an element ends whose content is no markup."""
    low, size = "</" + tag, len(tag) + 2
    while (at := page.find("</", pos)) >= 0:
        if page[at : at + size].lower() == low and not page[at + size : at + size + 1].isalnum():
            end = page.find(">", at)
            return len(page) if end < 0 else end + 1
        pos = at + 2
    return len(page)


def _smooth(values: list[float]) -> list[float]:
    last = len(values) - 1
    return [0.8 * v + 0.1 * values[max(i - 1, 0)] + 0.1 * values[min(i + 1, last)] for i, v in enumerate(values)]


def extract(page: str | None) -> str:
    """The main text of one page, its blocks joined by line breaks; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    paths: dict[int, list[float]] = {}
    for e, text, links in found:
        row = paths.setdefault(e.path, [0, 0, 0])
        row[0] += 1
        row[1] += len(text) - links
        row[2] += len(_PUNCT.findall(text)) if links < len(text) else 0
    length = _smooth([r[1] / r[0] for r in paths.values()])
    points = _smooth([(r[2] + 0.5) / r[0] for r in paths.values()])
    value = dict(zip(paths, (a * b for a, b in zip(length, points, strict=True)), strict=True))
    least = PATH_SHARE * max(value.values())
    weight: dict[int, list] = {}
    content = [e for e, text, links in found if value[e.path] >= least and 2 * links <= len(text)]
    if not content:
        return ""
    for e, text, links in found:
        if value[e.path] >= least and 2 * links <= len(text):
            share, up = 1.0, e.up or e
            for _ in range(2):
                row = weight.setdefault(up.first, [0.0, up])
                row[0] += share * (len(text) - links)
                share, up = share / 2, up.up
                if up is None:
                    break
    root = max(weight.values(), key=lambda r: r[0])[1]
    e = root
    while e is not None:
        if e.tag in ("article", "main"):
            root = e
            break
        e = e.up
    common = min(content, key=lambda e: e.first)  # the lowest element that holds all content nodes
    end = max(content, key=lambda e: e.first)
    while not common.holds(end):
        common = common.up
    out = []
    for e, text, links in found:
        passes, plain, heading = value[e.path] >= least, 2 * links <= len(text), e.tag in _HEADINGS
        inside = root.holds(e) and (heading or not e.doubt)
        if passes and plain or inside and (plain or passes and links < len(text)) or plain and heading and common.holds(e):
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars`` (its code points) added; needs a column ``html``.

    A null or empty page, or one without an article, has an empty text. Columns named like the new ones are replaced.
    Rows are judged one by one, so repeated rows and long pages change nothing for others.
    """
    pages = pages.drop("text", "n_chars")
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
