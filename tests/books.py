"""Small packaged books, built in code."""

import io
import zipfile

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}" media-type="application/oebps-package+xml"/></rootfiles></container>'


def page(body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>x</title></head><body>{body}</body></html>'


def book(docs: dict[str, str], nav: str | None = None, ncx: str | None = None, opf: str = "OPS/book.opf", base: str = "", meta: str = "", extra: dict | None = None) -> bytes:
    items = "".join(f'<item id="d{i}" href="{base}{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(docs))
    items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
    items += '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else ""
    refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(docs)))
    package = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Title</dc:title><dc:creator>One</dc:creator><dc:creator>Two</dc:creator><dc:creator>One</dc:creator><dc:language>en</dc:language>{meta}</metadata><manifest>{items}</manifest><spine{" toc=" + chr(34) + "ncx" + chr(34) if ncx else ""}>{refs}</spine></package>'
    out = io.BytesIO()
    root = opf.rpartition("/")[0]
    at = lambda n: f"{root}/{n}" if root else n
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER.format(opf))
        z.writestr(opf, package)
        if nav:
            z.writestr(at("nav.xhtml"), nav)
        if ncx:
            z.writestr(at("toc.ncx"), ncx)
        for name, text in docs.items():
            z.writestr(name if base.startswith("../") and not root else (at(name) if not base else base.replace("../", "") + name), text)
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


NAV = page('<nav epub:type="toc"><ol><li><a href="a.xhtml">One</a></li><li><a href="b.xhtml">Two</a><ol><li><a href="b.xhtml#s1">Inner</a></li></ol></li><li><a href="c.xhtml">Three</a></li></ol></nav>')
CLEAN = {
    "a.xhtml": page('<h1>One</h1><p>First text<a epub:type="noteref" href="#n1">1</a> goes on.</p><blockquote>Said.</blockquote><ul><li>x</li><li>y</li></ul><aside epub:type="footnote" id="n1"><p>The note.</p></aside>'),
    "b.xhtml": page('<h1>Two</h1><p>Before.</p><span epub:type="pagebreak" id="p7" title="7"></span><h2 id="s1">Inner</h2><p>After <ruby>漢<rt>kan</rt></ruby>.</p><table><tr><th>h|1</th><th>h2</th></tr><tr><td>v</td></tr></table>'),
    "c.xhtml": page("<h1>Three</h1><p>" + "A sentence here. " * 10 + "</p><p>" + "Long one! " * 900 + "</p>"),
}
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Eins</text></navLabel><content src="a.xhtml"/></navPoint><navPoint><navLabel><text>Zwei</text></navLabel><content src="b.xhtml"/></navPoint></navMap></ncx>'


def clean() -> bytes:
    return book(CLEAN, nav=NAV)


def ncx_only() -> bytes:
    return book({k: CLEAN[k] for k in ("a.xhtml", "b.xhtml")}, ncx=NCX)


def stub_toc() -> bytes:
    return book({"a.xhtml": page("<h1>H A</h1><p>t</p>"), "b.xhtml": page("<h1>H B</h1><p>t</p>")}, nav=page('<nav epub:type="toc"><ol><li><a href="a.xhtml">Start</a></li></ol></nav>'))


def split_chapter() -> bytes:
    return book({"a.xhtml": page("<h1>One</h1><p>a</p>"), "b.xhtml": page("<p>still one</p>"), "c.xhtml": page("<h1>Two</h1><p>c</p>")}, nav=page('<nav epub:type="toc"><ol><li><a href="a.xhtml">One</a></li><li><a href="c.xhtml">Two</a></li></ol></nav>'))


def encrypted(algorithm: str = "http://www.w3.org/2001/04/xmlenc#aes128-cbc") -> bytes:
    return book(CLEAN, nav=NAV, extra={"META-INF/encryption.xml": f'<encryption><EncryptedData><EncryptionMethod Algorithm="{algorithm}"/><CipherData><CipherReference URI="OPS/a.bin"/></CipherData></EncryptedData></encryption>'})


def _prose(n: int) -> str:
    return "山高月小水落石出。" * (n // 9)


def blob() -> bytes:
    """Three chapters in one paragraph, by lines; the first title goes on after a rule, and one line only begins like a title."""
    lines = ["第一回", "———————", "松下問童子 言師採藥去", _prose(8000), "第二回 只在此山中 雲深不知處", _prose(8000), "———————", "第三回 空山不見人 但聞人語響", "第四回中又說起那童子來。" + _prose(8000)]
    return book({"a.xhtml": page("<p>" + "\n".join(lines) + "</p>")})


def paragraphs() -> bytes:
    """Three chapters in paragraphs, a title and its rest apart by a rule."""
    parts = "".join(f"<p>CHAPTER {k}</p><p>-----</p><p>The {w} part</p>" + f"<p>{'Words go on and on here. ' * 400}</p>" * 4 for k, w in ((1, "first"), (2, "second"), (3, "third")))
    return book({"a.xhtml": page(parts)})


def long_but_whole() -> bytes:
    """Long, with two titles only."""
    return book({"a.xhtml": page("<h1>Whole</h1>" + f"<p>CHAPTER 1</p><p>{'Words go on and on here. ' * 2000}</p><p>CHAPTER 2</p><p>{'Words go on and on here. ' * 2000}</p>")})


def toc_only_sections() -> bytes:
    nav = page('<nav epub:type="toc"><ol><li><a href="a.xhtml">One</a><ol><li><a href="a.xhtml#x">By the table</a></li><li><a href="a.xhtml#h">A heading too</a></li><li><a href="a.xhtml#gone">Nowhere</a></li></ol></li></ol></nav>')
    return book({"a.xhtml": page('<h1>One</h1><p>a a a a</p><p id="x">b b b b</p><p>c c c c</p><h2 id="h">Heading</h2><p>d d d d</p>')}, nav=nav)
