"""Parts of the operators without Spark, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwright.llm import decontaminate, hamming_index, html_extract, ngram_jaccard, packing, registry, suffix_dedup, toxicity
from leafwright.llm import textcode as T

np.seterr(over="ignore")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té漢", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_shingles(rows):
    raw, off = T.buffers(pa.array(rows, pa.string()))
    words, per = T.word_hashes(raw, off)
    plain = [WORD.findall(lower(t or "")) for t in rows]
    assert per.tolist() == [len(w) for w in plain]
    flat = [w for ws in plain for w in ws]
    assert len(set(words.tolist())) == len(set(flat)) and all((words[i] == words[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    sets = T.shingle_sets(raw, off)
    assert [len(s) for s in sets] == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1) for w in plain]


def test_slabs_cover_all_texts():
    offsets = np.cumsum([0, 5, 0, 900, 3, 0])
    assert [x for i, j in T.slabs(offsets, 10) for x in range(i, j)] == [0, 1, 2, 3, 4]


def test_tile_links_against_brute_force():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = []
    for _ in range(40):
        keep = base[rng.random(len(base)) > 0.1]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])))
    sets.sort(key=len)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    want = {frozenset(k for k in range(len(sets)) if root(k) == root(i)) for i in range(len(sets))}
    every = np.arange(len(sets))
    forest = ngram_jaccard.link_tile(sets, every, every, 80)
    parent = list(range(len(sets)))
    for i, j in forest:
        assert root(i) != root(j)
        parent[root(i)] = root(j)
    assert {frozenset(k for k in range(len(sets)) if root(k) == root(i)) for i in range(len(sets))} == want


def test_every_window_has_its_anchor():
    rng = random.Random(3)
    text = "".join(rng.choice("abcd ") for _ in range(400)).encode() + b"a" * 200
    raw, off = T.buffers(pa.array([text.decode(), "short", text.decode()[7:]]))
    a = suffix_dedup.Anchors(raw, off, 50)
    for d in range(3):
        places = a.place[a.row == d]
        for w in range(off[d], off[d + 1] - 49):
            assert ((places >= w) & (places <= w + 26)).any()
    assert set(a.key[a.row == 2].tolist()) <= set(a.key[a.row == 0].tolist())


def test_earlier_copies():
    one, two = b"x" * 3 + b"0123456789" * 6, b"0123456789" * 6 + b"yy"
    piece, place = suffix_dedup.earlier_copies(np.frombuffer(one + two, np.uint8), np.array([len(one), len(two)]), np.array([5, 9]), 50)
    assert sorted(zip(piece.tolist(), place.tolist(), strict=True)) == [(1, k) for k in range(11)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=30))
def test_fill_uses_each_token_once_without_padding(sizes):
    sizes = np.array(sizes, np.int64)
    pieces = packing.fill(sizes, lambda d: np.where(np.arange(len(sizes)) % 3 == 1, 0.0, np.arange(len(sizes))), 2048)
    for d, n in enumerate(sizes.tolist()):
        at = 0
        for _, start, length, _, _ in sorted(p for p in pieces if p[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    total: dict[int, int] = {}
    for _, _, length, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == total.get(seq, 0)
        total[seq] = offset + length
    assert all(n == 2048 or n & (n - 1) == 0 for n in total.values()) and sum(n != 2048 for n in total.values()) <= 11


def test_bm25_prefers_shared_rare_words():
    docs = [[0, 1, 2, 9], [0, 1, 3], [0, 4, 5], [0, 2, 9], [0, 6]]
    terms, owner = np.array([t for d in docs for t in d]), np.array([i for i, d in enumerate(docs) for _ in d])
    near = packing.Bm25(terms, owner, 10, 5).scores(0)
    assert np.argsort(-near)[:2].tolist() == [0, 3] and (near > 0).all()
    # against the formula, with common and rare terms
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.5, rng.integers(1, 60)).clip(0, 199).tolist() for _ in range(80)]
    terms, owner = np.array([t for d in docs for t in d]), np.array([i for i, d in enumerate(docs) for _ in d])
    index, mean = packing.Bm25(terms, owner, 200, 80), len(terms) / 80
    df = [sum(t in d for d in docs) for t in range(200)]
    one = lambda t, d: np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean))
    for i in range(0, 80, 9):
        want = [sum(one(t, d) for t in set(docs[i]) if df[t] > 1 and t in d) for d in docs]
        assert np.allclose(index.scores(i), want, rtol=1e-5)


def test_multi_index_finds_all_within_a_radius():
    rng = np.random.default_rng(0)
    codes = np.packbits(rng.random((500, 64)) > 0.5, axis=1).view(np.uint64)
    index = hamming_index.MultiIndex(codes)
    for radius in (0, 3, 7, 12, 30):
        q = codes[11] ^ np.uint64((1 << radius) - 1)
        want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
        assert index.within(q, radius).tolist() == want.tolist()


def test_lcs_against_a_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        assert decontaminate.lcs(a, b) == row[-1]


def test_common_words_in_order_stop_below_the_least():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        whole, least = decontaminate.lcs(a, b), rng.randrange(60)
        assert decontaminate.common(decontaminate.masks(a), b, least) == (whole if whole >= least else 0)


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out


def test_models_give_distributions():
    words = [b"loser", b"losing", b"plain", b"plane", b"plan"]
    raw, off = T.buffers(pa.array([w.decode() for w in words]))
    model = toxicity.Model(raw, off[:-1], np.diff(off), np.array([9.0, 0, 0, 0, 0]), np.array([0.0, 3, 9, 9, 9]))
    hashes, starts, lengths, _, _ = T.vocabulary(raw, off, lower=True)
    value = dict(zip([raw[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)], model.known(hashes, raw, starts, lengths), strict=True))
    assert value[b"loser"] > 1 and all(value[w] < value[b"loser"] for w in words[1:])


def test_pages():
    page = "<html><body class=has-sidebar><header><a href=/>Site</a></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class='cookie-notice'>We use cookies, yes.</div><div id=main><h1>Head &amp; line</h1><p>First, <b>bold<p>Second  para\n here, long enough.<br>More.<ul><li>item</ul></div><aside><p>Other, things.</aside><div id=comments><p>Nice one, really, truly good.</div><script>var a='</p>'</script><footer>&copy; x.</footer>"
    assert html_extract.extract(page) == "Head & line\nFirst, bold\nSecond para here, long enough. More.\nitem"
    assert html_extract.extract(None) == "" == html_extract.extract("<nav><a href=x>y</a></nav>") == html_extract.extract("")
    assert html_extract.extract("<p>" + "a " * 50_000) == "a " * 49_999 + "a"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab", min_size=0, max_size=30)), min_size=1, max_size=6))
def test_previous_factors_against_brute_force(texts):
    """Suffixes of several documents in sorted order: the longest prefix shared with a suffix of a smaller document."""
    rows = sorted((t[i:], d) for d, t in texts for i in range(len(t)))
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcp = np.array([0, *(share(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))][: len(rows)], np.int64)
    want = [max((share(s, o) for o, e in rows if e < d), default=0) for s, d in rows]
    assert suffix_dedup.previous_factors(np.array([d for _, d in rows], np.int64), lcp).tolist() == want


def test_hostile_pages_take_one_scan():
    import time

    pages = ['<a "' * 250_000, "<a " * 330_000, '<a x="' * 160_000, "<div>" * 200_000 + "x", "<i><p>" + "<b>" * 150_000 + "</i>" * 100_000, "<div>" * 100_000 + "</x></p>" * 60_000, "<script>" + "</script " * 120_000, "<!--" * 250_000]
    for page in pages:
        begun = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - begun < 5, page[:20]


def test_names_are_a_prior_inside_an_article():
    say = lambda what: f"{what}, that is all, and a lot more of it. " * 6
    page = f"""<nav><a href=x>Menu</a></nav><article><div class="article-header"><h1>Head</h1></div><p>{say('One')}</p><div class="related-work"><p>{say('Two')}</p></div>
      <div class="share-price"><p>{say('Three')}</p></div><div class="share-buttons"><p>{say('Share')}</p></div><div class="reply-list"><p>{say('Reader')}</p></div></article><div class="acme-notice"><p>{say('Notice')}</p></div>"""
    assert html_extract.extract(page).split("\n") == ["Head", *(say(x).strip() for x in ("One", "Two", "Three"))]


def test_pieces_part_where_a_tokenizer_does():
    texts = ["", "don't (x) a'b 12a3", "x-y,,z", "é1é 'tis\"s"]
    raw, off = T.buffers(pa.array(texts))
    starts, ends, per = T.pieces(raw, off)
    got = [raw[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert got == ["don't", "(", "x", ")", "a'b", "1", "2", "a", "3", "x", "-", "y", ",,", "z", "é", "1é", "'tis", '"', "s"] and per.tolist() == [0, 9, 5, 5]


def test_token_memory_forgets_and_still_tells_right(monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    with open(path, encoding="utf-8") as f:
        known = packing.WordTokens(f.read())
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(2)
    for _ in range(12):
        texts = [" ".join(f"w{k}'s-{k}" for k in rng.integers(0, 90, 30)), "İx ǅ y’s 1⃣", ""]
        raw, off = T.buffers(pa.array(texts))
        with np.errstate(over="ignore"):
            h, s, n, code, owner = T.vocabulary(raw, off, lower=True, cut=T.pieces)
        first, count, flat = known.of(h, raw, s, n)
        for d, t in enumerate(texts):
            c = code[owner == d]
            assert flat[packing._runs(first[c], count[c])].tolist() == plain.encode(t, add_special_tokens=False).ids
