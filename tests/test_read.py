"""All chapters read within 200 tokens against a loop, those with a cut first block included."""

import hashlib
import math
import re
from itertools import groupby

from leafwright.functions import text as T
from leafwright.plans import catalogue

CJK = re.compile(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), T.CJK))


def tokens(s):
    cjk = len(CJK.findall(s))
    return max(1, math.floor(cjk + (len(s) - cjk) / 4 + 0.5)) if s else 0


def first_piece(s, budget):
    out = ""
    for x in re.findall(f"[^{T.SENTENCE_ENDS}]*[{T.SENTENCE_ENDS}]|[^{T.SENTENCE_ENDS}]+", s):
        if tokens(out + x) <= budget:
            out += x
        elif out.strip():
            break
        else:
            return x if tokens(x) <= budget else x[: budget if CJK.search(x) else 4 * budget]
    return out


def test_read_budget_all_returns_cut_chapters(spark, sf):
    rows = sorted(catalogue._blocks(spark, sf).select("book", "chapter", "block", "kind", "level", "text", "dedup").collect(), key=lambda r: (r["book"], r["chapter"], r["block"]))
    want = {}
    for key, blocks in groupby(rows, key=lambda r: (r["book"], r["chapter"])):
        parts, run, after, cut = [], 0, None, False
        for r in blocks:
            piece = "#" * min(6, max(1, r["level"] + 2)) + " " + r["text"] if r["kind"] == "heading" else r["text"]
            if after is not None:
                continue
            if r["dedup"]:
                if run > 200:
                    after = r["block"]
                continue
            run += tokens(piece)
            if run <= 200:
                parts.append(piece)
            elif not parts and not cut:
                cut = True
                parts.append(first_piece(piece, 200))
            else:
                after = r["block"]
        want[key] = len(parts), cut or after is not None, cut, after if after is None else f"c{key[1]}p{after}", hashlib.md5("\n\n".join(parts).encode()).hexdigest()
    got = {(r["book"], r["chapter"]): (r["blocks_read"], r["truncated"], r["cut_first"], r["next_anchor"], r["digest"]) for r in catalogue.queries()["read_budget_all"](spark, sf).collect()}
    assert any(x[2] for x in want.values())
    assert got == want


def test_many_phrases_against_brute_force(spark):
    """Phrases of one and two words, inside words and across them, and phrases that match nothing."""
    from leafwright.operators import query

    texts = ["the Cat sat on a mat", "concat ca t", "", "x", "a  b   c d", "cats at mats", "ab"]
    phrases = ["cat", "cat s", "CAT SAT ON", "at", "x", "a b", "b c d", "zz", "", "a", "t on a m"]
    blocks = spark.createDataFrame([("k", 0, i, t) for i, t in enumerate(texts)], "book string, chapter long, block long, text string")
    got = {(r["block"], r["item_id"]) for r in query.search_many(blocks, spark.createDataFrame(list(enumerate(phrases)), "item_id long, phrase string")).collect()}
    fold = lambda s: " ".join(s.lower().split())
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p and fold(p) in fold(t)}


def test_a_bad_pattern_is_an_error_of_ours(spark):
    import pytest

    from leafwright.errors import PatternError
    from leafwright.operators import query

    with pytest.raises(PatternError):
        query.search(spark.createDataFrame([("k", 0, 0, "t")], "book string, chapter long, block long, text string"), "(", "regex")
