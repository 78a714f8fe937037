"""Whole operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import gc
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafwright.llm import chat_format, decontaminate, exchange, hamming_index, html_extract, ngram_jaccard, packing, registry, suffix_dedup, suffix_tree_lm, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, n_bytes string, blob int, score string"


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def corpus():
    rng = random.Random(2)
    w = lambda n: " ".join(rng.choice("alpha beta gamma delta Eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))
    base, passage = w(80), w(20)
    near = base.split()
    near[3] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, w(30) + " " + passage), (5, passage + " " + w(30)), (6, ""), (7, None), (8, " \n "), (9, "one two"), (10, "One  two"), (11, w(5000)), (None, base), (None, w(12)), (4, w(9)), (12, base), (12, base), (13, "é" * 60), (14, "x" + "é" * 60)]
    return [(i, t, "old", 7, "s") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


def test_jaccard_classes(spark, docs):
    rows = [(r[0], words(r[1])) for r in corpus()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for _, w in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        own = [rows[k][0] for k in range(len(rows)) if sets[i] and root(k) == root(i) and rows[k][0] is not None]
        want[d, len(sets[i]), min(own) if own else d] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_classes(docs).collect())
    assert got == want
    assert ngram_jaccard.jaccard_classes(docs.where("false")).count() == 0


def test_suffix_dedup(spark, docs):
    rows = [(r[0] if r[0] is not None else math.inf, (r[1] or "").encode()) for r in corpus()]
    first = {}
    for i, b in rows:
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], math.inf))
    want = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[None if i == math.inf else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup.suffix_dedup(docs)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == want
    assert out.columns == ["doc_id", "text", "blob", "score", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert suffix_dedup.suffix_dedup(docs.where("false")).count() == 0


def test_language_model(spark, docs):
    out = suffix_tree_lm.score(docs).collect()
    rows = [(r[0], [*words(r[1]), 0]) for r in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(t for i, ts in rows if not held(i) for t in ts)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(ts), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for i, ts in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert suffix_tree_lm.score(docs.where("false")).count() == 0


def test_suffix_tree_against_brute_force(spark):
    """Every document's score by a tree of plain dictionaries; and each state's distribution sums to one."""
    rng = random.Random(8)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words_ = [f"v{k}" for k in range(12)]
    chain = {(a, b): rng.sample(words_, 2) for a in words_ for b in words_}
    rows = []
    for i in range(150):
        text = rng.choices(words_, k=2)
        for _ in range(rng.randrange(20, 60)):
            pair = tuple(text[-2:])
            text.append(rng.choice(chain[pair]) if pair in chain and rng.random() < 0.8 else rng.choice([*words_, f"new{i}"]))
        rows.append((i, " ".join(text)))
    end = object()
    docs = {i: [*t.split(), end] for i, t in rows}
    count = Counter(t for i, ts in docs.items() if not held(i) for t in ts)
    n, v = sum(count.values()), len(count)
    after: dict = {}
    for i, ts in docs.items():
        for k, t in enumerate(ts if not held(i) else []):
            before = (end, *ts[:k])
            for m in range(1, min(suffix_tree_lm.DEPTH, len(before)) + 1):
                after.setdefault(before[-m:], Counter())[t] += 1
    states: dict = {}
    less = suffix_tree_lm.DISCOUNT

    def p(context, t):
        while context not in states:
            if not context:
                return (count[t] + 0.1) / (n + 0.1 * (v + 1))
            context = context[1:]
        c = states[context]
        return (max(c[t] - less, 0) + less * len(c) * p(context[1:], t)) / c.total()

    for m in range(1, suffix_tree_lm.DEPTH + 1):
        for context, c in after.items():
            if len(context) != m or c.total() < suffix_tree_lm.MIN_CONTEXT or m > 1 and not (context[1:] in states and context[:-1] in states):
                continue
            gain = sum(k * math.log((max(k - 1 - less, 0) + less * max(len(c) - (k == 1), 1e-6) * p(context[1:], t)) / (c.total() - 1) / p(context[1:], t)) for t, c_, k in ((t, c, k) for t, k in c.items()))
            if gain >= suffix_tree_lm.DIVERGENCE:
                states[context] = c
    assert max(map(len, states)) > 1
    assert all(abs(sum(p(s, t) for t in count) + p(s, "unseen") - 1) < 1e-9 for s in states)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: sum(math.log10(p((end, *ts[:k])[-suffix_tree_lm.DEPTH :], t)) for k, t in enumerate(ts)) for i, ts in docs.items()}
    assert all(abs(got[i]["score"] - want[i]) < 1e-6 for i in docs)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_suffix_tree_keeps_one_level_of_messages(spark, docs):
    """Shuffles of a level are gone when the next has begun: only those of the last query may be left."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_(\d+)_", files))

    exchange.release(spark)
    before = shuffles()
    out = suffix_tree_lm.score(docs)
    assert shuffles() <= before
    assert out.count() == len(corpus()) and len(shuffles() - before) <= 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rare_pairs_and_deep_contexts_become_states(spark):
    """A pair of 8 among 400,000 tokens is learnt, and a word that only the third word before it tells."""
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(400)] + ["m", "n"] * 3
    w = lambda n: [rng.choice(filler) for _ in range(n)]
    train = [i for i in range(1, 500) if zlib.crc32(str(i).encode()) % 10]
    rows = []
    for k, i in enumerate(train[:80]):
        text = w(5000)
        if k < 8:
            text[100:100] = ["qq", "zz"]
        for j in range(4):
            text[200 * j : 200 * j] = ["x1", "m", "n", "y1"] if (k + j) % 2 else ["x2", "m", "n", "y2"]
        rows.append((i, " ".join(text)))
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += list(zip(held, ["qq zz", "x1 m n y1", "x1 m n y2"], strict=False))
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]]["train_tokens"] > 400_000
    assert got[held[0]]["score"] - got[held[0]]["base_score"] > 2
    assert got[held[1]]["score"] - got[held[2]]["score"] > 0.5


def test_toxicity(spark):
    rng = random.Random(1)
    w = lambda n: [rng.choice("ba be bi bo bu".split()) + rng.choice("lam lem lim lom".split()) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        t, bad = w(rng.randrange(5, 60)), i % 5 == 0
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["Zxqor", "zxqorish", "vvkrum"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    labels += [(0, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, (None, "balam"), (5000, None), (5001, "")]], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, table).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    wrong = sum(r["predicted"] != (r["doc_id"] % 5 == 0) for r in held if r["doc_id"] < 400)
    assert wrong <= 0.05 * len(held)
    none = toxicity.score(docs, table.where("false")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for r in corpus():
        want[r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1] += 1
    whole = Counter()
    for r in got:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert whole == Counter({k: k[1] * n for k, n in want.items()})
    # every piece's ids, and each id in one piece; documents that share an id or a text are told apart by what they hold
    texts = Counter()
    for r in corpus():
        texts[r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])] += 1
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for (i, ids), n in texts.items():
        own = [r for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids) and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]]
        assert sorted(x for r in own for x in range(r["start"], r["start"] + r["length"])) == sorted(list(range(len(ids))) * n)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values())
    assert packing.pack(docs.where("false"), path).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    w = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    items = [(i, w(rng.randrange(15, 50))) for i in range(12)] + [(50, ""), (51, None)]
    docs = [(i, w(300)) for i in range(20)]
    docs += [(100 + i, w(90) + " " + items[i][1].upper().replace(" ", ", ") + " " + w(70)) for i in range(6)]
    changed = items[7][1].split()
    changed[4] = changed[11] = "other"
    docs += [(200, w(50) + " " + " ".join(changed) + " " + w(20)), (201, None), (202, ""), (None, items[3][1]), (300, items[2][1]), (300, items[2][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter([*((100 + i, i) for i in range(6)), (200, 7), (None, 3), (300, 2), (300, 2)])
    # paraphrases: four words of ten replaced
    many = [(i, w(rng.randrange(25, 50))) for i in range(40)]
    loose = []
    for i, t in many:
        own = t.split()
        for k in rng.sample(range(len(own)), len(own) * 4 // 10):
            own[k] = w(1)
        loose.append((i, f"{w(100)} {' '.join(own)} {w(100)}", "x", 1.0))
    loose += [(1000 + i, w(400), "x", 1.0) for i in range(60)] + [(2000, w(20_000) + " " + many[0][1], "x", 1.0)]
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(loose, "doc_id long, text string, item_id string, cosine double"), spark.createDataFrame(many, "item_id long, text string")).collect()}
    assert len(hits & {(i, i) for i, _ in many}) >= 36 and not hits - {(i, i) for i, _ in many} - {(2000, 0)} and (2000, 0) in hits
    none = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def test_projection_of_all_documents(spark):
    # the directions are those of the passages of every document, not of some
    rng = random.Random(5)
    words = [f"w{i}" for i in range(110)]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 70))) for _ in range(2300)] + ["", None, "only here twice only here twice"]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    packed = spark.createDataFrame([(d,) for d in docs], "text string").selectExpr("coalesce(text, '') AS text").mapInArrow(decontaminate._pack, decontaminate._PACKED).cache()
    held, n = decontaminate.document_counts(packed)
    feature = lambda t: [int(f) for f in decontaminate._tokens(pa.array([t]))[1]]
    in_docs = Counter(f for d in docs if d for f in set(feature(d)))
    assert n == len(docs) and in_docs == {f: held[f] for f in np.flatnonzero(held)}
    idf = np.log((n + 1) / (held + 1)) + 0.05
    total = [sum(len((d or "").split()) for d in texts) for texts in (docs, items)]
    column = {f: k for k, f in enumerate(in_docs)}
    gram = np.zeros((len(column), len(column)))
    for t, w in [*((d, 1.0) for d in docs if d), *((i, total[0] / total[1]) for i in items)]:
        own = feature(t)
        for a in range(0, len(own), 30):
            row = np.zeros(len(column))
            for f in own[a : a + 30]:
                row[column[f]] += idf[f]
            gram += np.outer(row, row) * w / sum(idf[f] ** 2 for f in own[a : a + 30])
    values, turn = np.linalg.eigh(gram)
    at, some = list(column), values > 1e-6 * values[-1]
    values, turn = values[some], turn[:, some]
    median = np.median([*values, *[0.0] * (decontaminate.RANK - len(values))])
    want = idf[at][:, None] * (turn / np.maximum(values, median)) @ turn.T * idf[at]
    project = decontaminate.projection(packed, spark.createDataFrame([(i,) for i in items], "text string"), idf)
    assert np.abs(project[at] @ project[at].T - want).max() < 1e-3 * np.abs(want).max()
    assert np.abs(np.delete(project, at, axis=0)).max() < 1e-12


def test_neighbours(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(8)]) for i in range(120)]
    rows += [(500, None), (501, [0.0] * 8), (502, [math.nan] * 8), (503, [None] + [1.0] * 7), (504, [math.inf] * 8), (505, [1.0, 2.0]), (None, [1.0] * 8), (40, rows[40][1]), (600, rows[0][1]), (601, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming_index.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    fine = [(i, v) for i, v in rows if i is not None and i not in range(500, 506)]
    hits = total = 0
    for q in {i for i, _ in fine if i % 20 == 0}:
        x = next(v for i, v in fine if i == q)
        want = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in fine if i != q)[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        hits += sum((Counter(r["vec_id"] for r in mine) & Counter(i for _, i in want)).values())
        total += 5
    assert hits >= 0.9 * total
    assert hamming_index.nearest(df.where("false"), df, 5).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <s> good"), (1, 1, "user", None), (1, 2, "assistant", "[INST\\] <\\s> \\ </s>[/INST]"), (1, 2, "assistant", "same turn"), (1, 3, "user", "q" * 9000), (1, 4, "assistant", "a" * 3000), (2, None, None, "x"), (2, 5, "assistant", ""), (None, 0, "assistant", "n")]
    rows += [(3, t, "user" if t % 2 else "assistant", f"turn {t} <<SYS>>" * 9) for t in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    out = chat_format.windows(df).collect()
    assert all(w["formatted"].startswith("<s>system[INST]be <\\s> good") for w in out if w["conv_id"] == 1)
    assert chat_format.digests(df.where("false")).count() == 0
    # windows over several blocks of turns, against the SQL
    import duckdb
    import pandas as pd

    conversations = pd.DataFrame([r for r in rows if r[0] is not None], columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT conv_id, formatted_chars, n_windows FROM ({registry.OP1_SQL}) WHERE conv_id > 0").fetchall()}
    assert {c: (got[c]["formatted_chars"], got[c]["n_windows"]) for c in (1, 2, 3)} == want


def test_urls(spark):
    urls = ["http://A.B.example.COM/en/7x?q#f", "https://com/en/", "http://x.com/en", None, "no scheme/en/", "ftp://example.net/de/80", "http://net/de/1", "http://badexample.net/de/8", "http://org?x=/es/", "http://a.org/es/#t", "://", "http:///p"]
    urls += [f"http://h{i}.example.{t}/{p}/{i}" for i in range(60) for t, p in (("com", "en"), ("net", "de"), ("org", "es"), ("org", "fr"))]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, registry.RULES).collect()}
    rules = dict((n, v) for v, n in registry.RULES)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [n for n in rules if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
        rule = max(fit, key=len) if fit else None
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == rules[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.where("false"), registry.RULES).count() == 0


def test_url_ratios_are_those_of_the_grams_asked_for(spark):
    """Brute force with a dictionary: no url takes the ratio of another gram."""
    rng = random.Random(8)
    w = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(n))
    rules = [("allow", "com/en/"), ("block", "org/es/")]
    parts = [w(6) for _ in range(40)]
    urls = [f"http://{rng.choice(parts)}.{t}/{p}/{rng.choice(parts)}{i}" for i in range(900) for t, p in (("com", "en"), ("org", "es"))]
    urls += [f"http://{w(12)}.net/{w(30)}" for _ in range(200)]
    marked = lambda u: "^^^^" + u[7:] + "$"
    seen, ctx = {}, {}
    for u in urls:
        s, good = marked(u), ".com/en/" in u
        if (good or ".org/es/" in u) and zlib.crc32(s.encode()) % 5:
            for i in range(4, len(s)):
                for n in range(5):
                    for table, key in ((seen, s[i - n : i + 1]), (ctx, s[i - n : i])):
                        table.setdefault(key, [0, 0])[0 if good else 1] += 1
    all_ = 0.2 * 64

    def one(g):
        for n in range(4, -1, -1):
            c = ctx.get(g[4 - n : 4])
            if c and sum(c) >= 20:
                a, b = seen.get(g[4 - n :], (None, None))
                if a is None:
                    return math.log((c[1] + all_) / (c[0] + all_))
                return math.log((a + 0.2) / (c[0] + all_)) - math.log((b + 0.2) / (c[1] + all_))
        return 0.0

    got = {r["page_id"]: r["ratio"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        s = marked(u)
        assert abs(got[k] - sum(one(s[i - 4 : i + 1]) for i in range(4, len(s))) / (len(s) - 4)) < 6e-4


def test_html_blocks_on_a_passing_path_all_count():
    long_, short = "Some words, and more. " * 30, "Other words, and more. " * 13
    page = f"<body><div><section><p>{long_}</p></section><section><h2>Head</h2><p>{short}</p></section></div><div><i>x</i></div></body>"
    assert html_extract.extract(page) == f"{long_.strip()}\nHead\n{short.strip()}"
    rows = [f"{k} {'Words, in a row. ' * (5 + 3 * k)}".strip() for k in range(5)]
    page = "<body>" + "".join(f"<div class=row><div class=col><p>{t}</p></div></div>" for t in rows) + "</body>"
    assert html_extract.extract(page) == "\n".join(rows)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<article><p>a, b.</p></article>", "x"), (2, None, "x"), (2, None, "x")], "page_id long, html string, text string")
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect()) == Counter([(1, "a, b.", 5), (2, "", 0), (2, "", 0)])


def test_components_release_every_round(spark, monkeypatch):
    # the driver gives back what the rounds leave behind, native memory included, while they run
    rounds, settled = [], []
    own, settle = exchange.release, exchange.settle
    monkeypatch.setattr(exchange, "release", lambda s: (rounds.append(len(settled)), own(s)))
    monkeypatch.setattr(exchange, "settle", lambda d: (settled.append(1), settle(d))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(30, 31)], "u long, v long")
    got = {r["node"]: r["root"] for r in exchange.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 13), 0), 31: 30}
    assert len(settled) > 3 and rounds == list(range(2, len(settled) + 1))
    assert "Trim native heap" in exchange._trim(spark) or os.uname().sysname != "Linux"


def test_stages_begin_with_rested_executors(spark, monkeypatch):
    # what earlier jobs left on an executor's heap goes, and each stage of the pipeline has that done before all else
    import corpus_pipeline

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    left = spark._jvm.java.nio.ByteBuffer.allocate(300 << 20)
    full = runtime.totalMemory() - runtime.freeMemory()
    del left
    gc.collect()
    exchange.rest(spark)
    assert full - (runtime.totalMemory() - runtime.freeMemory()) > 200 << 20
    rows = [pa.RecordBatch.from_pylist([{"done": "a"}]), pa.RecordBatch.from_pylist([{"done": None}])]
    assert list(exchange._trimmed(iter(rows))) == rows

    class Rested(Exception):
        pass

    def rest(_):
        raise Rested

    monkeypatch.setattr(exchange, "rest", rest)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Rested):
            stage(spark, None, None)
