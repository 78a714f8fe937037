"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of ``PARTS * BLOCK`` words. Their TF-IDF vectors (words hashed to ``FEATURES`` columns, document counts
over the whole corpus) are reduced by a randomised SVD: a random range finder with power iterations, each
one a pass of partial products over partitions, added up per slice of columns. It is fitted on all benchmark
passages and those of all documents, with equal weight, and its strong directions are damped.

Every passage of every document is compared with all benchmark passages by cosine in that space. Candidates are then
compared word by word: the longest common subsequence of the item and the text around the passage, and the share of the
item's answer words found there. An item is leaked if nearly all of it is there in order, or if
a good part is and the answer is there too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textcode as T

BLOCK, PARTS, FEATURES, RANK, OVERSAMPLE = 15, 2, 1 << 14, 128, 8
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.33, 0.8, 0.45, 0.4
SLICE, FIT_BYTES, FIT_PASSAGES, PIECE, ITEM_CHUNK = 1 << 9, 64 << 20, 1 << 15, 64, 4000
SLOTS, RUNS, PAIRS, ROOM = 1 << 12, 1024, 4096, 1024
_PACKED, _PACKED_NAMES = "slice int, values binary, n long, feature binary, per binary", ["slice", "values", "n", "feature", "per"]
_LEAKS = "doc_id long, text_key long, item_id long, cosine double, lcs double, answer double"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their feature, and the count of words of each text. Words are runs of letters, digits and non-ASCII."""
    with np.errstate(over="ignore"):
        words, per = T.word_hashes(*T.buffers(column), T.NOT_ALNUM)
    return words, ((words >> np.uint64(20)) % np.uint64(FEATURES)).astype(np.int64), per


def _slots(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)


def _slices(values: np.ndarray) -> pa.RecordBatch:
    """Rows of a (FEATURES, n) array by slices, for adding up."""
    return pa.RecordBatch.from_arrays([pa.array(range(0, FEATURES, SLICE), pa.int32()), pa.array([values[i : i + SLICE].astype(np.float32).tobytes() for i in range(0, FEATURES, SLICE)], pa.binary())], ["slice", "values"])


def _added(df: DataFrame, kind: type = np.float64) -> np.ndarray:
    """The sum of all ``_slices`` of a DataFrame: a fixed number of values, whatever the data."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column("values").combine_chunks())
        return pa.table({"slice": table.column("slice")[:1], "values": pa.array([total.astype(kind).tobytes()], pa.binary())})

    rows = sorted((r["slice"], bytes(r["values"])) for r in df.groupBy("slice").applyInArrow(add, "slice int, values binary").collect())
    return np.concatenate([np.frombuffer(x, kind) for _, x in rows]) if rows else np.zeros(0, kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts to a row: the features of all their words and each one's count of words; behind them how many texts hold each feature, by slices."""
    total = np.zeros((FEATURES, 2))
    for column in (b["text"].slice(k, min(j, k + 512) - k) for b in batches for i, j in T.runs(b["text"]) for k in range(i, j, 512)):
        _, feature, per = _tokens(column)
        doc = np.repeat(np.arange(len(per)), per)
        held = np.zeros((len(per), FEATURES), bool)
        held[doc, feature] = True
        for k in range(0, len(held), 255):  # so many fit in a byte
            total[:, 0] += np.add.reduce(held[k : k + 255].view(np.uint8), axis=0, dtype=np.uint8)
        total[0, 1] += len(per)
        none = pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())
        own = pa.array([len(feature)], pa.int64()), X.binary([feature.astype("<u2").tobytes()]), X.binary([per.astype("<u4").tobytes()])
        yield pa.RecordBatch.from_arrays([*none, *own], _PACKED_NAMES)
    slices = _slices(total)
    none = [pa.nulls(len(slices), kind) for kind in (pa.int64(), pa.binary(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*slices.columns, *none], _PACKED_NAMES)


def document_counts(packed: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents, from rows of ``_pack``."""
    got = _added(packed.where("slice IS NOT NULL").select("slice", "values"))
    got = got.reshape(FEATURES, 2) if len(got) else np.zeros((FEATURES, 2))
    return got[:, 0], int(got[:, 1].sum())


def _places(feature: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Features of each passage, without overlap, one passage to a row; places that a text's end leaves open hold ``FEATURES``."""
    step = PARTS * BLOCK
    inside = np.arange(len(feature)) - np.repeat(np.cumsum(per) - per, per)
    parts = -(-per // step)
    places = np.full(int(parts.sum()) * step, FEATURES, np.uint16)
    places[np.repeat((np.cumsum(parts) - parts) * step, per) + inside] = feature
    return places.reshape(-1, step)


def _fit_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_places`` of rows ``feature, per, weight`` and the passages' weights, up to ``FIT_PASSAGES`` at a time."""

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p for p, _ in some]), np.concatenate([w for _, w in some])

    some, n = [], 0
    for batch in batches:
        for feature, per, weight in zip(batch["feature"], batch["per"], batch["weight"].to_pylist(), strict=True):
            places = _places(np.frombuffer(feature.as_buffer(), "<u2"), np.frombuffer(per.as_buffer(), "<u4").astype(np.int64))
            for a in range(0, len(places), FIT_PASSAGES):
                part = places[a : a + FIT_PASSAGES]
                if n + len(part) > FIT_PASSAGES:
                    yield merged()
                    some, n = [], 0
                some.append((part, np.full(len(part), weight)))
                n += len(part)
    if some:
        yield merged()


def _sums(values: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[at]``, ``count`` of them after each other at a time, in pieces of ``PIECE`` rows."""
    pieces = -(-count // PIECE)
    owner = np.repeat(np.arange(len(count)), pieces)
    first = np.repeat(np.cumsum(count) - count, pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, size = first + number * PIECE, np.minimum(count[owner] - number * PIECE, PIECE)
    by = np.argsort(-size, kind="stable")
    out = np.empty((len(owner), values.shape[1]), np.float32)
    own, room = np.empty((2, ROOM, values.shape[1]), np.float32)
    for a in range(0, len(by), ROOM):
        some = by[a : a + ROOM]
        begin, long = first[some], size[some]
        np.take(values, at[begin], axis=0, out=own[: len(some)], mode="clip")
        # those of more than k rows come first
        for k, n in enumerate(np.searchsorted(-long, -np.arange(1, int(long[0]))).tolist(), 1):
            np.take(values, at[begin[:n] + k], axis=0, out=room[:n], mode="clip")
            own[:n] += room[:n]
        out[some] = own[: len(some)]
    return out if len(out) == len(count) else _sums(out, np.arange(len(out)), pieces)


def fit(texts: DataFrame, idf: np.ndarray, seed: int = 11, power: int = 2) -> np.ndarray:
    """Projection (FEATURES, RANK) of TF-IDF vectors, from rows ``feature, per, weight`` of all texts, with its strong directions damped."""
    basis = np.random.default_rng(seed).normal(size=(FEATURES, RANK + OVERSAMPLE))
    sc = texts.sparkSession.sparkContext

    def multiply(with_: np.ndarray) -> np.ndarray:
        """The passages' Gram matrix of features times ``with_``: one pass over all passages."""
        cast = sc.broadcast((idf * 1.0, (idf[:, None] * with_).astype(np.float32)))  # FEATURES by RANK numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scale, m = cast.value
            m = np.vstack([m, np.zeros((1, m.shape[1]), np.float32)])
            square = np.append(scale**2, 0)
            total = np.zeros((FEATURES, m.shape[1]))
            for places, weight in _fit_passages(batches):
                z = _sums(m, places.ravel().astype(np.int64), np.full(len(places), places.shape[1]))
                z *= (weight**2 / np.maximum(square[places].sum(1), 1e-18)).astype(np.float32)[:, None]
                order = np.argsort(places.ravel(), kind="stable")
                kind = places.ravel()[order]
                heads = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
                kind, count = kind[heads], np.diff(np.append(heads, len(kind)))
                if kind[-1] == FEATURES:
                    kind, count = kind[:-1], count[:-1]
                total[kind] += _sums(z, order // places.shape[1], count)
            yield _slices(total * scale[:, None])

        out = _added(texts.mapInArrow(run, "slice int, values binary"), np.float32).reshape(FEATURES, -1)
        cast.destroy()
        X.release(texts.sparkSession)
        return out.astype(np.float64)

    for _ in range(power):
        basis = np.linalg.qr(multiply(basis))[0]
    basis = np.linalg.qr(basis)[0]
    product = multiply(basis)
    # the last product also gives the matrix inside the basis, so directions and strengths need no further pass (Nystrom's approximation)
    values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    sound = values > 1e-6 * max(values[-1], 1e-12)
    basis, values, _ = np.linalg.svd(product @ (turn[:, sound] / np.sqrt(values[sound])), full_matrices=False)
    values = np.append(values**2, np.zeros(RANK))[:RANK]
    basis = np.column_stack([basis, np.zeros((FEATURES, RANK))])[:, :RANK]
    # strong directions are damped to the median one; weak ones are not blown up
    scale = 1 / np.sqrt(np.maximum(values, max(float(np.median(values)), 1e-12)))
    return (idf[:, None] * (basis * scale)).astype(np.float32)


def projection(packed: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """``fit`` on the passages of all documents (rows of ``_pack``) and of all items, with equal weight by words."""
    own = items.select("text").mapInArrow(_pack, _PACKED).where("feature IS NOT NULL")
    docs = packed.where("feature IS NOT NULL")
    mass, mine = (d.agg(F.sum("n")).first()[0] or 0 for d in (docs, own))
    # a pass sends one matrix a partition, so a partition is of some size
    parts = max(packed.sparkSession.sparkContext.defaultParallelism, -(-2 * mass // FIT_BYTES))
    weight = float(np.sqrt(max(mass, 1) / max(mine, 1)))
    columns = ["feature", "per", "weight"]
    return fit(docs.withColumn("weight", F.lit(1.0)).select(columns).coalesce(parts).unionByName(own.withColumn("weight", F.lit(weight)).select(columns)), idf)


def passages(feature: np.ndarray, per: np.ndarray, project: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all passages of some texts, and each one's text and first block.

    A passage is ``PARTS`` blocks from each block on (fewer at a text's end, but the last only if it is the first).
    """
    blocks = -(-per // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros((0, project.shape[1]), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # every block has BLOCK places; those that a text's end leaves open point to a row of zeros
    inside = np.arange(len(feature)) - np.repeat(np.cumsum(per) - per, per)
    places = np.full(total * BLOCK, len(project), np.int64)
    places[np.repeat((np.cumsum(blocks) - blocks) * BLOCK, per) + inside] = feature
    padded = np.vstack([project, np.zeros((1, project.shape[1]), np.float32)])
    sums = np.empty((total, project.shape[1]), np.float32)
    for a in range(0, total, 256):
        part = places[a * BLOCK : (a + 256) * BLOCK].reshape(-1, BLOCK)
        own = sums[a : a + 256]
        np.take(padded, part[:, 0], axis=0, out=own)
        for k in range(1, BLOCK):
            own += padded[part[:, k]]
    text = np.repeat(np.arange(len(per)), blocks)
    number = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    out = sums.copy()
    for d in range(1, PARTS):
        same = text[:-d] == text[d:]
        out[:-d][same] += sums[d:][same]
    keep = (number <= blocks[text] - PARTS) | (number == 0)
    out, text, number = out[keep], text[keep], number[keep]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), text, number


def masks(a: list[int]) -> dict[int, int]:
    """The places of each word, as the bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    return common(masks(a), b, 0)


def common(where: dict[int, int], b: list[int], least: int) -> int:
    """``lcs`` of the words of ``masks`` and ``b``, or 0 if it is under ``least``.

    One integer's bits are the row of the table. Words that are not there change nothing, and what lacks too many is not looked at.
    """
    hits = list(filter(None, map(where.get, b)))
    if len(hits) < least or reduce(or_, hits, 0).bit_count() < least:
        return 0
    row = 0
    for m in hits:
        u = row | m
        row = u & ~(u - (row << 1 | 1))
    found = row.bit_count()
    return found if found >= least else 0


def _flat(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some runs, and the run of each."""
    row = np.repeat(np.arange(len(count)), count)
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(row)), row


def shared(at: np.ndarray, lens: np.ndarray, slots: np.ndarray, run: np.ndarray, item_at: np.ndarray, item_lens: np.ndarray, item_slots: np.ndarray) -> np.ndarray:
    """For pairs of a run of text words and an item: how many of the item's words may be in the run.

    ``run`` is the run of each pair, in order. Words are hashed to ``SLOTS`` places, so this is never too small, and never
    below the longest common subsequence.
    """
    out = np.empty(len(run), np.int64)
    table = np.zeros((RUNS, SLOTS), bool)
    for a in range(0, len(at), RUNS):
        table[:] = False
        where, row = _flat(at[a : a + RUNS], lens[a : a + RUNS])
        table[row, slots[where]] = True
        i, j = np.searchsorted(run, (a, a + RUNS))
        for i in range(i, j, PAIRS):
            k = min(i + PAIRS, j)
            where, row = _flat(item_at[i:k], item_lens[i:k])
            held = table.ravel().take(((run[i:k] - a) * SLOTS)[row] + item_slots[where])
            out[i:k] = np.add.reduceat(held, np.cumsum(item_lens[i:k]) - item_lens[i:k], dtype=np.int64)  # no item is empty
    return out


def _answer(words: np.ndarray, weight: np.ndarray, answer: np.ndarray) -> set[int]:
    """The words of the item's answer, or else its rarer half."""
    if len(answer):
        return set(answer.tolist())
    order = np.lexsort((np.arange(len(words)), -weight))
    return set(words[order[: max(1, len(words) // 2)]].tolist())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, text_key, item_id, cosine, lcs, answer``.

    ``text_key`` is the xxhash64 of the text. ``docs`` needs ``doc_id`` and ``text``; ``benchmark`` needs ``item_id`` and ``text`` and may have ``answer``; other columns
    are ignored. Null or empty texts hold nothing and are held by nothing. A null id comes back as null; repeated rows
    give repeated rows. ``cosine`` is the best of the item's passages, ``lcs`` the share of the item's words found in
    order, ``answer`` the share of its answer words found (of its rarer half where it has no answer).
    Items are compared in chunks of ``ITEM_CHUNK``, each sent to all executors, so its size is bounded.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer")).where("text IS NOT NULL AND trim(text) <> ''")
    # words are hashed once for the counts and all passes of the fit
    packed = X.settle(rows.select("text").mapInArrow(_pack, _PACKED))
    held, n = document_counts(packed)
    idf = np.log((n + 1) / (held + 1)) + 0.05
    n_items = items.count()
    if not n_items or not n:
        X.discard(packed)
        return spark.createDataFrame([], _LEAKS)
    project = projection(packed, items, idf)
    X.discard(packed)
    del packed
    X.release(spark)
    chunks = -(-n_items // ITEM_CHUNK)
    found = None
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).toArrow()
        one = _search(rows, part, project, idf)
        found = one if found is None else found.unionByName(one)
    return found


def _search(rows: DataFrame, part: pa.Table, project: np.ndarray, idf: np.ndarray) -> DataFrame:
    words, feature, per = _tokens(part.column("text"))
    unit, owner, _ = passages(feature, per, project)
    cut = np.cumsum(per) - per
    answers, _, answer_per = _tokens(part.column("answer"))
    answer_cut = np.cumsum(answer_per) - answer_per
    seqs = [words[a : a + m].tolist() for a, m in zip(cut, per, strict=True)]
    keys = [_answer(words[a : a + m], idf[feature[a : a + m]], answers[x : x + y]) if m else set() for a, m, x, y in zip(cut, per, answer_cut, answer_per, strict=True)]
    cast = rows.sparkSession.sparkContext.broadcast((project, unit, owner, seqs, keys, cut, per, _slots(words), part.column("item_id").to_pylist()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, unit, owner, seqs, keys, item_at, item_lens, item_slots, item_ids = cast.value
        where = [masks(x) for x in seqs]
        for whole in batches:
            out: list[list] = [[], [], [], [], [], []]
            for batch in (whole.slice(k, min(j, k + 500) - k) for i, j in T.runs(whole["text"]) for k in range(i, j, 500)):
                words, feature, per = _tokens(batch["text"])
                begin, slots = np.cumsum(per) - per, _slots(words)
                own, text, number = passages(feature, per, project)
                ids, keys_ = batch["doc_id"].to_pylist(), batch["text_key"].to_pylist()
                best: dict[tuple[int, int], tuple[float, float]] = {}
                top: dict[tuple[int, int], float] = {}
                for a in range(0, len(own), 4096):
                    cosine = own[a : a + 4096] @ unit.T
                    p, q = np.divmod(np.flatnonzero(cosine >= COSINE), max(len(unit), 1))
                    near = cosine[p, q]
                    # pairs of one passage and items of about one length look at the same run of words
                    kind = p << 6 | np.ceil(np.log2(item_lens[owner[q]])).astype(np.int64)
                    order = np.argsort(kind, kind="stable")
                    p, q, kind, near = p[order], q[order], kind[order], near[order]
                    run = np.cumsum(np.diff(kind, prepend=-1) != 0) - 1
                    t, block, i = text[a + p], number[a + p], owner[q]
                    one = np.flatnonzero(np.diff(kind, prepend=-1))
                    reach = 1 << (kind[one] & 63)
                    first = np.maximum(0, block[one] * BLOCK - reach)
                    last = np.minimum(per[t[one]], (block[one] + PARTS) * BLOCK + reach)
                    # what shares too few words cannot have a common subsequence that is long enough
                    fits = np.flatnonzero(shared(begin[t[one]] + first, last - first, slots, run, item_at[i], item_lens[i], item_slots) >= PARAPHRASE * item_lens[i])
                    lo = np.maximum(0, block * BLOCK - item_lens[i])
                    hi = np.minimum(per[t], (block + PARTS) * BLOCK + item_lens[i])
                    for u in fits.tolist():
                        key, seq = (int(t[u]), int(i[u])), seqs[i[u]]
                        if best.get(key, (0.0, 0.0))[0] == 1:
                            continue
                        run_ = words[begin[t[u]] + lo[u] : begin[t[u]] + hi[u]].tolist()
                        if share := common(where[key[1]], run_, math.ceil(PARAPHRASE * len(seq) - 1e-9)) / len(seq):
                            found = share, len(keys[key[1]].intersection(run_)) / len(keys[key[1]])
                            best[key] = max(best.get(key, found), found)
                    code = t * len(seqs) + i
                    order = np.argsort(code, kind="stable")
                    heads = np.flatnonzero(np.diff(code[order], prepend=-1))
                    for c, v in zip(code[order][heads].tolist(), np.maximum.reduceat(near[order], heads).tolist() if len(heads) else (), strict=True):
                        key = divmod(c, len(seqs))
                        top[key] = max(top.get(key, v), v)
                for (t, i), (share, said) in best.items():
                    if share >= VERBATIM or share >= PARAPHRASE and said >= ANSWER:
                        for k, v in enumerate((ids[t], keys_[t], item_ids[i], top[t, i], share, said)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), *(pa.array(x, pa.float64()) for x in out[3:])], ["doc_id", "text_key", "item_id", "cosine", "lcs", "answer"])

    return rows.mapInArrow(search, _LEAKS)
