"""LM scoring with a probabilistic suffix tree over words.

The root is the add-``ALPHA`` distribution of single tokens. A context of up to ``DEPTH`` words is a candidate if
it occurs ``MIN_CONTEXT`` times in training, whatever the corpus's size. A candidate's next-token distribution takes
``DISCOUNT`` off each count and gives all that to its parent's distribution (the context one word shorter), so it sums to one. It
becomes a state if it diverges from its parent for the better: each of its occurrences is scored by the
distribution without that occurrence, and all of them together must gain ``DIVERGENCE`` nats over the parent. So a context
whose continuations are no better known than by chance is no state, however often it occurs. A token is scored by
the state of the longest context before it. Texts begin in the context of an end.

Counts run over all training texts. Documents are coded as blobs of token numbers. Each blob asks hash buckets about its distinct tokens, then about
its distinct (context, token) pairs, and gets global counts back. A frequent context is split over buckets by
its next token, in proportion to its share, so no bucket has all continuations of a common word. Pairs move as hashes of
``KEY`` bytes inside their context's group, and parents' probabilities, which only the divergence test needs, in steps. Blobs
are a table dealt by blob, answers are tables, and the messages of a level go from the disks before those of the next are written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textcode as T
from .suffix_dedup import planes, unplanes

ALPHA, DEPTH = 0.1, 3
MIN_CONTEXT, DISCOUNT, DIVERGENCE = 2, 0.8, 4.0
KEY = 4  # bytes of a (context, token) hash within its context's group
FINE = 10.0  # steps of a parent's log probability, as it is sent for the divergence test
BLOB_TEXT = 6 << 20
END = np.uint64(0x5851F42D4C957F2D)
_ANSWER = "level int, bucket int, blob long, told binary"
_SENT = "bucket int, blob long, n_groups int, n_pairs int, keys binary, rest binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _squeeze(*columns: tuple[np.ndarray, int]) -> bytes:
    """The ``planes`` of some columns, each with its width, compressed."""
    return pa.compress(b"".join(planes(v, w) for v, w in columns), codec="zstd", asbytes=True)


def _unsqueeze(raw: pa.BinaryScalar | bytes, *columns: tuple[int, int]) -> list[np.ndarray]:
    """Columns that ``_squeeze`` packed, by their lengths and widths."""
    ends = np.cumsum([0, *(n * w for n, w in columns)])
    flat = memoryview(pa.decompress(raw.as_buffer() if isinstance(raw, pa.Scalar) else raw, int(ends[-1]), codec="zstd"))
    return [unplanes(flat[i:j], w) for i, j, (_, w) in zip(ends[:-1].tolist(), ends[1:].tolist(), columns, strict=True)]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct value, in the order of these places, and each value's number."""
    code = pa.array(values).dictionary_encode().indices.to_numpy()
    first = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first, code


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Order by bucket that keeps the order inside each."""
    return np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")


def _deal(kind: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``exchange.deal`` of sorted hashes."""
    bucket = (kind >> np.uint64(40)) % np.uint64(buckets)
    order = _by_bucket(bucket, buckets)
    present, first = np.unique(bucket[order], return_index=True)
    return order, present.astype(np.int64), np.append(first, len(kind))


class _Blob:
    """A blob's tokens: hashes, the document of each, and which documents train."""

    def __init__(self, kind: np.ndarray, code: np.ndarray, n: np.ndarray, ids: list) -> None:
        self.kind, self.code, self.n, self.ids = kind, code, n, ids
        self.token = kind[code]
        self.doc = np.repeat(np.arange(len(n)), n)
        self.first = np.cumsum(n) - n
        self.held = np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)
        self.train = ~self.held[self.doc]

    @classmethod
    def read(cls, ids: pa.Array, texts: pa.Array) -> _Blob:
        words, per = T.word_hashes(*T.buffers(texts))
        n = per + 1
        token = np.full(int(n.sum()), END, np.uint64)
        inside = np.ones(len(token), bool)
        inside[np.cumsum(n) - 1] = False
        token[inside] = words
        kind, _, code = T.unique(token)
        return cls(kind, code, n, ids.to_pylist())

    @classmethod
    def unpacked(cls, row: dict) -> _Blob:
        n = unplanes(row["sizes"], 4).astype(np.int64)
        (kinds,) = _unsqueeze(row["kinds"], (row["n_kinds"], 8))
        (codes,) = _unsqueeze(row["codes"], (int(n.sum()), 4))
        order = np.argsort(kinds, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(kinds[order], rank[codes.view(np.int64)], n, row["ids"])

    def packed(self) -> dict:
        """Frequent kinds get small numbers, which compress."""
        order = np.argsort(-np.bincount(self.code, minlength=len(self.kind)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return {"n_kinds": len(order), "kinds": _squeeze((self.kind[order], 8)), "codes": _squeeze((rank[self.code], 4)), "sizes": planes(self.n, 4), "ids": self.ids}

    def counts(self) -> np.ndarray:
        return np.bincount(self.code[self.train], minlength=len(self.kind)).astype(np.uint64)


_CODED = "blob long, n_kinds int, kinds binary, codes binary, sizes binary, ids array<bigint>"
_CODED_ARROW = pa.schema([("blob", pa.int64()), ("n_kinds", pa.int32()), ("kinds", pa.binary()), ("codes", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64()))])
_ASKED = "bucket int, blob long, keys binary, counts binary"


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Blob]]:
    """A partition's documents as blobs of a few megabytes. Their numbers and rows are the same whenever a partition is read."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for i, j in T.runs(batch["text"], BLOB_TEXT):
            with np.errstate(over="ignore"):
                yield number, _Blob.read(batch["doc_id"].slice(i, j - i), batch["text"].slice(i, j - i))
            number += 1


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, b in _blobs(batches):
        yield pa.RecordBatch.from_pylist([{"blob": number, **b.packed()}], _CODED_ARROW)


def _ask_tokens(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in ((r["blob"], _Blob.unpacked(r)) for batch in batches for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
            order, present, cut = _deal(b.kind, buckets)
            keys, counts = b.kind[order], b.counts()[order]
            part = lambda v: X.binary([planes(v[i:j], 8) for i, j in pairwise(cut)])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array([number] * len(present), pa.int64()), part(keys), part(counts)], ["bucket", "blob", "keys", "counts"])

    return ask


def _tell_tokens(table: pa.Table) -> pa.Table:
    keys = [unplanes(x.as_buffer(), 8) for x in table.column("keys").combine_chunks()]
    counts = np.concatenate([unplanes(x.as_buffer(), 8) for x in table.column("counts").combine_chunks()])
    sizes = np.cumsum([0, *(len(k) for k in keys)])
    kind, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(code, counts, len(kind)).astype(np.uint64)
    n = len(table)
    first = np.zeros(n, bool)
    first[0] = True
    return pa.table(
        {"level": pa.array([0] * n, pa.int32()), "bucket": table.column("bucket"), "blob": table.column("blob"), "told": X.binary([_squeeze((total[code[i:j]], 8)) for i, j in pairwise(sizes)]),
         "n": pa.array(np.where(first, int(total.sum()), 0), pa.int64()), "v": pa.array(np.where(first, int((total > 0).sum()), 0), pa.int64())}
    )


class _Model:
    """What a blob knows of the tree after some levels of answers."""

    def __init__(self, blob: _Blob, told: pa.Table, n: int, v: int, buckets: int) -> None:
        self.b, self.n, self.v, self.buckets = blob, n, v, buckets
        self.told = dict(zip(zip(told.column("level").to_pylist(), told.column("bucket").to_pylist(), strict=True), told.column("told").combine_chunks(), strict=True))
        order, present, cut = _deal(blob.kind, buckets)
        count = np.zeros(len(blob.kind))
        for bucket, i, j in zip(present.tolist(), cut[:-1], cut[1:], strict=True):
            (count[order[i:j]],) = _unsqueeze(self.told[0, bucket], (int(j - i), 8))
        self.count = count[blob.code]
        self.base = ((count + ALPHA) / (n + ALPHA * (v + 1)))[blob.code]
        self.common, self.p = self.count > 0, self.base.copy()  # p: each token's probability after its longest state so far

    def contexts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The context of ``level`` words before each place, as a number; whether it is a candidate; and each number's hash and training count."""
        b = self.b
        own, ok = np.zeros(len(b.token), np.int64), np.zeros(len(b.token), bool)
        if level == 1:
            own[1:] = b.code[:-1]
            own[b.first] = np.searchsorted(b.kind, END)
            count = np.zeros(len(b.kind))
            count[b.code] = self.count
            return own, count[own] >= MIN_CONTEXT, T.mix(b.kind + np.uint64(1)), count
        # the pair at the place before is the context one word longer; both parts of it must be states
        hashes, total, code, at = self.pairs
        own[at] = code
        inside = np.zeros(len(b.token), bool)
        inside[at] = self.inside[at]
        own[1:], ok[1:] = own[:-1].copy(), inside[:-1]
        ok &= self.inside & (total[own] >= MIN_CONTEXT if len(total) else False)
        ok[b.first] = False
        return own, ok, hashes, total

    def plan(self, level: int) -> dict:
        """The pairs of one level as they are sent: arranged by bucket and group, with the groups' headers."""
        b = self.b
        own, ok, hashes, count = self.contexts(level)
        # one header for each part of each context that occurs here
        there = np.zeros(len(hashes), bool)
        there[own[ok]] = True
        seen = np.flatnonzero(there)
        many = np.maximum(1, np.ceil(count[seen] / self.n * self.buckets)).astype(np.int64)
        start = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(seen)), many)
        sub = np.arange(len(owner)) - start[owner]
        group = T.mix(hashes[seen][owner] + sub.astype(np.uint64) * T._M1)
        bucket = ((group >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        by = _by_bucket(bucket, self.buckets)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        number = np.zeros(len(hashes), np.int64)
        number[seen] = np.arange(len(seen))
        at = np.flatnonzero(ok & self.common)
        where = number[own[at]]
        home = start[where]
        split = np.flatnonzero(many[where] > 1)
        pair = T.mix(hashes[own[at[split]]] * T._P + b.token[at[split]])
        home[split] += ((pair >> np.uint64(8)) % many[where[split]].astype(np.uint64)).astype(np.int64)
        # sorted by home, then token: one sort of numbers that also hold the place
        bits = max(1, int(len(at)).bit_length())
        step = max(1, int(len(b.kind) - 1).bit_length())
        wide = rank[home] << step | b.code[at]
        if len(by) >> max(0, 63 - bits - step):  # no room for the place
            order = np.argsort(wide, kind="stable")
            wide = wide[order]
        else:
            wide = np.sort(wide << bits | np.arange(len(at)))
            order = wide & ((1 << bits) - 1)
            wide >>= bits
        head = np.ones(len(order), bool)
        head[1:] = wide[1:] != wide[:-1]
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(head) - 1
        first = at[order[head]]
        kind = T.mix(hashes[own[first]] * T._P + b.token[first])
        return {"own": own, "ok": ok, "at": at, "code": code, "kind": kind, "first": first, "home": wide[head] >> step, "groups": group[by], "sizes": count[seen][owner][by], "bucket": bucket[by], "owner": owner[by], "number": number, "count": count, "n_seen": len(seen)}

    def ask(self, level: int, blob: int) -> pa.Table:
        p = self.plan(level)
        count = np.bincount(p["code"][self.b.train[p["at"]]], minlength=len(p["kind"])).astype(np.uint64)
        per = np.bincount(p["home"], minlength=len(p["groups"]))
        present, first = np.unique(p["bucket"], return_index=True)
        gcut = np.append(first, len(p["groups"]))
        ecut = np.append(0, np.cumsum(per))[gcut]
        parent = np.minimum(np.rint(np.log(self.p[p["first"]]) * -FINE), 255).astype(np.uint64)
        keys, rest = [], []
        for g, h, i, j in zip(gcut[:-1].tolist(), gcut[1:].tolist(), ecut[:-1].tolist(), ecut[1:].tolist(), strict=True):
            keys.append(planes(p["groups"][g:h], 6) + planes(p["kind"][i:j], KEY))
            rest.append(_squeeze((p["sizes"][g:h], 5), (per[g:h], 4), (count[i:j], 4), (parent[i:j], 1)))
        return pa.table(
            {"bucket": pa.array(present.astype(np.int32)), "blob": pa.array([blob] * len(present), pa.int64()), "n_groups": pa.array(np.diff(gcut).astype(np.int32)), "n_pairs": pa.array(np.diff(ecut).astype(np.int32)), "keys": X.binary(keys), "rest": X.binary(rest)}
        )

    def learn(self, level: int) -> None:
        """Takes in the answers of one level."""
        p = self.plan(level)
        total = np.zeros(len(p["kind"]))
        per = np.bincount(p["home"], minlength=len(p["groups"]))
        present, first = np.unique(p["bucket"], return_index=True)
        gcut = np.append(first, len(p["groups"]))
        ecut = np.append(0, np.cumsum(per))[gcut]
        part = np.empty((2, len(p["groups"])), np.uint32)
        for bucket, g, h, i, j in zip(present.tolist(), gcut[:-1].tolist(), gcut[1:].tolist(), ecut[:-1].tolist(), ecut[1:].tolist(), strict=True):
            total[i:j], part[0, g:h], part[1, g:h] = _unsqueeze(self.told[level, bucket], (j - i, 4), (h - g, 4), (h - g, 4))
        gain, kinds = (np.bincount(p["owner"], x, p["n_seen"] + 1) for x in part.view(np.float32))
        if not p["n_seen"]:
            self.pairs, self.inside = (p["kind"], total, p["code"], p["at"]), np.zeros(len(self.p), bool)
            return
        some = np.flatnonzero(p["ok"])
        where = p["number"][p["own"][some]]
        good = gain[where] >= DIVERGENCE
        some, where = some[good], where[good]
        state, mine = np.zeros(len(self.p), bool), np.zeros(len(self.p))
        state[some] = True
        mine[p["at"]] = total[p["code"]]
        c = p["count"][p["own"][some]]
        # the state's own part of the distribution, and what it leaves to its parent
        self.p[some] = np.maximum(mine[some] - DISCOUNT, 0) / c + DISCOUNT * kinds[where] / c * self.p[some]
        self.pairs, self.inside = (p["kind"], total, p["code"], p["at"]), state


def _tell_pairs(level: int, n: int, buckets: int):
    def tell(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return answer(table)

    def answer(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).combine_chunks()
        n_groups, n_pairs = col("n_groups").to_pylist(), col("n_pairs").to_pylist()
        gcut, ecut = np.cumsum([0, *n_groups]), np.cumsum([0, *n_pairs])
        heads, keys, rest = [], [], []
        for raw, more, g, e in zip(col("keys"), col("rest"), n_groups, n_pairs, strict=True):
            flat = memoryview(raw.as_buffer())
            heads.append(unplanes(flat[: 6 * g], 6))
            keys.append(unplanes(flat[6 * g :], KEY))
            rest.append(_unsqueeze(more, (g, 5), (g, 4), (e, 4), (e, 1)))
        sizes, per, counts, parents = (np.concatenate(x) for x in zip(*rest, strict=True))
        heads = np.concatenate(heads)
        one, which = _numbered(heads)
        group, size = heads[one], sizes[one].astype(np.float64)
        own = np.repeat(which, per.astype(np.int64))
        first, code = _numbered(T.mix(np.concatenate(keys) + group[own]))  # a pair is a short hash inside its group
        total = np.bincount(code, counts, len(first))
        home = own[first]
        parent = np.exp(parents[first].astype(np.float64) / -FINE)
        # a split context's kinds of next token are estimated from those of this part
        parts = np.maximum(1, np.ceil(size / n * buckets))
        kinds = np.bincount(home, total > 0, len(group))
        all_, c = (kinds * parts)[home], np.maximum(size[home], 2)
        without = (np.maximum(total - 1 - DISCOUNT, 0) + DISCOUNT * np.maximum(all_ - (total == 1), 1e-6) * parent) / (c - 1)
        gain = np.bincount(home, total * np.log(without / parent), len(group))
        # a context in one part is judged here: its gain is told as a verdict, and no counts of one that is no state are ever used
        state = gain >= DIVERGENCE
        gain = np.where(parts > 1, gain, np.where(state, DIVERGENCE, 0))
        used = state | (parts > 1)
        kinds, total = kinds * used, total * used[home]
        out, told = total[code], np.stack([gain, kinds]).astype(np.float32).view(np.uint32)[:, which]
        return pa.table(
            {"level": pa.array([level] * len(table), pa.int32()), "bucket": table.column("bucket"), "blob": table.column("blob"),
             "told": X.binary([_squeeze((out[i:j], 4), (told[0, g:h], 4), (told[1, g:h], 4)) for (i, j), (g, h) in zip(pairwise(ecut), pairwise(gcut), strict=True)])}
        )

    return tell


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased, and an end counts as a token; a null or empty text is an end alone. A null ``doc_id`` trains and is not
    held out. Repeated rows count and come back as often as they came; other columns are ignored. Scores are log10.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = X.blob_count(rows)
    spark = docs.sparkSession
    with X.brief_shuffles(spark):
        blobs = X.settle_dealt(rows.mapInArrow(_code, _CODED), "blob")
        asked = blobs.mapInArrow(_ask_tokens(buckets), _ASKED)
        told = X.settle(asked.groupBy("bucket").applyInArrow(_tell_tokens, _ANSWER + ", n long, v long"))
        whole = told.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    told = told.drop("n", "v")

    def model(table: pa.Table, told: pa.Table, levels: int) -> _Model:
        m = _Model(_Blob.unpacked(table.to_pylist()[0]), told, n, v, buckets)
        for level in range(1, levels + 1):
            m.learn(level)
        return m

    def asker(level: int):
        def ask(table: pa.Table, told: pa.Table) -> pa.Table:
            with np.errstate(over="ignore", divide="ignore"):
                return model(table, told, level - 1).ask(level, table.column("blob")[0].as_py())

        return ask

    # each level's answers are a table before the next asks, so that no more than one level's messages are on the disks
    for level in range(1, DEPTH + 1):
        with X.brief_shuffles(spark):
            sent = blobs.groupBy("blob").cogroup(told.groupBy("blob")).applyInArrow(asker(level), _SENT)
            told = told.unionByName(X.settle(sent.groupBy("bucket").applyInArrow(_tell_pairs(level, n, buckets), _ANSWER)))
        X.release(spark)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", divide="ignore"):
            m = model(table, told, DEPTH)
        b, ten = m.b, np.log(10)
        size = len(b.ids)
        return pa.table(
            {"doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held), "n_tokens": pa.array(b.n.astype(np.int64)), "n_known": pa.array(np.bincount(b.doc, m.count > 0, size).astype(np.int64)), "train_tokens": pa.array([n] * size, pa.int64()),
             "base_score": pa.array(np.bincount(b.doc, np.log(m.base), size) / ten), "score": pa.array(np.bincount(b.doc, np.log(m.p), size) / ten)}
        )

    return blobs.groupBy("blob").cogroup(told.groupBy("blob")).applyInArrow(finish, _SCORES)
