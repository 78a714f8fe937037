"""Substring dedup by content-sampled anchors: bytes covered by a string of 50 bytes that also starts in an earlier document.

Positions are sampled by content: in each window of 50 bytes the k-gram with the smallest hash is its anchor,
so two equal windows have equal anchors. The *context* of an anchor is all that such windows can cover.

1. Each blob of documents sends its distinct (anchor, context, first document) to hash buckets, as packed hashes.
2. A bucket answers per context: an earlier document has the same context (all of it goes), or nobody does, or others
   have the anchor with another context that agrees on one side far enough to share a window.
3. Only contexts of the last kind are sent as bytes. Their bucket sorts the suffixes at all window starts and takes
   longest previous factors, by the previous and next smaller document in suffix order: a string of 50 bytes stands in an
   earlier document exactly if its factor is that long, so the first copy of each string stays.
4. Each blob removes the covered bytes of its documents.

Texts are read whole; a passage that a third of the documents hold is one context, sent once per blob.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import exchange as X
from . import textcode as T

GRAM, SIDE = 24, 13
_LAST = np.iinfo(np.int64).max
_RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte for all, so that constant bytes compress away."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes | memoryview, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view(np.uint64)[:, 0]


def _sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Anchors:
    """The anchors of some texts: document's row, place, start and end of the context, and their hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int) -> None:
        parts = [self._slab(raw, offsets, i, j, window) for i, j in T.slabs(offsets)]
        parts = [p for p in parts if p is not None]
        empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.row, self.place, self.start, self.end, self.key, self.context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty

    @staticmethod
    def _slab(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, window: int):
        base = int(offsets[i])
        part, off = raw[base : offsets[j]], offsets[i : j + 1] - base
        n, span = len(part), window - GRAM + 1
        if n < window:
            return None
        sums, (_, inv) = T.prefix(part), T.powers(n + 1)
        h = T.mix((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1]) | np.uint64(1)
        low = _sliding(h, span, np.minimum)
        starts = np.zeros(n + 1, np.int32)  # a window may start from a text's first byte to ``window`` before its end
        size = np.diff(off)
        own = size >= window
        np.add.at(starts, off[:-1][own], 1)
        np.add.at(starts, off[1:][own] - window + 1, -1)
        low[np.cumsum(starts)[: len(low)] == 0] = 0
        high = np.zeros(len(h) + span - 1, np.uint64)
        high[span - 1 : span - 1 + len(low)] = low
        at = np.flatnonzero(_sliding(high, span, np.maximum)[: len(h)] == h)
        row = np.searchsorted(off, at, "right") - 1
        a, b = np.maximum(off[row], at - span + 1), np.minimum(off[row + 1], at + window)
        cut = lambda x, y: (sums[y] - sums[x]) * inv[x]
        whole = T.mix(cut(a, b) + (at - a).astype(np.uint64) * T._M1 + (b - at).astype(np.uint64) * T._M2)
        left_from, right_to = np.maximum(off[row], at - SIDE), np.minimum(off[row + 1], at + GRAM + SIDE)
        left = T.mix(cut(left_from, at) + (at - left_from).astype(np.uint64))
        right = T.mix(cut(at + GRAM, right_to) + (right_to - at).astype(np.uint64))
        context = (whole << np.uint64(16)) | ((left & np.uint64(255)) << np.uint64(8)) | (right & np.uint64(255))
        return row + i, at + base, a + base, b + base, h[at], context


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The blob's rows in a fixed order, their ids (null: last), bytes and offsets."""
    by = pa.table({"i": table.column("_lw_id"), "t": table.column("_lw_text")})
    table = table.take(pc.sort_indices(by, sort_keys=[("i", "ascending"), ("t", "ascending")]))
    ids = pc.fill_null(table.column("_lw_id"), _LAST).to_numpy()
    return table, ids, *T.buffers(table.column("_lw_text"))


def _distinct(anchors: Anchors, ids: np.ndarray, buckets: int):
    """Distinct (anchor, context) by bucket: keys, contexts, first document, bucket bounds; and the number of each anchor's."""
    doc = ids[anchors.row]
    bucket = ((anchors.key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, anchors.context, anchors.key, bucket))
    k, c = anchors.key[order], anchors.context[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = order[new]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    present, first = np.unique(bucket[head], return_index=True)
    return anchors.key[head], anchors.context[head], doc[head], present, np.append(first, len(head)), code


def _ask(window: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        blob = table.column("_lw_blob")[0].as_py()
        with np.errstate(over="ignore"):
            _, ids, raw, offsets = _ordered(table)
            key, context, doc, present, cut, _ = _distinct(Anchors(raw, offsets, window), ids, buckets)
        part = lambda v, w: X.binary([planes(v[a:b], w) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return pa.table({"bucket": pa.array(present.astype(np.int32)), "blob": pa.array([blob] * len(present), pa.int32()), "keys": part(key, 4), "contexts": part(context, 8), "docs": part(doc.astype(np.uint64), 8)})

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Per context that a blob sent: 0 nothing earlier, 1 an earlier document has it, 2 another context may share a window."""
    col = lambda name, w: [unplanes(x.as_buffer(), w) for x in table.column(name).combine_chunks()]
    keys, contexts, docs = col("keys", 4), col("contexts", 8), col("docs", 8)
    sizes = np.cumsum([0, *(len(k) for k in keys)])
    k, c, d = np.concatenate(keys), np.concatenate(contexts), np.concatenate(docs).view(np.int64)
    state = np.zeros(len(k), np.uint8)
    order = np.lexsort((d, c, k))
    ks, cs, ds = k[order], c[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    state[order] = ds[first] < ds
    head = np.flatnonzero(new)
    kh, ch = ks[head], cs[head]
    near = np.zeros(len(head), bool)
    for side in ((ch >> np.uint64(8)) & np.uint64(255), ch & np.uint64(255)):
        by = np.lexsort((side, kh))
        a, s = kh[by], side[by]
        same = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
        near[by[1:][same]] = True
        near[by[:-1][same]] = True
    spread = near[np.cumsum(new) - 1]
    state[order] = np.where(state[order] == 1, 1, np.where(spread, 2, 0))
    return pa.table({"bucket": table.column("bucket"), "blob": table.column("blob"), "kind": pa.array([0] * len(table), pa.int32()), "answer": X.binary([state[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:], strict=True)])})


def _states(told: pa.Table, present: np.ndarray, cut: np.ndarray) -> np.ndarray:
    state = np.zeros(int(cut[-1]), np.uint8)
    where = {b: (lo, hi) for b, lo, hi in zip(present.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
    for b, kind, x in zip(told.column("bucket").to_pylist(), told.column("kind").to_pylist(), told.column("answer").combine_chunks(), strict=True):
        if kind == 0:
            state[slice(*where[b])] = np.frombuffer(x.as_buffer(), np.uint8)
    return state


def _open(anchors: Anchors, ids: np.ndarray, doc: np.ndarray, code: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts to be compared byte by byte, and for each an anchor that shows it."""
    mine = np.flatnonzero((state[code] == 2) & (ids[anchors.row] == doc[code]))
    which, first = np.unique(code[mine], return_index=True)
    return which, mine[first]


def _ship(window: int, buckets: int):
    def ship(table: pa.Table, told: pa.Table) -> pa.Table:
        blob = told.column("blob")[0].as_py() if len(told) else 0
        out = {"bucket": [], "blob": [], "texts": [], "lengths": [], "docs": []}
        if len(table):
            with np.errstate(over="ignore"):
                _, ids, raw, offsets = _ordered(table)
                anchors = Anchors(raw, offsets, window)
                _, _, doc, present, cut, code = _distinct(anchors, ids, buckets)
                which, shown = _open(anchors, ids, doc, code, _states(told, present, cut))
            at = np.searchsorted(cut, which, "right") - 1
            for b in np.unique(at).tolist():
                some = shown[at == b]
                out["bucket"].append(int(present[b]))
                out["blob"].append(blob)
                out["texts"].append(b"".join(raw[x:y].tobytes() for x, y in zip(anchors.start[some].tolist(), anchors.end[some].tolist(), strict=True)))
                out["lengths"].append((anchors.end[some] - anchors.start[some]).astype(np.uint8).tobytes())
                out["docs"].append(ids[anchors.row[some]].tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "blob": pa.array(out["blob"], pa.int32()), "texts": X.binary(out["texts"]), "lengths": X.binary(out["lengths"]), "docs": X.binary(out["docs"])})

    return ship


def previous_factors(docs: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in sorted order: the longest prefix that each shares with one of a smaller document.

    ``lcp[i]`` is what suffix i shares with the one before it. The nearest suffix of a smaller document on either side
    shares most; pointers to it jump over what lies between, all at once, and carry the least ``lcp`` on the way.
    """
    best = np.zeros(len(docs), np.int64)
    for turned in (False, True):
        d = docs[::-1] if turned else docs
        low = (np.append(lcp[1:], 0)[::-1] if turned else lcp).copy()
        to = np.arange(len(d)) - 1
        left = np.arange(len(d))
        while len(left := left[(to[left] >= 0) & (low[left] > 0) & (d[to[left]] >= d[left])]):
            j = to[left]
            low[left], to[left] = np.minimum(low[left], low[j]), to[j]
        low[to < 0] = 0
        best = np.maximum(best, low[::-1] if turned else low)
    return best


def earlier_copies(texts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all strings of ``window`` bytes in some pieces of text, which also stand in an earlier document's piece.

    Returns (piece, place in the piece). Suffixes are sorted by their first ``window`` bytes and their longest previous
    factors taken, up to that length: a string stands in an earlier document exactly if its factor is that long.
    """
    ends = np.cumsum(lengths)
    each = lengths - window + 1
    piece = np.repeat(np.arange(len(lengths)), each)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(each) - each, each)
    start = (ends - lengths)[piece] + place
    padded = np.concatenate([texts, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).view(">u8")[:, 0] if len(texts) else np.zeros(0, np.uint64)
    at = [min(k, window - 8) for k in range(0, window, 8)]
    columns = [words[start + k].astype(np.uint64) for k in at]
    order = np.lexsort(columns[::-1])
    lcp = np.full(len(order), window, np.int64)
    lcp[:1] = 0
    for k, w in list(zip(at, columns, strict=True))[::-1]:
        differ = w[order][1:] ^ w[order][:-1]
        some = np.flatnonzero(differ)
        lcp[1 + some] = k + (differ[some].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
    late = order[previous_factors(docs[piece][order], lcp) >= window]
    return piece[late], place[late]


def _settle(window: int):
    def settle(table: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name).combine_chunks()]
        texts, lengths, docs = col("texts", np.uint8), col("lengths", np.uint8), col("docs", np.int64)
        sizes = np.cumsum([0, *(len(x) for x in lengths)])
        piece, place = earlier_copies(np.concatenate(texts), np.concatenate(lengths).astype(np.int64), np.concatenate(docs), window)
        bits = np.zeros(int(sizes[-1]), np.uint64)
        np.bitwise_or.at(bits, piece, np.uint64(1) << place.astype(np.uint64))
        return pa.table({"bucket": table.column("bucket"), "blob": table.column("blob"), "kind": pa.array([1] * len(table), pa.int32()), "answer": X.binary([bits[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:], strict=True)])})

    return settle


def _whole(raw: np.ndarray, gone: np.ndarray) -> str:
    """The kept text, without cutting a character: one of which any byte is kept is kept whole."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    keep = np.logical_or.reduceat(~gone, lead) if len(lead) else np.zeros(0, bool)
    return raw[np.repeat(keep, np.diff(np.append(lead, len(raw))))].tobytes().decode("utf-8", "replace")


def _cut(window: int, buckets: int, texts: bool):
    def cut_(table: pa.Table, told: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            table, ids, raw, offsets = _ordered(table)
            anchors = Anchors(raw, offsets, window)
            _, _, doc, present, cut, code = _distinct(anchors, ids, buckets)
            state = _states(told, present, cut)
        edge = np.zeros(len(raw) + 1, np.int32)
        full = (state[code] == 1) | ((state[code] != 1) & (ids[anchors.row] > doc[code]))
        np.add.at(edge, anchors.start[full], 1)
        np.add.at(edge, anchors.end[full], -1)
        which, _ = _open(anchors, ids, doc, code, state)
        at = np.searchsorted(cut, which, "right") - 1
        bits = np.zeros(len(which), np.uint64)
        for b, kind, x in zip(told.column("bucket").to_pylist(), told.column("kind").to_pylist(), told.column("answer").combine_chunks() if len(told) else [], strict=True):
            if kind == 1:
                bits[at == np.searchsorted(present, b)] = np.frombuffer(x.as_buffer(), np.uint64)
        if len(which):
            slot = np.minimum(np.searchsorted(which, code), len(which) - 1)
            mine = np.flatnonzero((which[slot] == code) & (ids[anchors.row] == doc[code]) & (bits[slot] != 0))
            for k in range(window - GRAM + 1):
                hit = mine[(bits[slot[mine]] >> np.uint64(k)) & np.uint64(1) == 1]
                np.add.at(edge, anchors.start[hit] + k, 1)
                np.add.at(edge, anchors.start[hit] + k + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = {c: [] for c in _RESULTS}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            g, own = gone[a:b], raw[a:b]
            removed = int(g.sum())
            rows["n_bytes"].append(b - a)
            rows["n_removed"].append(removed)
            rows["n_spans"].append(int((g[1:] & ~g[:-1]).sum() + g[0]) if removed else 0)
            rows["kept_sha256"].append(hashlib.sha256(own[~g].tobytes() if removed else own.tobytes()).hexdigest())
            if texts:
                rows["kept_text"].append(_whole(own, g) if removed else own.tobytes().decode("utf-8", "replace"))
        out = table.drop_columns(["_lw_blob", "_lw_id", "_lw_text"])
        for c in _RESULTS if texts else _RESULTS[:-1]:
            out = out.append_column(c, pa.array(rows[c], pa.int64() if c.startswith("n_") else pa.string()))
        return out

    return cut_


def suffix_dedup(docs: DataFrame, window: int = 50, texts: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, if ``texts``, ``kept_text`` added.

    Needs ``doc_id`` (integer) and ``text``; other columns are kept, those named like the new ones are replaced.
    A null text is empty. A null ``doc_id`` counts as later than all others; rows with equal ids remove nothing
    from each other. ``kept_sha256`` is of the exact bytes; ``kept_text`` keeps a character of which any byte is kept.
    A text shorter than ``window`` bytes stays whole. ``window`` is from 40 to 64.
    """
    if not 40 <= window <= 64:
        raise ValueError("window is from 40 to 64 bytes")
    rows = docs.drop(*_RESULTS)
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType() if c.startswith("n_") else StringType()) for c in (_RESULTS if texts else _RESULTS[:-1]))])
    rows = rows.withColumns({"_lw_id": F.col("doc_id").cast("long"), "_lw_text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    rows = X.with_blob(rows, "_lw_id", "_lw_text", name="_lw_blob")
    buckets = X.blob_count(rows)
    asked = rows.groupBy("_lw_blob").applyInArrow(_ask(window, buckets), "bucket int, blob int, keys binary, contexts binary, docs binary")
    told = asked.groupBy("bucket").applyInArrow(_tell, "bucket int, blob int, kind int, answer binary")
    shipped = rows.groupBy("_lw_blob").cogroup(told.groupBy("blob")).applyInArrow(_ship(window, buckets), "bucket int, blob int, texts binary, lengths binary, docs binary")
    settled = shipped.groupBy("bucket").applyInArrow(_settle(window), "bucket int, blob int, kind int, answer binary")
    return rows.groupBy("_lw_blob").cogroup(told.unionByName(settled).groupBy("blob")).applyInArrow(_cut(window, buckets, texts), schema)
