"""N-gram Jaccard join: every pair of texts whose sets of word shingles overlap by 80 per cent.

1. Census. Each blob of documents sends every hash bucket its distinct shingle hashes (24 to 32 bits within the
   bucket); the bucket answers one bit per hash: held elsewhere too, or not. A text with a partner must
   have at least 80 per cent of its shingles elsewhere, so all other texts are done here. False
   "held elsewhere" bits only cost time.
2. Prefixes. In an order of all shingles that puts those held once first, two linked texts share one
   of their first ``n - ceil(0.8 n) + 1`` shingles. Sets that share one, within a band of sizes, join a family.
3. Tiles. Families are sorted by set size and cut into tiles; pairs of tiles whose size bands can link
   are compared: hashed bitmaps give, by the count of bits that one has and the other lacks, an upper
   bound on the overlap; what passes is intersected exactly as sorted arrays. A tile returns only
   a spanning forest of its links, so large groups of copies never turn into pairs.
4. Components of the forest.

Sets equal to each other are one node from the start, so exact copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textcode as T

BITMAP_MIN, BITMAP_MAX, TILE = 256, 4096, 2048
_SETS = "blob int, doc_id long, text_key long, n long, node long, unseen int, shingles binary"


def _blob_sets(table: pa.Table, k: int) -> tuple[list, list[np.ndarray], np.ndarray, pa.ChunkedArray]:
    ids = table.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    table = table.take(pa.array(order, pa.int64()))
    with np.errstate(over="ignore"):
        sets = T.shingle_sets(*T.buffers(table.column("text")), k)
        nodes = np.array([T.digest64(s) if len(s) else 0 for s in sets], np.uint64)
    return table.column("doc_id").to_pylist(), sets, nodes, table.column("text_key")


def _census(sets: list[np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a blob, and whether two different sets of it hold them."""
    _, first = np.unique(nodes, return_index=True)
    some = [sets[i] for i in first if len(sets[i])]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, count = np.unique(np.concatenate(some), return_counts=True)
    return keys, count > 1


def _ask(k: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        blob = table.column("blob")[0].as_py()
        keys, _ = _census(*_blob_sets(table, k)[1:3])
        keys, present, cut = X.sorted_by_bucket(keys, buckets)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        parts = [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"bucket": pa.array(present.astype(np.int32)), "blob": pa.array([blob] * len(parts), pa.int32()), "keys": X.binary(parts)})

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """For each blob one bit per key it sent: does another blob hold the key?"""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys").combine_chunks()]
    whole = np.concatenate(parts)
    ranked = np.sort(whole)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    out = []
    for p in parts:
        at = np.minimum(np.searchsorted(again, p), max(len(again) - 1, 0))
        out.append(np.packbits(again[at] == p if len(again) else np.zeros(len(p), bool)).tobytes())
    return pa.table({"bucket": table.column("bucket"), "blob": table.column("blob"), "bits": X.binary(out)})


def _keep(k: int, buckets: int, percent: int):
    def keep(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, sets, nodes, keys_ = _blob_sets(table, k)
        keys, local = _census(sets, nodes)
        arranged, present, cut = X.sorted_by_bucket(keys, buckets)
        bits = dict(zip(told.column("bucket").to_pylist(), told.column("bits").combine_chunks(), strict=True)) if len(told) else {}
        held = np.zeros(len(keys), bool)
        for b, lo, hi in zip(present.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            held[lo:hi] = np.unpackbits(np.frombuffer(bits[b].as_buffer(), np.uint8), count=hi - lo)
        order = np.argsort(arranged)
        held = held[order] | local
        done, unseen, arrays = set(), [], []
        for s, node in zip(sets, nodes.tolist(), strict=True):
            n = len(s)
            again = held[np.searchsorted(keys, s)] if n else held[:0]
            alone = n - int(again.sum())
            need = -(-percent * n // 100)
            if not n or n - alone < need or node in done:
                unseen.append(None)
                arrays.append(None)
                continue
            done.add(node)
            unseen.append(alone)
            arrays.append(np.concatenate([s[~again], s[again]]).tobytes())
        blob = table.column("blob")[0].as_py()
        return pa.table({"blob": pa.array([blob] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "text_key": keys_, "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes.view(np.int64)), "unseen": pa.array(unseen, pa.int32()), "shingles": X.binary(arrays)})

    return keep


def _prefixes(percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for n, node, alone, raw in zip(batch["n"].to_pylist(), batch["node"].to_pylist(), batch["unseen"].to_pylist(), batch["shingles"], strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)[alone : n - -(-percent * n // 100) + 1]
                keys.append(s)
                nodes.append(np.full(len(s), node, np.int64))
                sizes.append(np.full(len(s), n, np.int64))
            if not keys:
                continue
            keys, nodes, sizes = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
            order, present, cut = X.deal(keys, buckets)
            pack = lambda a: X.binary([a[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pack(keys), pack(nodes), pack(sizes.astype(np.uint32))], ["bucket", "keys", "nodes", "sizes"])

    return run


def _families(percent: int):
    def run(table: pa.Table) -> pa.Table:
        col = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name).combine_chunks()])
        keys, nodes, sizes = col("keys", np.uint64), col("nodes", np.int64), col("sizes", np.uint32).astype(np.int64)
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        breaks = np.ones(len(keys), bool)
        breaks[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        first = np.maximum.accumulate(np.where(breaks, np.arange(len(keys)), 0))
        u, v = nodes, nodes[first]
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)])[:, u != v], axis=1)
        return pa.table({"u": pa.array(pairs[0]), "v": pa.array(pairs[1])})

    return run


def _bitmaps(arrays: list[np.ndarray]) -> np.ndarray:
    longest = max(len(a) for a in arrays)
    bits = min(max(BITMAP_MIN, 1 << int(2 * longest - 1).bit_length()), BITMAP_MAX)
    out = np.zeros((len(arrays), bits // 8), np.uint8)
    flags = np.zeros(bits, np.uint8)
    for i, a in enumerate(arrays):
        flags[:] = 0
        flags[(a % np.uint64(bits)).astype(np.int64)] = 1
        out[i] = np.packbits(flags)
    return out.view(np.uint64)


def link_tile(arrays: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets in ``left`` and in ``right``, both by growing size."""
    parent = list(range(len(arrays)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    size = np.array([len(a) for a in arrays], np.int64)
    maps = _bitmaps(arrays) if len(arrays) > 2 else None
    label = np.arange(len(arrays))
    for i in left.tolist():
        hi = int(np.searchsorted(size[right], 100 * size[i] // percent, "right"))
        lo = int(np.searchsorted(size[right], -(-percent * size[i] // 100), "left"))
        js = right[lo:hi]
        js = js[(js != i) & (label[js] != label[i])]
        if maps is not None and len(js):
            # each bit of i that j lacks is a shingle of i at least that j lacks
            over = np.minimum(size[i] - np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64), size[js] - np.bitwise_count(~maps[i] & maps[js]).sum(1, dtype=np.int64))
            js = js[100 * over >= percent * (size[i] + size[js] - over)]
        for j in js.tolist():
            if root(i) == root(j):
                continue
            a, b = (arrays[i], arrays[j]) if size[i] <= size[j] else (arrays[j], arrays[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[at] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                out.append((i, j))
                x, y = root(i), root(j)
                parent[x] = y
                label[label == label[i]] = label[j]
    return out


def _tiles(percent: int):
    def run(table: pa.Table) -> pa.Table:
        pair = np.array(table.column("pair").to_pylist())
        side, n, node = (table.column(c).to_numpy() for c in ("side", "n", "node"))
        raws = table.column("shingles").combine_chunks()
        us, vs = [], []
        order = np.lexsort((node, n, pair))
        cuts = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[lo:hi]
            arrays = [np.sort(np.frombuffer(raws[int(i)].as_buffer(), np.uint64)) for i in own]
            left, right = np.flatnonzero(side[own] <= 0), np.flatnonzero(side[own] >= 0)
            for i, j in link_tile(arrays, left, right, percent):
                us.append(int(node[own[i]]))
                vs.append(int(node[own[j]]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, text_key`` (xxhash64 of the text).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+``
    with A-Z lower-cased. A null, empty or blank text has an empty set and links with nothing, so it
    is its own component. Rows with a null ``doc_id`` are kept; they take part, but name no component.
    Repeated rows come back as often as they came. ``component_id`` is the smallest ``doc_id`` reachable;
    ``class_id`` tells components apart even where ids are null or repeated (0: an empty set).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = X.with_blob(rows.withColumn("text_key", F.xxhash64("text")), "doc_id", "text_key")
    buckets = X.blob_count(rows)
    asked = rows.groupBy("blob").applyInArrow(_ask(k, buckets), "bucket int, blob int, keys binary")
    told = asked.groupBy("bucket").applyInArrow(_tell, "bucket int, blob int, bits binary")
    sets = X.settle(rows.groupBy("blob").cogroup(told.groupBy("blob")).applyInArrow(_keep(k, buckets, percent), _SETS))
    some = sets.where("shingles IS NOT NULL")
    sent = some.select("n", "node", "unseen", "shingles").mapInArrow(_prefixes(percent, buckets), "bucket int, keys binary, nodes binary, sizes binary")
    families = X.components(sent.groupBy("bucket").applyInArrow(_families(percent), "u long, v long"))
    # a family's members and its root with their sizes, and for each set one blob that has its array
    sizes = some.groupBy("node").agg(F.min("n").alias("n"), F.min("blob").alias("blob"))
    members = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct()).join(sizes, "node")
    ranked = members.selectExpr("node", "blob", "root", "n", f"cast(floor((row_number() OVER (PARTITION BY root ORDER BY n, node) - 1) / {int(tile)}) AS long) AS tile")
    ranked = X.settle(ranked)
    bands = ranked.groupBy("root", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = bands.alias("a"), bands.alias("b")
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.tile") <= F.col("b.tile")) & (F.lit(percent) * F.col("b.lo") <= 100 * F.col("a.hi"))).select(F.col("a.root").alias("root"), F.col("a.tile").alias("i"), F.col("b.tile").alias("j"))
    ends = pairs.where("i = j").select("root", F.col("i").alias("tile"), F.lit(0).alias("side"), F.concat_ws("-", "root", "i", "j").alias("pair"))
    ends = ends.unionByName(pairs.where("i < j").select("root", F.explode(F.array(F.struct(F.col("i").alias("tile"), F.lit(-1).alias("side")), F.struct(F.col("j").alias("tile"), F.lit(1).alias("side")))).alias("e"), F.concat_ws("-", "root", "i", "j").alias("pair")).select("root", "e.tile", "e.side", "pair"))
    routed = ranked.join(ends, ["root", "tile"]).select("node", "blob", "pair", "side")
    arrays = some.select("node", "blob", "n", "shingles")
    work = routed.join(arrays, ["node", "blob"]).withColumn("slot", F.pmod(F.xxhash64("pair"), F.lit(4 * buckets)).cast("int"))
    forest = work.groupBy("slot").applyInArrow(_tiles(percent), "u long, v long")
    linked = X.components(forest)
    named = sets.select("doc_id", "text_key", "n", "node").join(linked, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "text_key", F.coalesce("root", F.lit(0)).alias("class_id"))
