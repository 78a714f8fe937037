"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors get one coordinate more that makes all norms equal, so the largest inner product is the smallest angle. Learned
rotations (iterative quantisation, several from different starts) turn each into a code of ``BITS`` bits. A
block of rows indexes each substring of its codes; by the pigeonhole principle a code within radius r of a query
differs by at most r // m in one of its m substrings, so probing the buckets within that distance, and
counting bits of what they hold, finds every code within r. All of these are scored exactly.

The radius is calibrated on a bounded sample: nearly all true neighbours of the sample's queries
(``HIT_SHARE``) lie within it. Where a radius is so wide that the probes would visit a block's rows more often than
once each, the block counts the bits of all its codes instead, which finds the same set.

The rotations and the radius are fitted on ``FIT_ROWS`` rows at most; every row is indexed.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X

BITS, SUBSTRING, FIT_ROWS, HIT_SHARE = 256, 16, 8_000, 0.985
BLOCK_ROWS, PACK, GROUP = 1 << 14, 2048, 64


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that can take part: no null, NaN or infinite component, not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).where(F.exists("embedding", lambda x: x != 0))


class Coder:
    """Rotations, the largest norm and the radius."""

    def __init__(self, sample: np.ndarray, largest: float, k: int, bits: int = BITS, seed: int = 7) -> None:
        self.largest = largest
        rng = np.random.default_rng(seed)
        z = self.lift(sample)
        d = z.shape[1]
        _, axes = np.linalg.eigh(z.T @ z)
        p = z @ axes
        turns = []
        for _ in range(-(-bits // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(12):
                u, _, vt = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
                r = (u @ vt).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, 1)[:, :bits]
        self.radius = self._radius(sample, k)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        z = np.column_stack([x, np.zeros(len(x))]) if query else self.lift(x)
        flags = np.concatenate([z[i : i + 4096] @ self.turn > 0 for i in range(0, len(z), 4096)]) if len(z) else np.zeros((0, self.turn.shape[1]), bool)
        return np.packbits(flags, axis=1).view(np.uint64)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        q = sample[: min(1000, len(sample))]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return self.turn.shape[1]
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        a, b = self.codes(q, query=True), self.codes(sample)
        apart = np.bitwise_count(a[:, None, :] ^ b[best]).sum(2)
        return int(np.quantile(apart, HIT_SHARE, method="higher"))


def _masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)], np.int64)


class MultiIndex:
    """Buckets of each substring of a block's codes."""

    def __init__(self, codes: np.ndarray, substring: int = SUBSTRING) -> None:
        self.codes, self.width = codes, substring
        self.parts = codes.view(np.uint16 if substring == 16 else np.uint8).astype(np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _build(self) -> None:
        self.tables = []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << self.width) + 1))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes at most ``radius`` bits from ``query``, in order."""
        m = self.parts.shape[1]
        most = min(radius // m, self.width)
        visited = m * sum(comb(self.width, n) for n in range(most + 1)) / (1 << self.width)
        if visited > 1:
            apart = np.bitwise_count(self.codes[:, 0] ^ query[0]).astype(np.uint16)
            for w in range(1, self.codes.shape[1]):
                apart += np.bitwise_count(self.codes[:, w] ^ query[w])
            return np.flatnonzero(apart <= radius)
        if self.tables is None:
            self._build()
        masks, found = _masks(self.width, most), []
        own = query.view(np.uint16 if self.width == 16 else np.uint8).astype(np.int64)
        for (order, bound), value in zip(self.tables, own, strict=True):
            lo, hi = bound[value ^ masks], bound[(value ^ masks) + 1]
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            found.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        rows = np.unique(np.concatenate(found))
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(1) <= radius]


def search_block(ids: np.ndarray, vectors: np.ndarray, coder: Coder, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """The block's ``k`` best rows for each query, out of all within the radius (widened while there are too few)."""
    index, asked = MultiIndex(coder.codes(vectors)), coder.codes(queries, query=True)
    out_q, out_v, out_s = [], [], []
    bits = coder.turn.shape[1]
    for q, x, code in zip(query_ids, queries, asked, strict=True):
        radius = coder.radius
        while True:
            rows = index.within(code, radius)
            rows = rows[ids[rows] != q]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + 8)
        score = (vectors[rows] * x).sum(1)
        best = np.lexsort((ids[rows], -score))[:k]
        out_q.append(np.full(len(best), q))
        out_v.append(ids[rows][best])
        out_s.append(score[best])
    return out_q, out_v, out_s


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    column = table.column("embedding").combine_chunks()
    return ids, column.flatten().to_numpy().reshape(len(ids), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of largest inner product, ties to the smaller ``vec_id``.

    Both tables need ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null, empty or zero, or
    hold a null, NaN or infinity, take no part, nor do rows without an id, nor vectors of another length
    than most have. A row with the query's own ``vec_id`` is never its neighbour. Equal rows are
    rows of their own as candidates; an id that is asked more than once is answered once, for its smallest vector.
    With fewer than ``k`` candidates all are returned, and an empty table gives no rows.
    """
    rows = valid(vectors)
    shape = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    none = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], none)
    d, n = shape["d"], shape["n"]
    rows = rows.where(F.size("embedding") == d)
    asked = valid(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    coder = Coder(_packed(sample)[1], float(np.sqrt(shape["m"])), k)
    del sample
    cast = vectors.sparkSession.sparkContext.broadcast(coder)  # d + 1 by BITS numbers
    n_asked = asked.count()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], none)
    blocks, packs = -(-n // BLOCK_ROWS), -(-n_asked // PACK)
    groups = -(-packs // GROUP)

    def pack(table: pa.Table) -> pa.Table:
        ids, x = _packed(table)
        return pa.table({"pack": table.column("pack")[:1], "ids": X.binary([ids.tobytes()]), "vectors": X.binary([x.tobytes()])})

    packed = asked.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int")).groupBy("pack").applyInArrow(pack, "pack int, ids binary, vectors binary")
    sent = packed.withColumn("grp", F.pmod("pack", F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))
    held = held.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(block: pa.Table, packs_: pa.Table) -> pa.Table:
        q, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(block) and len(packs_):
            ids, x = _packed(block)
            for i, raw in zip(packs_.column("ids").combine_chunks(), packs_.column("vectors").combine_chunks(), strict=True):
                own = np.frombuffer(i.as_buffer(), np.int64)
                a, b, c = search_block(ids, x, cast.value, own, np.frombuffer(raw.as_buffer(), np.float64).reshape(len(own), -1), k)
                q, v, s = q + a, v + b, s + c
        return pa.table({"query_id": pa.array(np.concatenate(q)), "vec_id": pa.array(np.concatenate(v)), "score": pa.array(np.concatenate(s))})

    found = held.groupBy("block", "grp").cogroup(sent.groupBy("block", "grp")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
