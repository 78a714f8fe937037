"""Budget packing: the one order-sensitive fold that needs state, as a fold over each group's ordered array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions import text as T


def pack_ranges(costs: Column, budget: int, overlap: int = 0) -> Column:
    """Greedy ranges over an array of costs: ``array<struct<first, last, big>>`` (numbers from 0).

    An item over the budget stands alone. When the next item does not fit, the range ends and the next
    one begins with its last ``overlap`` items.
    """
    kind = "array<struct<first:int,last:int,big:boolean>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def emit(acc: Column, big: bool = False) -> Column:
        return F.array(F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"), F.lit(big).alias("big")))

    def step(acc: Column, cost: Column) -> Column:
        i, cost = acc["i"], cost.cast("long")
        held = i > acc["first"]
        flushed = F.when(held, F.concat(acc["out"], emit(acc))).otherwise(acc["out"])
        alone = F.array(F.struct(i.alias("first"), i.alias("last"), F.lit(True).alias("big")))
        over = held & (acc["used"] + cost > budget)
        back = F.greatest(acc["first"], i - overlap)
        carried = F.aggregate(F.slice(costs, back + 1, i - back), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) if overlap else F.lit(0).cast("long")
        none = F.lit(0).cast("long")
        big = F.struct((i + 1).alias("i"), (i + 1).alias("first"), none.alias("used"), F.concat(flushed, alone).alias("out"))
        cut = F.struct((i + 1).alias("i"), back.alias("first"), (carried + cost).alias("used"), F.concat(acc["out"], emit(acc)).alias("out"))
        go = F.struct((i + 1).alias("i"), acc["first"].alias("first"), (acc["used"] + cost).alias("used"), acc["out"].alias("out"))
        return F.when(cost > budget, big).when(over, cut).otherwise(go)

    def finish(acc: Column) -> Column:
        return F.when(acc["i"] > acc["first"], F.concat(acc["out"], emit(acc))).otherwise(acc["out"])

    return F.aggregate(costs, start, step, finish)


def split_pieces(text: Column, budget: int) -> Column:
    """Pieces of a text of ``budget`` tokens at most, cut at sentences; blank pieces go. A sentence over the budget is cut
    into runs of as many characters as always fit."""
    if budget <= 0:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    kind = "struct<out:array<string>,buf:string,cjk:int,rest:int>"
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"), F.lit(0).alias("cjk"), F.lit(0).alias("rest")).cast(kind)
    flush = lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))

    def step(a: Column, s: Column) -> Column:
        cjk = T.cjk_chars(s)
        rest = F.length(s) - cjk
        # a run is one token per character at most, so ``budget`` characters fit; without CJK four times as many do
        run = F.when(cjk > 0, F.lit(max(1, budget))).otherwise(F.lit(max(1, 4 * budget)))
        hard = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / run).cast("int")), lambda k: F.substring(s, k * run + 1, run))
        fits = T.estimate(a["cjk"] + cjk, a["rest"] + rest) <= budget
        return (
            F.when(T.estimate(cjk, rest) > budget, F.struct(F.concat(flush(a), hard).alias("out"), F.lit("").alias("buf"), F.lit(0).alias("cjk"), F.lit(0).alias("rest")).cast(kind))
            .when(fits, F.struct(a["out"].alias("out"), F.concat(a["buf"], s).alias("buf"), (a["cjk"] + cjk).alias("cjk"), (a["rest"] + rest).alias("rest")).cast(kind))
            .otherwise(F.struct(flush(a).alias("out"), s.alias("buf"), cjk.alias("cjk"), rest.alias("rest")).cast(kind))
        )

    pieces = F.filter(F.aggregate(T.sentences(text), zero, step, flush), lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")) != "")
    return F.when(T.count_tokens(text) <= budget, F.filter(F.array(text), lambda p: p != "")).otherwise(pieces)


def greedy_pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: int, overlap: int = 0) -> DataFrame:
    """``keys, chunk, first, last, big, items``: each group's rows by ``order`` in greedy chunks; ``items`` has whole rows."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    group = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_rows"))
    ranges = pack_ranges(F.transform("_rows", lambda r: r[cost]), budget, overlap)
    out = group.select(*keys, "_rows", F.posexplode(ranges).alias("chunk", "_r"))
    return out.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.col("_r.first").cast("long").alias("first"), F.col("_r.last").cast("long").alias("last"), F.col("_r.big").alias("big"), F.expr("slice(_rows, _r.first + 1, _r.last - _r.first + 1)").alias("items"))
