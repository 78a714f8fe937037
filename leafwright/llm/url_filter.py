"""URL filter: host and path rules first, then a ratio of two character language models.

Rules decide the urls that they fit. Those urls also are the examples: one smoothed Markov model of
variable order is counted from the allowed ones and one from the blocked ones, and a url that no rule
fits is judged by the difference of its two log-likelihoods per character against a calibrated limit.

A context is kept if it was seen ``min_context`` times; a character is scored in the longest context that
is kept, with additive smoothing. Counting is a plain aggregation over all examples, and the kept grams stay a table
with their keys. A character's score hangs on itself and the ``ORDER`` characters before it, so each distinct window of
that length is looked up once, and the urls are joined to the windows.
Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X

ORDER, MIN_CONTEXT, BETA, SYMBOLS, SCALE = 4, 20, 0.2, 64, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(rest after ``://``, host, path); all empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return rest, F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (verdict, name) that fits, or null. A name is a host and a path prefix, like ``com/en/``."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules fit into an expression")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name in sorted(rules, key=lambda r: (len(r[1]), r)):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name).alias("rule"))).otherwise(out)
    return out


def _text(rest: Column) -> Column:
    """What the models read: the url without its scheme, lower-cased, with marks before it and one behind."""
    return F.concat(F.lit("^" * ORDER), F.translate(rest, _UPPER, _LOWER), F.lit("$"))


def fit(examples: DataFrame, min_context: int = MIN_CONTEXT) -> DataFrame:
    """``key, lr``: the log ratio of the two models in thousandths, from rows ``s`` (marked text) and ``good`` (boolean).

    A key is ``g`` and a gram of a kept context, or ``c`` and a kept context, for characters that it has not seen.
    """
    at = F.sequence(F.lit(ORDER + 1), F.length("s"))
    grams = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda n: F.col("s").substr(i - n, n + 1))))
    seen = examples.select("good", F.explode(grams).alias("gram"))
    seen = seen.groupBy("gram").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
    seen = seen.withColumn("ctx", F.expr("substr(gram, 1, length(gram) - 1)"))
    ctx = seen.groupBy("ctx").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).where(F.col("na") + F.col("nb") >= min_context)
    all_ = F.lit(BETA * SYMBOLS)
    floor = ctx.select(F.concat(F.lit("c"), "ctx").alias("key"), F.log((F.col("nb") + all_) / (F.col("na") + all_)).alias("lr"))
    known = seen.join(ctx, "ctx").select(F.concat(F.lit("g"), "gram").alias("key"), (F.log((F.col("a") + BETA) / (F.col("na") + all_)) - F.log((F.col("b") + BETA) / (F.col("nb") + all_))).alias("lr"))
    return known.unionByName(floor).select("key", F.round(F.col("lr") * SCALE).cast("int").alias("lr"))


def ratios(texts: DataFrame, model: DataFrame) -> DataFrame:
    """``s, ratio`` of distinct marked texts ``s``: log-likelihood ratio per character, above 0 where the accepted model fits better."""
    at = F.sequence(F.lit(ORDER + 1), F.length("s"))
    windows = texts.select("s", F.explode(F.transform(at, lambda i: F.col("s").substr(i - ORDER, F.lit(ORDER + 1)))).alias("w"))
    keys = []
    for n in range(ORDER, -1, -1):
        keys += [F.concat(F.lit("g"), F.substring("w", ORDER + 1 - n, n + 1)), F.concat(F.lit("c"), F.substring("w", ORDER + 1 - n, n))]
    asked = windows.select("w").distinct().select("w", F.posexplode(F.array(*keys)).alias("rank", "key"))
    values = asked.join(model, "key").groupBy("w").agg(F.min_by("lr", "rank").alias("lr"))
    total = windows.join(values, "w", "left").groupBy("s").agg(F.sum(F.coalesce("lr", F.lit(0))).alias("total"))
    return total.select("s", (F.col("total") / F.lit(float(SCALE)) / (F.length("s") - ORDER)).alias("ratio"))


def limit(scored: DataFrame) -> float:
    """The limit on ``ratio`` with the best mean of the two classes' hit rates, from rows ``ratio`` and ``good``."""
    bins = scored.groupBy(F.greatest(F.lit(-200), F.least(F.lit(200), F.floor(F.col("ratio") * 100))).alias("bin")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
    rows = sorted((r["bin"], r["a"], r["b"]) for r in bins.collect())  # 401 rows at most
    a, b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not a or not b:
        return 0.0
    best, at, good, bad = -1.0, 0.0, a, 0
    for k, x, y in rows:
        if (score := good / a + bad / b) > best + 1e-12:
            best, at = score, k / 100
        good, bad = good - x, bad + y
    return at


def judge(pages: DataFrame, rules: Sequence[Rule], folds: int = 5) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, ratio`` added; needs a column ``url``.

    One fold in ``folds`` of the example urls (by crc32) sets the limit, the rest train the models.
    A null url, or one without ``://``, has an empty host and path and is judged as an empty text.
    Without examples of both kinds the ratio is compared with 0, and a tie is allowed. Rows, order aside, and
    other columns stay as they are; columns named like the new ones are replaced.
    """
    rest, host, path = url_parts(F.col("url"))
    fit_ = rule_of(host, path, rules)
    urls = pages.select(_text(rest).alias("s"), fit_.getField("verdict").alias("v")).where("v IS NOT NULL")
    urls = urls.select("s", (F.col("v") == "allow").alias("good"), (F.crc32("s") % folds == 0).alias("test"))
    model = fit(urls.where("NOT test"))
    scored = X.settle(ratios(pages.select(_text(rest).alias("s")).distinct(), model))
    at = limit(urls.where("test").join(scored, "s").select("good", "ratio"))
    out = pages.withColumn("_lw_s", _text(rest)).withColumns({"_lw_host": host, "_lw_path": path, "_lw_rule": fit_})
    out = out.join(scored.withColumnsRenamed({"s": "_lw_s", "ratio": "_lw_ratio"}), "_lw_s", "left")
    named = {"host": F.col("_lw_host"), "path": F.col("_lw_path"), "rule": F.col("_lw_rule.rule"), "ratio": F.col("_lw_ratio"), "verdict": F.coalesce("_lw_rule.verdict", F.when(F.col("_lw_ratio") >= at, "allow").otherwise("block"))}
    return out.withColumns(named).drop("_lw_s", "_lw_host", "_lw_path", "_lw_rule", "_lw_ratio")
