"""Chat formatting: turns become marked text in windows of a token budget, with a loss mask.

A turn is written ``<s>role[INST]text[/INST]</s>``. A control string inside a role or a text gets one
backslash after its first character, and one more if it has some already there, so it can't be taken for
a mark and comes back exactly.

Windows are spans of whole turns. Prefix sums of turn tokens choose them: with half the room as stride,
the stride in which a turn starts is its span, and a turn longer than a stride is a span of its own; so
no span is over its room unless a single turn is. Each window starts with the conversation's system
turn (its first one), goes on with up to ``history`` earlier turns of ``history_tokens`` at most, then its own turns.
Assistant texts among its own turns are under the loss mask; repeated ones aren't.

Turns are dealt by conversation and block of 1024 turn numbers. A block hands on a row of sums, its first turns' tokens and the
system turn, and from these and its neighbours in its block each turn knows which windows it belongs to; so the texts are
shuffled once by block and once by window, nothing is joined but the block rows, and a conversation
of any length is never sorted in one task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
BLOCK_BITS = 10
_NO_TURN = -(1 << 62)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAILS})", "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """An estimate in whole tokens: four for the marks and one for each three characters begun."""
    return (F.ceil(F.length(text) / 3) + 4).cast("long")


def _placed(turns: DataFrame, history: int) -> DataFrame:
    """Adds ``idx`` (0, 1, ... in order of turn, role, text), ``before`` (tokens of the turns before it), ``prior`` (tokens of the
    turn before), ``following`` (of the next ``history`` turns) and ``lead`` (the conversation's system turn)."""
    rows = turns.withColumns({"_key": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_nul": F.col("conv_id").isNull(), "_block": F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(_NO_TURN))})
    keys = ["_key", "_nul", "_block"]
    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({
        "_rn": F.row_number().over(order) - 1, "_run": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
        "_prior": F.lag("tokens").over(order), "_next": F.collect_list("tokens").over(order.rowsBetween(1, max(history, 1))),
    })
    first = F.col("_rn") == 0
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max_by("tokens", "_rn").alias("last"), F.min_by(F.concat(F.array("tokens"), F.slice("_next", 1, max(history - 1, 0)) if history > 1 else F.array().cast("array<bigint>")), "_rn").alias("head"),
        F.max(F.when(first & (F.col("role") == "system"), F.struct("role", "text"))).alias("lead"),
    )
    along = Window.partitionBy("_key", "_nul").orderBy("_block")
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<bigint>")
    # each block has a turn at least, so the next ``history`` blocks' heads are enough
    ahead = F.concat(*(F.coalesce(F.lead("head", k).over(along), none) for k in range(1, max(history, 1) + 1)))
    sums = sums.select(*keys, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_n"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("_t"), F.lag("last").over(along).alias("_last"), ahead.alias("_ahead"), F.first("lead").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"))
    rows = rows.join(sums, keys)
    return rows.select(
        "conv_id", "role", "text", "tokens", "lead", (F.col("_n") + F.col("_rn")).cast("long").alias("idx"), (F.col("_t") + F.col("_run")).cast("long").alias("before"),
        F.coalesce("_prior", "_last").alias("prior"), F.slice(F.concat("_next", "_ahead"), 1, history).alias("following") if history else none.alias("following"),
    )


def windows(conversations: DataFrame, budget: int = 2048, history: int = 4, history_tokens: int = 256, system_tokens: int = 256) -> DataFrame:
    """One row per window: ``conv_id, span, formatted, turns``; ``span`` rises along a conversation.

    ``turns`` lists the window's turns in order: ``idx``, ``own`` (false if repeated), ``loss`` (under the mask),
    and where role and text stand in ``formatted`` (``role_at, role_len, text_at, text_len``, code points from 0).
    A null role or text counts as empty. Turns go by turn number (null first), then role and text, so equal rows
    stay apart and come in a fixed order. Other columns are ignored, whatever their names. A null ``conv_id`` is a
    conversation too. Empty input gives no rows. ``history_tokens`` and ``system_tokens`` are set aside of the budget; a longer
    system turn, or a turn longer than the budget, makes a longer window, as nothing is cut.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _placed(rows.withColumn("tokens", turn_tokens(F.col("text"))), history)
    stride = max(1, (budget - history_tokens - system_tokens) // 2)

    def span(before: Column, tokens: Column) -> Column:
        """The stride that a turn starts in; a long turn is alone, and as it is longer than a stride, what stands before it and behind it never shares a span."""
        return F.when(tokens > stride, 2 * before + 1).otherwise(2 * (before - F.pmod(before, F.lit(stride))))

    system = (F.col("idx") == 0) & (F.col("role") == "system")
    own, before = span(F.col("before"), F.col("tokens")), F.col("before")
    rows = rows.withColumn("span", own).withColumn("opens", (F.col("idx") == 0) | (span(before - F.col("prior"), F.col("prior")) != F.col("span")))
    homes = [F.struct("span", F.lit("own").alias("as_")), F.when(F.col("opens") & (F.col("idx") > 0) & F.col("lead").isNotNull(), F.struct("span", F.lit("lead").alias("as_")))]
    last, at = F.col("span"), before + F.col("tokens")
    for k in range(history):  # a window that one of the next turns opens repeats this turn
        tokens = F.get("following", F.lit(k))
        here = span(at, tokens)
        homes.append(F.when(tokens.isNotNull() & (here != last) & (at - before <= history_tokens) & ~system, F.struct(here.alias("span"), F.lit("old").alias("as_"))))
        last, at = here, at + tokens
    every = rows.select("conv_id", "idx", "role", "text", "lead", system.alias("system"), F.explode(F.filter(F.array(*homes), lambda x: x.isNotNull())).alias("home"))
    lead, mine = F.col("home.as_") == "lead", F.col("home.as_") == "own"
    every = every.select("conv_id", "home.span", mine.alias("own"), (F.col("system") | lead).alias("system"), F.when(lead, 0).otherwise(F.col("idx")).alias("idx"), F.when(lead, F.col("lead.role")).otherwise(F.col("role")).alias("role"), F.when(lead, F.col("lead.text")).otherwise(F.col("text")).alias("text"))
    part = F.struct("own", (F.col("own") | ~F.col("system")).alias("late"), "idx", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("own") & (F.col("role") == "assistant")).alias("loss"))
    packed = every.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    piece = lambda p: F.concat(F.lit("<s>"), p["role"], F.lit("[INST]"), p["text"], F.lit("[/INST]</s>"))
    out = packed.withColumn("formatted", F.array_join(F.transform("parts", piece), ""))
    none = F.array().cast("array<struct<idx:bigint,own:boolean,loss:boolean,role_at:int,role_len:int,text_at:int,text_len:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("turns"))

    def step(acc: Column, p: Column) -> Column:
        role_at = acc["at"] + 3
        text_at = role_at + F.length(p["role"]) + 6
        turn = F.struct(p["idx"].alias("idx"), p["own"].alias("own"), p["loss"].alias("loss"), role_at.alias("role_at"), F.length(p["role"]).alias("role_len"), text_at.alias("text_at"), F.length(p["text"]).alias("text_len"))
        return F.struct((text_at + F.length(p["text"]) + 11).alias("at"), F.concat(acc["turns"], F.array(turn)).alias("turns"))

    turns = F.aggregate("parts", start, step)["turns"]
    return out.select("conv_id", "span", "formatted", turns.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with their own turns read from the marks in ``formatted`` alone: ``conv_id, span, chars, read``.

    ``read`` lists ``idx, role, text, loss`` in order, unescaped. Control strings inside texts are escaped, so the next mark
    of a kind is the end of a part.
    """
    shape = F.lit(r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>")
    said = F.arrays_zip(F.col("turns").alias("turn"), F.regexp_extract_all("formatted", shape, F.lit(1)).alias("role"), F.regexp_extract_all("formatted", shape, F.lit(2)).alias("text"))
    own = F.filter("said", lambda x: x["turn"]["own"])
    read = F.transform(own, lambda x: F.struct(x["turn"]["idx"].alias("idx"), unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text"), x["turn"]["loss"].alias("loss")))
    return formatted.select("conv_id", "span", F.length("formatted").alias("chars"), said.alias("said")).select("conv_id", "span", "chars", read.alias("read"))


def digests(conversations: DataFrame, **limits: int) -> DataFrame:
    """Per conversation what the formatted windows hold, read back from them, as digests.

    One digest of a conversation needs its texts in one row, so unlike ``windows`` this is for conversations of up to 2 GB.
    """
    done = read_back(windows(conversations, **limits)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "read"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    done = done.withColumn("t", F.flatten(F.transform("w", lambda x: x["read"])))
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["text"]), "")
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
