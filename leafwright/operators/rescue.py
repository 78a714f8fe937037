"""Chapters from prose: title lines are found, counted and cut at; long blocks are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators.packing import split_pieces

RESCUE_TOKENS, PART_TOKENS, MIN_MARKERS, MIN_PARTS, BLOCK_TOKENS, RAW_TOKENS = 20_000, 12_000, 3, 3, 800, 1000
_ORDER = "OVER (PARTITION BY book, chapter ORDER BY block)"
_ENDS = "^[\\s\u3000\u00a0]+|[\\s\u3000\u00a0]+$"


def _markers(lines: DataFrame) -> Column:
    """Title lines, and those inside large blocks whose column ``raw`` keeps the lines; a repeated heading (``dedup``) counts nothing."""
    own = T.title_of(F.col("text")).isNotNull()
    n = own.cast("long")
    if "raw" in lines.columns:
        inside = F.size(F.filter(F.split("raw", "\n"), lambda x: T.title_of(x).isNotNull()))
        large = F.col("raw").isNotNull() & (T.count_tokens(F.col("text")) >= RAW_TOKENS)
        n = F.when(own, F.lit(1)).when(large, inside).otherwise(F.lit(0)).cast("long")
    return F.sum(F.when(F.col("dedup"), F.lit(0).cast("long")).otherwise(n) if "dedup" in lines.columns else n)


def _followed(lines: DataFrame) -> DataFrame:
    """``t`` (the title that a line is), ``next`` (text of the next line that is neither blank nor a rule) and ``then`` (of the next not blank) added."""
    filled = F.regexp_replace("text", _ENDS, "") != ""
    rows = lines.withColumn("t", T.title_of(F.col("text"))).withColumns({"_f": F.when(filled, F.col("text")), "_n": F.when(filled & ~T.is_rule(F.col("text")), F.col("text"))})
    return rows.withColumns({"next": F.expr(f"lead(_n) IGNORE NULLS {_ORDER}"), "then": F.expr(f"lead(_f) IGNORE NULLS {_ORDER}")})


def _joined() -> Column:
    return F.concat("t", F.lit(" "), F.regexp_replace("next", _ENDS, ""))


def count_markers(lines: DataFrame) -> DataFrame:
    """``markers``: title lines of each chapter, those inside large raw blocks included."""
    return lines.groupBy("book", "chapter").agg(_markers(lines).alias("markers"))


def predicate(lines: DataFrame, more_than: int = RESCUE_TOKENS, per_part: int = PART_TOKENS, least: int = MIN_MARKERS) -> DataFrame:
    """``rescued``: is the chapter long, with enough title lines, and parts short enough?"""
    out = lines.groupBy("book", "chapter").agg(_markers(lines).alias("markers"), F.sum(T.count_tokens(F.col("text"))).alias("tokens"))
    return out.withColumn("rescued", (F.col("tokens") > more_than) & (F.col("markers") >= least) & (F.col("tokens") / (F.col("markers") + 1) <= per_part))


def cut_at_titles(lines: DataFrame) -> DataFrame:
    """``part, title, body``: each title line opens a part; rule lines go; part 0 is what stands before the first.

    A short title takes in the next line, blank and rule lines aside, if that can go on a title.
    """
    order = Window.partitionBy("book", "chapter").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = _followed(lines).withColumn("part", F.sum(F.col("t").isNotNull().cast("long")).over(order))
    joins = F.coalesce((F.length("t") < T.SHORT_TITLE) & T.continues_title(F.col("next")), F.lit(False))
    rows = rows.withColumn("_j", F.when(F.col("_n").isNotNull(), joins)).withColumn("_taken", F.coalesce(F.expr(f"lag(_j) IGNORE NULLS {_ORDER}"), F.lit(False)) & F.col("_n").isNotNull())
    rows = rows.withColumn("t", F.when(F.col("_j"), _joined()).otherwise(F.col("t")))
    said = F.col("t").isNull() & ~T.is_rule(F.col("text")) & ~F.col("_taken")
    out = rows.groupBy("book", "chapter", "part").agg(F.max("t").alias("title"), F.array_sort(F.collect_list(F.when(said, F.struct("block", "text")))).alias("b"))
    return out.select("book", "chapter", "part", "title", T.collapse(F.array_join(F.transform("b", lambda x: x["text"]), " ")).alias("body"))


def repair_titles(lines: DataFrame, shorter_than: int = T.SHORT_TITLE) -> DataFrame:
    """Title lines; a short one followed by rules and a line that can go on a title is joined with that line."""
    rows = _followed(lines)
    joins = (F.length("t") < shorter_than) & T.is_rule(F.col("then")) & T.continues_title(F.col("next"))
    return rows.where("t IS NOT NULL").withColumn("title", F.when(joins, _joined()).otherwise(F.col("t"))).drop("_f", "_n", "next", "then")


def rebuild(blocks: DataFrame) -> DataFrame:
    """Long chapters cut into ``part``s at the title lines of their prose; ``rescued``, ``part_title`` and ``sub`` (order in a block) added.

    ``blocks`` has book, chapter, title, block (order in the chapter), kind, level, text, tokens, raw, dedup, src_id and footnotes. A
    chapter that is short, has few titles or too long parts, or would come to fewer than ``MIN_PARTS``, stays as it is: part 0 without a
    part_title. A block that is cut loses its id and footnotes, and blank blocks of a rescued chapter go. A short title before
    rules and a line that can go on it takes that line in. Windows of chapters and blocks only, no joins.
    """
    source = F.split(F.when(F.col("raw") != "", F.col("raw")).otherwise(F.col("text")), "\n")
    filled = lambda c: F.regexp_replace(c, _ENDS, "") != ""
    titles = F.size(F.filter("_lines", lambda x: T.title_of(x).isNotNull()))
    own, large = T.title_of(F.col("text")).isNotNull(), (F.col("raw") != "") & (F.col("tokens") >= RAW_TOKENS)
    rows = blocks.withColumn("_lines", source).withColumn("_t", F.when(F.col("dedup"), 0).when(own | large, titles).otherwise(0))
    marks = F.when(F.col("dedup"), 0).when(own, 1).otherwise(F.col("_t"))
    first = F.get(F.filter("_lines", lambda x: filled(x) & ~T.is_rule(x)), F.lit(0))
    led = F.when(filled(F.col("text")), F.struct("block", ((F.col("_t") == 0) | T.title_of(first).isNull()).cast("int").alias("led")))
    chapter = Window.partitionBy("book", "chapter")
    rows = rows.withColumns({"_marks": F.sum(marks).over(chapter), "_titles": F.sum("_t").over(chapter), "_all": F.sum("tokens").over(chapter), "_led": F.min(led).over(chapter)["led"]})
    enough = (F.col("_all") > RESCUE_TOKENS) & (F.col("_marks") >= MIN_MARKERS) & (F.col("_all") / (F.col("_marks") + 1) <= PART_TOKENS) & (F.col("_titles") + F.col("_led") >= MIN_PARTS)
    rows = rows.withColumn("rescued", F.coalesce(enough, F.lit(False))).drop("_marks", "_titles", "_all", "_led")
    rest = rows.where("NOT rescued").withColumns({"part": F.lit(0).cast("long"), "part_title": F.lit(None).cast("string"), "sub": F.lit(0).cast("long")}).drop("_lines", "_t")
    return rest.unionByName(_cut_blocks(rows.where("rescued"), [*blocks.columns, "rescued"]).select(*rest.columns))


def _cut_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The blocks of rescued chapters as pieces with part and part_title; ``_lines`` are a block's lines, ``_t`` how many are titles."""
    key = ["book", "chapter", "block"]
    lines = rows.withColumn("_lines", F.when(F.col("_t") > 0, F.col("_lines")).otherwise(F.array("text"))).drop("text", "raw")
    lines = lines.select("*", F.posexplode("_lines").alias("_l", "_line")).drop("_lines")
    # a title takes in lines of its own block only
    order = "OVER (PARTITION BY book, chapter, block ORDER BY _l)"
    real = (F.regexp_replace("_line", _ENDS, "") != "") & ~T.is_rule(F.col("_line"))
    lines = lines.withColumns({"t": F.when(F.col("_t") > 0, T.title_of(F.col("_line"))), "_n": F.when(real, F.col("_line"))}).withColumn("next", F.expr(f"lead(_n) IGNORE NULLS {order}"))
    lines = lines.withColumn("_j", F.when(F.col("_n").isNotNull(), F.coalesce((F.length("t") < T.SHORT_TITLE) & T.continues_title(F.col("next")), F.lit(False))))
    lines = lines.withColumns({"_taken": F.coalesce(F.expr(f"lag(_j) IGNORE NULLS {order}"), F.lit(False)) & F.col("_n").isNotNull(), "_p": F.expr(f"count(t) {order}"), "t": F.when(F.col("_j"), _joined()).otherwise(F.col("t"))})
    said = (F.col("_t") == 0) | (F.col("t").isNull() & ~T.is_rule(F.col("_line")) & ~F.col("_taken"))
    keep = [c for c in columns if c not in (*key, "text", "raw")]
    per = lines.groupBy(*key, "_p").agg(F.max("t").alias("t"), F.max("_t").alias("_t"), F.array_sort(F.collect_list(F.when(said, F.struct("_l", "_line")))).alias("b"), *(F.first(c).alias(c) for c in keep))
    body = F.array_join(F.transform("b", lambda x: x["_line"]), " ")
    cut, none = F.col("_t") > 0, F.lit(None).cast("string")
    piece = lambda sub, title, kind, text: F.struct(sub.alias("sub"), title.alias("cut"), kind.alias("kind"), text.alias("text"))
    both = F.array(piece(2 * F.col("_p"), F.col("t"), F.lit("heading"), F.col("t")), piece(2 * F.col("_p") + 1, none, F.when(cut, "para").otherwise(F.col("kind")), F.when(cut, T.collapse(body)).otherwise(body)))
    kinds = {c: f.dataType for c, f in ((c, rows.schema[c]) for c in ("level", "footnotes"))}
    out = per.withColumn("p", F.explode(both)).withColumns({"sub": F.col("p.sub"), "cut": F.col("p.cut"), "kind": F.col("p.kind"), "text": F.col("p.text"), "raw": F.lit("")}).where(F.regexp_replace("text", _ENDS, "") != "")
    out = out.withColumns({"level": F.when(cut & (F.col("kind") == "heading"), 2).when(cut, 0).otherwise(F.col("level")).cast(kinds["level"]), "src_id": F.when(~cut, F.col("src_id")).otherwise(""), "footnotes": F.when(~cut, F.col("footnotes")).otherwise(F.array().cast(kinds["footnotes"]))})
    out = out.withColumn("part", F.count("cut").over(Window.partitionBy("book", "chapter").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("book", "chapter", "part")
    order = whole.orderBy("block", "sub")
    out = out.withColumns({"_n": F.row_number().over(order), "_head": F.first("kind").over(order) == "heading", "part_title": F.coalesce(F.max("cut").over(whole), F.col("title"))})
    out = out.withColumn("_o", F.min(F.when((F.col("_n") > 1) & ~T.is_rule(F.col("text")), F.struct("_n", "text"))).over(whole))
    joins = F.coalesce(F.col("_head") & (F.length("part_title") < T.SHORT_TITLE) & (F.col("_o._n") > 2) & T.continues_title(F.col("_o.text")), F.lit(False))
    out = out.withColumn("_j", joins).where("NOT _j OR _n = 1 OR _n > _o._n")
    out = out.withColumn("part_title", F.when(F.col("_j"), F.concat("part_title", F.lit(" "), F.regexp_replace("_o.text", _ENDS, ""))).otherwise(F.col("part_title")))
    out = out.withColumn("text", F.when(F.col("_j") & (F.col("_n") == 1), F.col("part_title")).otherwise(F.col("text")))
    return out.withColumn("tokens", T.count_tokens(F.col("text")))


def split_blocks(blocks: DataFrame, max_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks over the budget as pieces; a footnote goes with the first piece that holds its mark, else with the last."""
    long_ = (F.col("kind") != "heading") & (F.col("tokens") > max_tokens)
    rows = blocks.withColumn("_p", F.when(long_, split_pieces(F.col("text"), max_tokens)).otherwise(F.array("text")))
    rows = rows.select("*", F.posexplode("_p").alias("piece", "_t"))

    def home(n):
        mark = F.concat(F.lit("[^"), n["number"].cast("string"), F.lit("]"))
        at = F.array_position(F.transform("_p", lambda p: p.contains(mark)), True)
        return F.when(at > 0, at - 1).otherwise(F.size("_p") - 1)

    notes = F.filter("footnotes", lambda n: home(n) == F.col("piece"))
    return rows.withColumns({"footnotes": notes, "text": F.col("_t"), "tokens": T.count_tokens(F.col("_t")), "piece": F.col("piece").cast("long")}).drop("_p", "_t")
