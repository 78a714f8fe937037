"""Questions over blocks: statistics, outline, search, reading, chunks and Markdown, as DataFrame to DataFrame.

``blocks`` has the columns of ``leafwright.plans.corpus.blocks``: book, chapter, title, block, anchor, kind, level, dedup,
text, tokens. Optional columns: page, footnotes (array of struct number, text), grp.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.errors import PatternError
from leafwright.functions import text as T
from leafwright.operators.packing import greedy_pack, split_pieces


def render(kind: Column, level: Column, text: Column, footnotes: Column | None = None) -> Column:
    """A block as Markdown."""
    out = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level + 2)).cast("int")), F.lit(" "), text))
        .when(kind == "quote", F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> ")))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "hr", F.lit("---"))
        .otherwise(text)
    )
    if footnotes is None:
        return out
    notes = F.array_join(F.transform(footnotes, lambda n: F.concat(F.lit("\n[^"), n["number"].cast("string"), F.lit("]: "), n["text"])), "")
    return F.concat(out, F.coalesce(notes, F.lit("")))


def breadcrumb(*parts: Column) -> Column:
    """Parts joined by `` > ``; empty and repeated ones are left out."""
    return F.array_join(F.array_distinct(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != "")), " > ")


def chapters(blocks: DataFrame) -> DataFrame:
    """One row per chapter; characters count the blocks' text that is read, two for each break between."""
    read = ~F.col("dedup") & (F.col("text") != "")
    return blocks.groupBy("book", "chapter").agg(
        F.first("title").alias("title"), F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"),
        (F.coalesce(F.sum(F.when(read, F.length("text"))), F.lit(0)) + F.greatest(F.lit(0), 2 * (F.count_if(read) - 1))).alias("characters"),
    ).withColumn("anchor", T.anchor(F.col("chapter")))


def stats(blocks: DataFrame) -> DataFrame:
    """One row per book."""
    return chapters(blocks).groupBy("book").agg(F.count("*").alias("chapters"), F.sum("n_blocks").alias("blocks"), F.sum("characters").alias("characters"), F.sum("tokens").alias("tokens"))


def find_chapter(chapters_: DataFrame, title: str) -> DataFrame:
    """Chapters of that title in any case; in books without one, those whose title contains it. ``matches`` tells how many per book."""
    low = F.lower("title")
    found = chapters_.where(low.contains(title.lower())).withColumn("exact", low == title.lower())
    best = found.groupBy("book").agg(F.max("exact").alias("best"))
    rows = found.join(best, "book").where("exact = best")
    count = rows.groupBy("book").agg(F.count("*").alias("matches"))
    return rows.join(count, "book").select("book", "chapter", "title", "exact", "matches")


def sections(blocks: DataFrame, depth: int = 2) -> DataFrame:
    """Headings to ``depth`` with the tokens of what follows, up to the next heading of the same level or above.

    The next heading is found among a chapter's headings only, by one array per chapter; totals are differences of
    running sums.
    """
    order = Window.partitionBy("book", "chapter").orderBy("block")
    rows = blocks.withColumns({"upto": F.sum("tokens").over(order), "all": F.sum("tokens").over(Window.partitionBy("book", "chapter"))})
    heads = rows.where("kind = 'heading' AND text <> ''")
    own = heads.where(f"NOT dedup AND level <= {int(depth)}")
    ends = heads.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("block", "level", (F.col("upto") - F.col("tokens")).alias("before")))).alias("h"))
    rows = own.join(ends, ["book", "chapter"])
    stop = F.get(F.filter("h", lambda x: (x["block"] > F.col("block")) & (x["level"] <= F.col("level"))), F.lit(0))["before"]
    return rows.select("book", "chapter", "block", "anchor", F.col("text").alias("title"), "level", (F.coalesce(stop, F.col("all")) - F.col("upto")).alias("tokens"))


def _terms(query: str, mode: str) -> list[str]:
    return [query] if mode == "phrase" else query.split()


def _check_pattern(blocks: DataFrame, pattern: str) -> None:
    """A pattern that can't be read is an error here, before any task runs."""
    try:
        blocks.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise PatternError(f"not a pattern: {pattern!r}") from e


def search(blocks: DataFrame, query: str, mode: str = "phrase", ignore_case: bool = True, chapter: int | None = None, limit: int | None = None) -> DataFrame:
    """Blocks that hold a phrase, all terms or a pattern, with the first ``position``; in order, at most ``limit`` (top-k)."""
    rows = blocks if chapter is None else blocks.where(F.col("chapter") == chapter)
    if not query.strip() or (limit is not None and limit <= 0):
        return rows.where("false").withColumn("position", F.lit(0).cast("long"))
    if mode == "regex":
        _check_pattern(blocks, query)
        pattern = F.lit(("(?iu)" if ignore_case else "") + query)
        rows = rows.where(F.rlike("text", pattern)).withColumn("position", (F.regexp_instr("text", pattern) - 1).cast("long"))
    else:
        hay = F.lower("text") if ignore_case else F.col("text")
        at = [F.instr(hay, t.lower() if ignore_case else t) for t in _terms(query, mode)]
        rows = rows.where(reduce(lambda a, b: a & b, [a > 0 for a in at])).withColumn("position", ((F.least(*at) if len(at) > 1 else at[0]) - 1).cast("long"))
    return rows if limit is None else rows.orderBy("book", "chapter", "block").limit(limit)


def snippet(text: Column, tokens: Column, position: Column, max_tokens: int) -> Column:
    """The text, or a window around ``position`` of about ``max_tokens``, with dots where it is cut."""
    size = F.greatest(F.lit(120), F.floor(F.lit(max_tokens) * F.length(text) / tokens)).cast("int")
    start = F.greatest(F.lit(0), position - F.floor(size / 3)).cast("int")
    cut = F.trim(F.substring(text, start + 1, size))
    marked = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + size < F.length(text), "...").otherwise(""))
    return F.when(tokens <= max_tokens, text).otherwise(marked)


def search_many(blocks: DataFrame, phrases: DataFrame) -> DataFrame:
    """All (block, phrase) pairs where the block contains the phrase; ``phrases`` has item_id and phrase.

    Candidates meet by a key. Of a phrase of three words and more that is its longest inner word (ties: the first), looked up
    among the blocks' distinct words. A phrase of two words may begin and end inside words: its key is what stands on both
    sides of the space, up to three characters each. A phrase of one word may stand anywhere: its key is its first three
    characters, or all it has. Only keys and block numbers are shuffled for that; a block's text is
    fetched for its candidates. Blocks are matched in lower case with white space folded. Empty phrases match nothing.
    """
    fold = lambda c: F.lower(T.collapse(c))
    at = ["book", "chapter", "block"]
    asked = phrases.select("item_id", fold(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    inner = F.split("phrase", " ")
    # only words inside the phrase are whole words of the block
    whole = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    word = F.get(F.array_sort(F.transform(whole, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    left, right = F.least(F.length(F.get(inner, F.lit(0))), F.lit(3)), F.least(F.length(F.get(inner, F.lit(1))), F.lit(3))
    edge = F.concat(F.right(F.get(inner, F.lit(0)), left), F.lit(" "), F.substring(F.get(inner, F.lit(1)), F.lit(1), right))
    kind = F.when(F.size(inner) > 2, "w").when(F.size(inner) == 2, F.concat(F.lit("b"), left.cast("string"), right.cast("string"))).otherwise(F.concat(F.lit("c"), F.least(F.length("phrase"), F.lit(3)).cast("string")))
    asked = asked.withColumn("kind", kind).withColumn("key", F.concat("kind", F.when(F.size(inner) > 2, word).when(F.size(inner) == 2, edge).otherwise(F.substring("phrase", 1, 3))))
    # generators keep the folded text and its words from being worked out again wherever they are used
    rows = blocks.select(*at, F.explode(F.array(fold(F.col("text")))).alias("low"))
    keyed = rows.select(*at, "low", F.explode(F.array(F.split("low", " "))).alias("words")).select(*at, "words", F.explode(F.array(F.split("low", ""))).alias("chars"))
    words, chars, parts = F.col("words"), F.col("chars"), []
    for name in sorted(r["kind"] for r in asked.select("kind").distinct().collect()):  # 13 kinds at most
        tag = F.lit(name)
        if name == "w":
            parts.append(F.transform(words, lambda w: F.concat(tag, w)))  # noqa: B023
        elif name[0] == "b":
            m, n = int(name[1]), int(name[2])
            pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda x, y: F.concat(tag, F.right(x, F.lit(m)), F.lit(" "), F.substring(y, 1, n)))  # noqa: B023
            parts.append(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))
        else:
            n = int(name[1])
            places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(places, lambda k: F.concat(tag, *(F.get(chars, k + i) for i in range(n)))))  # noqa: B023
    if not parts:
        return rows.join(asked, F.lit(False)).select(*at, "item_id")
    found = keyed.select(*at, F.explode(F.array_distinct(F.concat(*parts))).alias("key")).join(asked, "key").select(*at, "item_id", "phrase")
    return found.join(rows, at).where(F.col("low").contains(F.col("phrase"))).select(*at, "item_id")


def read(blocks: DataFrame, budget: int) -> DataFrame:
    """Each chapter read from its start within a budget: anchors, count of blocks, text, tokens, next anchor.

    Blocks go in while the running cost fits. A first block over the budget gives its first piece. The heading
    that repeats the title is passed over.
    """
    rows = blocks.withColumn("piece", render(F.col("kind"), F.col("level"), F.col("text"))).withColumn("cost", F.when(F.col("dedup"), F.lit(0)).otherwise(T.count_tokens(F.col("piece"))))
    order = Window.partitionBy("book", "chapter").orderBy("block")
    rows = rows.withColumns({"run": F.sum("cost").over(order), "n": F.count_if(~F.col("dedup")).over(order)})
    fits = F.col("run") <= budget
    first_big = ~F.col("dedup") & (F.col("n") == 1) & ~fits
    part = F.when(F.col("dedup"), F.lit(None)).when(fits, F.col("piece")).when(first_big, F.get(split_pieces(F.col("piece"), budget), F.lit(0)))
    took = fits | first_big
    out = rows.withColumn("part", part).groupBy("book", "chapter").agg(
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("block", "part")))).alias("parts"),
        F.count_if(took & ~F.col("dedup")).alias("blocks_read"), F.min(F.when(~took, F.col("block"))).alias("next_block"), F.max(first_big).alias("cut"),
        F.max(F.when(took, F.col("block"))).alias("last_block"),
    )
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return out.select(
        "book", "chapter", T.anchor(F.col("chapter"), F.coalesce(F.get("parts", F.lit(0))["block"], F.lit(0).cast("long"))).alias("anchor"), T.anchor(F.col("chapter"), F.coalesce("last_block", F.lit(0).cast("long"))).alias("anchor_end"),
        body.alias("text"), T.count_tokens(body).alias("tokens"), (F.col("next_block").isNotNull() | F.col("cut")).alias("truncated"), "blocks_read", F.col("cut").alias("cut_first"),
        F.when(F.col("next_block").isNotNull(), T.anchor(F.col("chapter"), F.col("next_block"))).alias("next_anchor"),
    )


def next_anchors(blocks: DataFrame) -> DataFrame:
    """For each chapter the first block that can be read in a later chapter of its book."""
    first = blocks.where("NOT dedup AND trim(text) <> ''").groupBy("book", "chapter").agg(F.min("block").alias("block"))
    every = blocks.select("book", "chapter").distinct().join(first, ["book", "chapter"], "left")
    later = Window.partitionBy("book").orderBy("chapter").rowsBetween(1, Window.unboundedFollowing)
    target = F.first(F.when(F.col("block").isNotNull(), T.anchor(F.col("chapter"), F.col("block"))), ignorenulls=True).over(later)
    return every.select("book", "chapter", target.alias("next_anchor"))


def chunks(blocks: DataFrame, max_tokens: int = 800, overlap: int = 0) -> DataFrame:
    """Chunks for retrieval, within chapters: text, anchors, section, breadcrumb and tokens.

    A block costs its rendered tokens and one for the break. A block over the budget gives one chunk per piece. With an
    overlap a chunk begins with the last blocks of the one before it and can be over the budget by these.
    """
    notes = F.col("footnotes") if "footnotes" in blocks.columns else None
    extra = [c for c in ("page", "grp") if c in blocks.columns]
    rows = blocks.where("NOT dedup").withColumn("piece", render(F.col("kind"), F.col("level"), F.col("text"), notes)).where("trim(piece) <> ''")
    rows = rows.withColumn("cost", T.count_tokens(F.col("piece")) + 1).select("book", "chapter", "title", "block", "kind", "text", "piece", "cost", *extra)
    packed = greedy_pack(rows, ["book", "chapter", "title"], ["block"], "cost", max_tokens, overlap)
    body = F.array_join(F.transform("items", lambda r: r["piece"]), "\n\n")
    texts = F.when(F.col("big"), split_pieces(body, max_tokens)).otherwise(F.array(body))
    out = packed.withColumn("section", F.coalesce(F.get(F.filter("items", lambda r: r["kind"] == "heading"), F.lit(0))["text"], F.col("title")))
    pages = F.filter(F.transform("items", lambda r: r["page"]), lambda p: p.isNotNull()) if "page" in extra else None
    more = [F.get(pages, F.lit(0)).alias("page_start"), F.get(pages, F.size(pages) - 1).alias("page_end")] if "page" in extra else []
    group = [F.get("items", F.lit(0))["grp"].alias("grp")] if "grp" in extra else []
    out = out.select("book", "chapter", "title", "chunk", "section", F.get("items", F.lit(0))["block"].alias("b0"), F.element_at("items", -1)["block"].alias("b1"), *more, *group, F.posexplode(texts).alias("piece", "text"))
    # a chunk's number within its chapter, in order of (range, piece)
    order = Window.partitionBy("book", "chapter").orderBy("chunk", "piece")
    trail = [F.col("book"), *([F.col("grp")] if group else []), F.col("title"), F.col("section")]
    return out.select(
        "book", "chapter", (F.row_number().over(order) - 1).cast("long").alias("chunk"), T.anchor(F.col("chapter"), F.col("b0")).alias("anchor"), T.anchor(F.col("chapter"), F.col("b1")).alias("anchor_end"),
        "section", breadcrumb(*trail).alias("breadcrumb"), "text", T.count_tokens(F.col("text")).alias("tokens"), *(["page_start", "page_end"] if more else []),
    )


def markdown(blocks: DataFrame, budget: int | None = None, anchors: bool = False, authors: Column | None = None) -> DataFrame:
    """One Markdown text per book. The budget counts the title and the blocks; the first block that does not fit ends the book,
    with a mark. ``next_chapter`` is the chapter where that happened. ``authors`` (an array) go under the title."""
    notes = F.col("footnotes") if "footnotes" in blocks.columns else None
    rows = blocks.where("NOT dedup AND trim(text) <> ''").withColumn("piece", render(F.col("kind"), F.col("level"), F.col("text"), notes)).withColumn("cost", T.count_tokens(F.col("piece")))
    head = F.concat(F.lit("# "), F.col("book"))
    if authors is not None:
        head = F.when(F.size(authors) > 0, F.concat(head, F.lit("\n\n*"), F.array_join(authors, ", "), F.lit("*"))).otherwise(head)
    order = Window.partitionBy("book").orderBy("chapter", "block")
    rows = rows.withColumn("run", F.sum("cost").over(order) + T.count_tokens(head))
    rows = rows.withColumn("fits", (F.col("run") <= budget) if budget is not None else F.lit(True))
    mark = F.concat(F.lit("<!-- "), F.col("anchor"), F.lit(" -->\n"))
    line = F.concat(mark, F.col("piece")) if anchors else F.col("piece")
    starts = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("block")) == 1
    line = F.when(starts, F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), line)).otherwise(line)
    out = rows.withColumn("line", line).groupBy("book").agg(
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("chapter", "block", "line")))).alias("lines"), F.min(F.when(~F.col("fits"), F.struct("chapter", "block", "anchor"))).alias("stop"),
    )
    text = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), F.when(F.col("stop").isNotNull(), F.concat(F.lit("\n\n<!-- truncated at "), F.col("stop.anchor"), F.lit(" -->"))).otherwise(""))
    return out.select("book", text.alias("text"), F.col("stop").isNotNull().alias("truncated"), F.col("stop.chapter").alias("next_chapter"), F.col("stop.anchor").alias("next_anchor"))


def page(df: DataFrame, keys: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order of ``keys``: the pagination of a result."""
    return df.orderBy(*keys).offset(offset).limit(limit)
