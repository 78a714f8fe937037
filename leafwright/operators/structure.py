"""Structure of books from relations: tables of contents, starts, cuts, notes, pages. Joins and windows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes and types that mark a note's body.
STRONG_NOTES = ("footnote", "footnotes", "endnote", "endnotes", "rearnote", "rearnotes", "notebody", "note-body")
WEAK_NOTES = ("fn", "note", "notes", "annotation", "comment")
NOTE_TYPES = ("footnote", "endnote", "rearnote", "footnotes", "endnotes", "note")


def chapter_at(chapters: DataFrame, index: int) -> DataFrame:
    """The chapter at a position of each book; a negative one counts from the end. A book that is too short has no row."""
    order = Window.partitionBy("book").orderBy(F.desc("chapter") if index < 0 else F.asc("chapter"))
    return chapters.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == (-index if index < 0 else index + 1)).drop("_n")


def forward_fill(rows: DataFrame, keys: Sequence[str], order: str, label: str, into: str) -> DataFrame:
    """The last label at or before each row."""
    return rows.withColumn(into, F.last(label, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def number_notes(refs: DataFrame) -> DataFrame:
    """``number``: notes are numbered through each book by their first reference."""
    firsts = refs.groupBy("book", "target").agg(F.min(F.struct("chapter", "block")).alias("at"))
    numbers = firsts.withColumn("number", F.rank().over(Window.partitionBy("book").orderBy("at")).cast("long")).drop("at")
    return refs.join(numbers, ["book", "target"]).select("book", "chapter", "block", "target", "number")


def resolve_notes(refs: DataFrame, strong: DataFrame, weak: DataFrame, key: str) -> DataFrame:
    """``note``: the text of the strong definition, else of the weak one, else empty. Definitions have ``key`` and ``text``."""
    out = refs.join(strong.withColumnRenamed("text", "_strong"), key, "left").join(weak.withColumnRenamed("text", "_weak"), key, "left")
    return out.withColumn("note", F.coalesce("_strong", "_weak", F.lit(""))).drop("_strong", "_weak")


def suppress(rows: DataFrame, noted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are not inside a note's body."""
    return rows.join(noted, list(keys), "left_anti")


def note_kind(epub_type: Column, classes: Column) -> Column:
    """``strong``, ``weak`` or empty, by an element's type and classes."""
    kind = F.lower(F.coalesce(epub_type, F.lit("")))
    low = F.lower(F.coalesce(classes, F.lit("")))
    tokens = F.array_union(F.split(low, "[\\s\\-_]+"), F.split(low, "\\s+"))
    typed = F.lit(False)
    for t in NOTE_TYPES:
        typed = typed | kind.contains(t)
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return F.when(kind.contains("noteref"), "").when(typed | has(STRONG_NOTES), "strong").when(has(WEAK_NOTES), "weak").otherwise("")


def first_positions(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(position).alias(position))


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, into: str) -> DataFrame:
    """Numbers segments: each row with ``start`` opens the next; rows before the first are in segment 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(F.col(start).cast("long")).over(w))


def heading_starts(blocks: DataFrame) -> DataFrame:
    """Each document's headings of its shallowest level, if that is 1 or 2."""
    heads = blocks.where("kind = 'heading'").withColumn("_low", F.min("level").over(Window.partitionBy("book", "chapter")))
    return heads.where("level = _low AND _low <= 2").drop("_low")


def choose_toc(toc: DataFrame) -> DataFrame:
    """Per book the source of its table of contents: the one with more entries, ``nav`` on a tie."""
    n = toc.groupBy("book").agg(F.count_if(F.col("src") == "nav").alias("nav"), F.count_if(F.col("src") == "ncx").alias("ncx"))
    return n.select("book", F.when((F.col("nav") >= F.col("ncx")) & (F.col("nav") > 0), "nav").when(F.col("ncx") > 0, "ncx").otherwise("").alias("src"))


def toc_ancestors(toc: DataFrame) -> DataFrame:
    """``ancestors`` (titles) and ``parent`` (path, fragment) of each entry, by a stack over the depths in order.

    The stack is a fold over one array per book: tables of contents are small whatever the corpus.
    """
    entry = "struct<depth:bigint,title:string,path:string,fragment:string>"
    kind = f"struct<stack:array<{entry}>,out:array<struct<ord:bigint,ancestors:array<string>,parent:{entry}>>>"
    group = toc.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", "depth", "title", "path", "fragment"))).alias("e"))
    zero = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast(f"array<struct<ord:bigint,ancestors:array<string>,parent:{entry}>>").alias("out")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        above = F.filter(a["stack"], lambda s: s["depth"] < x["depth"])
        row = F.struct(x["ord"].alias("ord"), F.transform(above, lambda s: s["title"]).alias("ancestors"), F.get(above, F.size(above) - 1).alias("parent"))
        own = F.struct(x["depth"].alias("depth"), x["title"].alias("title"), x["path"].alias("path"), x["fragment"].alias("fragment"))
        return F.struct(F.concat(above, F.array(own)).alias("stack"), F.concat(a["out"], F.array(row)).alias("out")).cast(kind)

    out = group.select("book", F.explode(F.aggregate("e", zero, step)["out"]).alias("r")).select("book", "r.ord", "r.ancestors", "r.parent")
    return toc.join(out, ["book", "ord"])


def chapter_starts(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Entries where chapters begin: on a spine document, of the least depth or in another file than their parent, each place once."""
    own = toc.join(spine.select("book", "path").distinct(), ["book", "path"], "left_semi")
    own = own.withColumn("_low", F.min("depth").over(Window.partitionBy("book")))
    own = own.where((F.col("depth") == F.col("_low")) | ~F.col("path").eqNullSafe(F.col("parent.path")))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("book", "path", "fragment").orderBy("ord"))).where("_n = 1").drop("_n", "_low")


def resolve_cuts(starts: DataFrame, ids: DataFrame, keys: Sequence[str], id_: str, position: str, order: str) -> DataFrame:
    """Where in its document (``keys``) each start is: at 0 without a fragment, else at its fragment's block.

    A start whose fragment is unknown goes, but for a document's first one where no start of it is known: that is at 0. Of several
    starts at one place the first by ``order`` stays.
    """
    known = starts.join(ids.select(*keys, id_, position), [*keys, id_], "left").withColumn("_hit", (F.col(id_) == "") | F.col(position).isNotNull())
    known = known.withColumns({"_any": F.max("_hit").over(Window.partitionBy(*keys)), "_n": F.row_number().over(Window.partitionBy(*keys).orderBy(order))})
    known = known.where("_hit OR (NOT _any AND _n = 1)").withColumn(position, F.coalesce(position, F.lit(0).cast("long")))
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, position).orderBy(order))).where("_n = 1").drop("_n", "_hit", "_any")


def toc_sections(toc: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Deeper entries with a fragment as sections, at the first block with that path and id, where no heading section is.

    Columns as of ``query.sections``, with level 0. The tokens are those from the section's own block up to the chapter's next heading
    with a text that does not repeat the title. Of several entries at one block the first by ``ord`` stays.
    """
    chapter = Window.partitionBy("book", "chapter")
    after = chapter.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    head = (F.col("kind") == "heading") & ~F.col("dedup") & (F.col("text") != "")
    rows = blocks.withColumns({"_before": F.sum("tokens").over(chapter.orderBy("block")) - F.col("tokens"), "_all": F.sum("tokens").over(chapter)})
    rows = rows.withColumn("_n", F.coalesce(F.last(F.when(head, F.col("_before")), ignorenulls=True).over(after), F.col("_all")) - F.col("_before"))
    place = rows.where("src_id <> ''").groupBy("book", "src_path", "src_id").agg(F.min(F.struct("chapter", "block", "anchor", "_n")).alias("at"))
    deep = toc.where("fragment <> '' AND depth > 0").withColumnsRenamed({"path": "src_path", "fragment": "src_id"})
    found = deep.join(place, ["book", "src_path", "src_id"]).groupBy("book", "at").agg(F.min_by("title", "ord").alias("title"))
    found = found.select("book", "at.chapter", "at.block", "at.anchor", "title", F.lit(0).cast("long").alias("level"), F.col("at._n").alias("tokens"))
    return found.join(sections.select("book", "anchor"), ["book", "anchor"], "left_anti").select("book", "chapter", "block", "anchor", "title", "level", "tokens")


def dedupe_warnings(rows: DataFrame, most: int = 40) -> DataFrame:
    """Each book's distinct messages in order of first appearance, the first ``most`` of them."""
    firsts = rows.groupBy("book", "message").agg(F.min("ord").alias("ord"))
    return firsts.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
