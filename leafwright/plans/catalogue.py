"""Registry of the named queries over the driver's tables, each with its SQL oracle.

Integers are cast to BIGINT on both sides and texts are compared whole or as MD5 digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import packing, query, rescue, structure
from leafwright.plans.corpus import BLOCKS_SQL, blocks, table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, blocks_first: bool = True):
    """Registers a function under its name, with its SQL; the relation ``blocks`` is put before it."""

    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH RECURSIVE {BLOCKS_SQL}\n{sql}" if blocks_first else sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(_docs(spark, d))


_CJK = r"[\x{1100}-\x{11ff}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"


def _tokens_sql(x: str) -> str:
    rest = f"length(regexp_replace({x}, '{_CJK}', '', 'g'))"
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, floor(length({x}) - {rest} + {rest} / 4.0 + 0.5)) END AS BIGINT)"


# ---- tokens -----------------------------------------------------------------


@_query(f"SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents", False)
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@_query(f"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '{_CJK}', '', 'g')) AS BIGINT) AS cjk, CAST(length(regexp_replace(text, '{_CJK}', '', 'g')) AS BIGINT) AS rest FROM documents", False)
def char_counts(spark: SparkSession, d: str) -> DataFrame:
    cjk = T.cjk_chars(F.col("text"))
    return _docs(spark, d).select("doc_id", cjk.cast("long").alias("cjk"), (F.length("text") - cjk).cast("long").alias("rest"))


_SENT = r"regexp_extract_all(text, '[^。！？!?；;…\n]*[。！？!?；;…\n]|[^。！？!?；;…\n]+')"


@_query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest, array_to_string(s, '') = text AS lossless FROM (SELECT doc_id, text, {_SENT} AS s FROM documents)", False)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"), (F.array_join("s", "") == F.col("text")).alias("lossless"))


@_query(
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS BIGINT) AS piece, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (
  WITH RECURSIVE s AS (
    SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_SENT} AS x FROM documents WHERE {_tokens_sql('text')} > 120)
  ), c AS (
    SELECT doc_id, s, i, length(s) - length(regexp_replace(s, '{_CJK}', '', 'g')) AS cjk, length(regexp_replace(s, '{_CJK}', '', 'g')) AS rest FROM s
  ), e AS (SELECT *, floor(cjk + rest / 4.0 + 0.5) > 120 AS big FROM c),
  f AS (
    SELECT doc_id, i, 1 AS piece, big, cjk, rest FROM e WHERE i = 1
    UNION ALL
    SELECT e.doc_id, e.i, CASE WHEN e.big OR f.big OR floor(f.cjk + e.cjk + (f.rest + e.rest) / 4.0 + 0.5) > 120 THEN f.piece + 1 ELSE f.piece END, e.big,
      CASE WHEN e.big OR f.big OR floor(f.cjk + e.cjk + (f.rest + e.rest) / 4.0 + 0.5) > 120 THEN e.cjk ELSE f.cjk + e.cjk END,
      CASE WHEN e.big OR f.big OR floor(f.cjk + e.cjk + (f.rest + e.rest) / 4.0 + 0.5) > 120 THEN e.rest ELSE f.rest + e.rest END
    FROM f JOIN e ON e.doc_id = f.doc_id AND e.i = f.i + 1
  ), p AS (
    SELECT f.doc_id, f.piece, bool_or(f.big) AS big, string_agg(e.s, '' ORDER BY e.i) AS t FROM f JOIN e USING (doc_id, i) GROUP BY ALL
  )
  SELECT doc_id, piece * 100000 AS piece, t FROM p WHERE NOT big
  UNION ALL
  SELECT doc_id, piece * 100000 + k, substr(t, k * w + 1, w) FROM (
    SELECT doc_id, piece, t, CASE WHEN length(t) > length(regexp_replace(t, '{_CJK}', '', 'g')) THEN 120 ELSE 480 END AS w, unnest(range(0, (length(t) - 1) // w + 1)) AS k FROM p WHERE big)
  UNION ALL
  SELECT doc_id, 0, text FROM documents WHERE {_tokens_sql('text')} <= 120
) WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''""",
    False,
)
def split_long_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(packing.split_pieces(F.col("text"), 120)).alias("piece", "t"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


# ---- blocks and anchors -----------------------------------------------------


@_query("SELECT book, chapter, block, kind, level, dedup, tokens, md5(text) AS digest FROM blocks")
def block_extract_lines(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("book", "chapter", "block", "kind", "level", "dedup", "tokens", F.md5("text").alias("digest"))


@_query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n\f\v\x{00a0}\x{3000}]+', ' ', 'g'))) AS digest FROM documents", False)
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@_query("SELECT book, chapter, block, anchor FROM blocks")
def anchors_assign(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("book", "chapter", "block", "anchor")


@_query("SELECT anchor, CAST(regexp_extract(anchor, '^c([0-9]+)', 1) AS BIGINT) AS chapter, CAST(regexp_extract(anchor, 'p([0-9]+)$', 1) AS BIGINT) AS block FROM blocks")
def anchor_parse(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("anchor", T.parse_anchor(F.upper("anchor")).alias("a")).select("anchor", "a.chapter", "a.block")


_CHAPTERS = """chapters AS (
  SELECT book, chapter, any_value(title) AS title, 'c' || chapter AS anchor, count(*) AS n_blocks, CAST(sum(tokens) AS BIGINT) AS tokens,
    CAST(coalesce(sum(length(text)) FILTER (NOT dedup), 0) + greatest(0, 2 * (count(*) FILTER (NOT dedup) - 1)) AS BIGINT) AS characters
  FROM blocks GROUP BY book, chapter)"""


@_query(f", {_CHAPTERS} SELECT book, count(*) AS chapters, CAST(sum(n_blocks) AS BIGINT) AS blocks, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(tokens) AS BIGINT) AS tokens FROM chapters GROUP BY book")
def book_stats(spark: SparkSession, d: str) -> DataFrame:
    return query.stats(_blocks(spark, d))


@_query(f", {_CHAPTERS} SELECT book, chapter, title FROM chapters QUALIFY row_number() OVER (PARTITION BY book ORDER BY chapter DESC) = 2")
def chapter_at(spark: SparkSession, d: str) -> DataFrame:
    return structure.chapter_at(query.chapters(_blocks(spark, d)), -2).select("book", "chapter", "title")


_FIND = """ SELECT book, chapter, title, exact, CAST(count(*) OVER (PARTITION BY book) AS BIGINT) AS matches FROM (
  SELECT book, chapter, title, lower(title) = '{0}' AS exact, max(lower(title) = '{0}') OVER (PARTITION BY book) AS best FROM chapters WHERE contains(lower(title), '{0}')) WHERE exact = best"""


@_query(f", {_CHAPTERS}" + _FIND.format("the and attion to thanedble the, anea. eriner thanea."))
def find_chapter_exact(spark: SparkSession, d: str) -> DataFrame:
    return query.find_chapter(query.chapters(_blocks(spark, d)), "The and attion to thanedble the, anea. Eriner thanea.")


@_query(f", {_CHAPTERS}" + _FIND.format("eriner"))
def find_chapter_substring(spark: SparkSession, d: str) -> DataFrame:
    return query.find_chapter(query.chapters(_blocks(spark, d)), "Eriner")


@_query(f", {_CHAPTERS} SELECT book, chapter, anchor, title, n_blocks, tokens FROM chapters")
def outline_chapters(spark: SparkSession, d: str) -> DataFrame:
    return query.chapters(_blocks(spark, d)).select("book", "chapter", "anchor", "title", "n_blocks", "tokens")


@_query(
    """, h AS (SELECT * FROM blocks WHERE kind = 'heading' AND text <> '')
SELECT a.book, a.chapter, a.block, a.anchor, a.text AS title, a.level,
  CAST(coalesce((SELECT sum(b.tokens) FROM blocks b WHERE b.chapter = a.chapter AND b.block > a.block AND b.block < coalesce((SELECT min(n.block) FROM h n WHERE n.chapter = a.chapter AND n.block > a.block AND n.level <= a.level), 1000000000)), 0) AS BIGINT) AS tokens
FROM h a WHERE NOT a.dedup AND a.level <= 2"""
)
def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    return query.sections(_blocks(spark, d), 2)


# ---- search -----------------------------------------------------------------

_HIT = ["book", "chapter", "block", "anchor", "position"]


@_query(" SELECT book, chapter, block, anchor, CAST(instr(lower(text), 'of the') - 1 AS BIGINT) AS position FROM blocks WHERE contains(lower(text), 'of the')")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return query.search(_blocks(spark, d), "of the").select(*_HIT)


@_query(" SELECT book, chapter, block, anchor, CAST(instr(lower(text), 'of the') - 1 AS BIGINT) AS position FROM blocks WHERE contains(lower(text), 'of the') ORDER BY book, chapter, block LIMIT 20")
def search_first_hits(spark: SparkSession, d: str) -> DataFrame:
    return query.search(_blocks(spark, d), "Of The", limit=20).select(*_HIT)


@_query(" SELECT book, chapter, block, anchor, CAST(least(instr(lower(text), 'the'), instr(lower(text), 'tion')) - 1 AS BIGINT) AS position FROM blocks WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return query.search(_blocks(spark, d), "tion the", "all_terms").select(*_HIT)


@_query(r" SELECT book, chapter, block, anchor, CAST(instr(text, regexp_extract(text, '(?i)th[a-z]+tion[,.]')) - 1 AS BIGINT) AS position FROM blocks WHERE regexp_matches(text, '(?i)th[a-z]+tion[,.]')")
def search_regex(spark: SparkSession, d: str) -> DataFrame:
    return query.search(_blocks(spark, d), r"th[a-z]+tion[,.]", "regex").select(*_HIT)


@_query(" SELECT book, chapter, block, anchor, CAST(instr(lower(text), 'a') - 1 AS BIGINT) AS position FROM blocks WHERE contains(lower(text), 'a') AND chapter = 7")
def search_chapter_filter(spark: SparkSession, d: str) -> DataFrame:
    return query.search(_blocks(spark, d), "a", chapter=7).select(*_HIT)


@_query(
    """, hits AS (SELECT *, instr(lower(text), 'tion') - 1 AS position FROM blocks WHERE contains(lower(text), 'tion')), w AS (
  SELECT *, greatest(120, CAST(floor(40 * length(text) / tokens) AS BIGINT)) AS size FROM hits
), s AS (SELECT *, greatest(0, position - size // 3) AS st FROM w)
SELECT chapter, block, CASE WHEN tokens <= 40 THEN text ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || trim(substr(text, st + 1, size)) || (CASE WHEN st + size < length(text) THEN '...' ELSE '' END) END AS snippet FROM s"""
)
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    hits = query.search(_blocks(spark, d), "tion")
    return hits.select("chapter", "block", query.snippet(F.col("text"), F.col("tokens"), F.col("position"), 40).alias("snippet"))


@_query(
    r""", l AS (SELECT item_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r\n\f\v\x{00a0}\x{3000}]+', ' ', 'g')) AS line FROM benchmark),
p AS (SELECT DISTINCT item_id, lower(line) AS phrase FROM l)
SELECT book, chapter, block, item_id, count(*) AS n FROM blocks JOIN p ON phrase <> '' AND contains(lower(blocks.text), phrase) GROUP BY ALL"""
)
def search_multi(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every benchmark text over all blocks."""
    lines = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    phrases = lines.select("item_id", F.lower(T.collapse(F.col("line"))).alias("phrase")).distinct()
    return query.search_many(_blocks(spark, d), phrases).groupBy("book", "chapter", "block", "item_id").agg(F.count("*").alias("n"))


# ---- reading, chunks, Markdown ----------------------------------------------

_PIECE = "CASE WHEN kind = 'heading' THEN repeat('#', CAST(least(6, greatest(1, level + 2)) AS INT)) || ' ' || text ELSE text END"
_READ = f""", r AS (
  SELECT *, CASE WHEN dedup THEN 0 ELSE {_tokens_sql('piece')} END AS cost FROM (SELECT *, {_PIECE} AS piece FROM blocks)
), c AS (
  SELECT *, sum(cost) OVER (PARTITION BY chapter ORDER BY block) AS run, count(*) FILTER (NOT dedup) OVER (PARTITION BY chapter ORDER BY block) AS n FROM r
), f AS (SELECT *, run <= @BUDGET AS fits, NOT dedup AND n = 1 AND run > @BUDGET AS big FROM c)
SELECT book, chapter, count(*) FILTER ((fits OR big) AND NOT dedup) AS blocks_read, max(big) OR min(CASE WHEN fits OR big THEN NULL ELSE block END) IS NOT NULL AS truncated,
  'c' || chapter || 'p' || min(CASE WHEN fits OR big THEN NULL ELSE block END) AS next_anchor@MORE FROM f GROUP BY book, chapter"""


@_query(_READ.replace("@BUDGET", "200").replace("@MORE", ", md5(coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY block) FILTER (fits AND NOT dedup), '')) AS digest") + " HAVING NOT max(big)")
def read_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = query.read(_blocks(spark, d), 200)
    # chapters whose first block alone is over the budget are in read_budget_all
    return rows.where("NOT cut_first").select("book", "chapter", "blocks_read", "truncated", "next_anchor", F.md5("text").alias("digest"))


@_query()
def read_budget_all(spark: SparkSession, d: str) -> DataFrame:
    return query.read(_blocks(spark, d), 200).select("book", "chapter", "blocks_read", "truncated", "cut_first", "next_anchor", F.md5("text").alias("digest"))


@_query(_READ.replace("@BUDGET", "20").replace("@MORE", ""))
def read_truncated_first(spark: SparkSession, d: str) -> DataFrame:
    return query.read(_blocks(spark, d), 20).select("book", "chapter", "blocks_read", "truncated", "next_anchor")


@_query(
    """, f AS (SELECT book, chapter, min(block) FILTER (NOT dedup) AS block FROM blocks GROUP BY book, chapter)
SELECT book, chapter, (SELECT 'c' || min_by(g.chapter, g.chapter) || 'p' || min_by(g.block, g.chapter) FROM f g WHERE g.book = f.book AND g.chapter > f.chapter AND g.block IS NOT NULL) AS next_anchor FROM f"""
)
def next_anchor(spark: SparkSession, d: str) -> DataFrame:
    return query.next_anchors(_blocks(spark, d))


def _chunk_sql(budget: int, overlap: int, tail: str) -> str:
    new = f"e.big OR f.big OR (e.upto - f.base > {budget} AND e.i > f.start)"
    return f""", r AS (SELECT *, {_PIECE} AS piece FROM blocks WHERE NOT dedup),
b AS (SELECT *, {_tokens_sql('piece')} + 1 AS cost, row_number() OVER (PARTITION BY chapter ORDER BY block) AS i FROM r),
e AS (SELECT *, cost > {budget} AS big, sum(cost) OVER (PARTITION BY chapter ORDER BY i) AS upto FROM b),
f AS (
  SELECT chapter, i, 0 AS chunk, big, i AS start, CAST(0 AS HUGEINT) AS base FROM e WHERE i = 1
  UNION ALL
  SELECT e.chapter, e.i, CASE WHEN {new} THEN f.chunk + 1 ELSE f.chunk END, e.big,
    CASE WHEN e.big OR f.big THEN e.i WHEN {new} THEN greatest(f.start, e.i - {overlap}) ELSE f.start END,
    CASE WHEN e.big OR f.big THEN e.upto - e.cost WHEN {new} THEN (SELECT x.upto - x.cost FROM e x WHERE x.chapter = e.chapter AND x.i = greatest(f.start, e.i - {overlap})) ELSE f.base END
  FROM f JOIN e ON e.chapter = f.chapter AND e.i = f.i + 1
), g AS (SELECT chapter, chunk, min(start) AS first, max(i) AS last, bool_or(big) AS big FROM f GROUP BY chapter, chunk)
{tail}"""


_CHUNK_TAIL = """SELECT g.chapter, CAST(g.chunk AS BIGINT) AS chunk, 'c' || g.chapter || 'p' || min(e.block) AS anchor, 'c' || g.chapter || 'p' || max(e.block) AS anchor_end, g.big, CAST(sum(e.cost) AS BIGINT) AS cost, md5(string_agg(e.piece, chr(10) || chr(10) ORDER BY e.i)) AS digest
FROM g JOIN e ON e.chapter = g.chapter AND e.i BETWEEN g.first AND g.last GROUP BY g.chapter, g.chunk, g.big"""


def _packed(spark: SparkSession, d: str, budget: int, overlap: int) -> DataFrame:
    rows = _blocks(spark, d).where("NOT dedup").withColumn("piece", query.render(F.col("kind"), F.col("level"), F.col("text"))).withColumn("cost", T.count_tokens(F.col("piece")) + 1)
    out = packing.greedy_pack(rows.select("chapter", "block", "piece", "cost"), ["chapter"], ["block"], "cost", budget, overlap)
    return out.select(
        "chapter", "chunk", T.anchor(F.col("chapter"), F.get("items", F.lit(0))["block"]).alias("anchor"), T.anchor(F.col("chapter"), F.element_at("items", -1)["block"]).alias("anchor_end"), "big",
        F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["cost"]).alias("cost"), F.md5(F.array_join(F.transform("items", lambda x: x["piece"]), "\n\n")).alias("digest"),
    )


@_query(_chunk_sql(200, 0, _CHUNK_TAIL))
def chunks_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, 200, 0)


@_query(_chunk_sql(200, 2, _CHUNK_TAIL))
def chunks_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, 200, 2)


@_query(_chunk_sql(200, 0, "SELECT chapter, CAST(chunk AS BIGINT) AS chunk, CAST(last - first + 1 AS BIGINT) AS n FROM g ORDER BY 1, 2 LIMIT 10 OFFSET 30"))
def chunks_page(spark: SparkSession, d: str) -> DataFrame:
    rows = packing.greedy_pack(_blocks(spark, d).where("NOT dedup").select("chapter", "block", (T.count_tokens(query.render(F.col("kind"), F.col("level"), F.col("text"))) + 1).alias("cost")), ["chapter"], ["block"], "cost", 200)
    return query.page(rows.select("chapter", "chunk", F.size("items").cast("long").alias("n")), ["chapter", "chunk"], 30, 10)


@_query()
def chunks_full(spark: SparkSession, d: str) -> DataFrame:
    return query.chunks(_blocks(spark, d), 800)


_MD = f""", r AS (SELECT *, {_PIECE} AS piece FROM blocks WHERE NOT dedup),
c AS (SELECT *, sum({_tokens_sql('piece')}) OVER (PARTITION BY book ORDER BY chapter, block) + {_tokens_sql("'# ' || book")} AS run, row_number() OVER (PARTITION BY chapter ORDER BY block) = 1 AS head FROM r),
f AS (SELECT *, run <= 4000 AS fits FROM c)
SELECT book, min(chapter) FILTER (NOT fits) AS next_chapter, min_by(anchor, (chapter, block)) FILTER (NOT fits) AS next_anchor, bool_or(NOT fits) AS truncated,
  md5('# ' || book || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN head THEN '## ' || title || chr(10) || chr(10) ELSE '' END || piece, chr(10) || chr(10) ORDER BY chapter, block) FILTER (fits), '')
    || CASE WHEN bool_or(NOT fits) THEN chr(10) || chr(10) || '<!-- truncated at ' || (min_by(anchor, (chapter, block)) FILTER (NOT fits)) || ' -->' ELSE '' END) AS digest FROM f GROUP BY book"""


@_query(_MD)
def markdown_budget(spark: SparkSession, d: str) -> DataFrame:
    return query.markdown(_blocks(spark, d), 4000).select("book", "next_chapter", "next_anchor", "truncated", F.md5("text").alias("digest"))


@_query(f" SELECT anchor, md5({_PIECE}) AS digest FROM blocks")
def render_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("anchor", F.md5(query.render(F.col("kind"), F.col("level"), F.col("text"))).alias("digest"))


@_query(" SELECT anchor, book || ' > ' || title || CASE WHEN kind = 'heading' AND text <> title AND text <> book THEN ' > ' || text ELSE '' END AS crumb FROM blocks")
def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("anchor", query.breadcrumb(F.col("book"), F.col("title"), F.when(F.col("kind") == "heading", F.col("text"))).alias("crumb"))


# ---- structure --------------------------------------------------------------


@_query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations", False)
def page_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("label", F.when(F.col("role") == "user", F.col("turn")))
    return structure.forward_fill(rows, ["conv_id"], "turn", "label", "page").select("conv_id", "turn", "page")


_REFS = """, refs AS (SELECT book, chapter, block, regexp_extract(text, '^([^ ]+)', 1) AS target FROM blocks WHERE kind = 'para')"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("kind = 'para'").select("book", "chapter", "block", F.regexp_extract("text", "^([^ ]+)", 1).alias("target"))


@_query(_REFS + """, firsts AS (SELECT book, target, min((chapter, block)) AS first_at FROM refs GROUP BY ALL), n AS (SELECT book, target, CAST(rank() OVER (PARTITION BY book ORDER BY first_at) AS BIGINT) AS number FROM firsts)
SELECT book, chapter, block, target, number FROM refs JOIN n USING (book, target)""")
def footnote_number(spark: SparkSession, d: str) -> DataFrame:
    return structure.number_notes(_refs(spark, d))


@_query(_REFS + """, defs AS (SELECT l.doc_id AS id, min(quality) AS strong, max(toxic) AS weak FROM labels l GROUP BY 1)
SELECT r.chapter, r.block, coalesce(CASE WHEN strong = 1 THEN 'strong' END, CASE WHEN id IS NOT NULL THEN 'weak' END, '') AS note FROM refs r LEFT JOIN defs ON defs.id = r.chapter""")
def footnote_resolve(spark: SparkSession, d: str) -> DataFrame:
    defs = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("strong"))
    strong = defs.where("strong = 1").select("id", F.lit("strong").alias("text"))
    weak = defs.select("id", F.lit("weak").alias("text"))
    return structure.resolve_notes(_refs(spark, d).withColumn("id", F.col("chapter")), strong, weak, "id").select("chapter", "block", "note")


@_query(" SELECT anchor FROM blocks WHERE chapter NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def note_suppress(spark: SparkSession, d: str) -> DataFrame:
    noted = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chapter"))
    return structure.suppress(_blocks(spark, d), noted, ["chapter"]).select("anchor")


@_query("""SELECT event_id, CASE WHEN list_has_any(regexp_split_to_array(lower(event_type || '-' || 'notes'), '[\\s_-]+'), ['footnote', 'footnotes', 'endnote', 'endnotes', 'rearnote', 'rearnotes', 'notebody']) OR lower(event_type) = 'note-body' THEN 'strong' ELSE 'weak' END AS kind FROM events""".replace("\\\\", "\\"), False)
def class_tokens_note_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", structure.note_kind(F.lit(""), F.concat("event_type", F.lit("-notes"))).alias("kind"))


@_query(" SELECT chapter, md5(text) AS id, min(block) AS block FROM blocks GROUP BY ALL")
def id_first_position(spark: SparkSession, d: str) -> DataFrame:
    return structure.first_positions(_blocks(spark, d).withColumn("id", F.md5("text")), ["chapter", "id"], "block")


@_query(""", cuts AS (SELECT book, chapter, block, row_number() OVER (PARTITION BY book, chapter ORDER BY block) AS n FROM blocks WHERE kind = 'heading')
SELECT b.book, b.chapter, b.block, CAST((SELECT count(*) FROM cuts c WHERE c.chapter = b.chapter AND c.block <= b.block) AS BIGINT) AS segment FROM blocks b""")
def chapter_islands(spark: SparkSession, d: str) -> DataFrame:
    return structure.islands(_blocks(spark, d).withColumn("start", F.col("kind") == "heading"), ["book", "chapter"], ["block"], "start", "segment").select("book", "chapter", "block", "segment")


@_query(" SELECT book, chapter, block, level FROM (SELECT *, min(level) OVER (PARTITION BY chapter) AS low FROM blocks WHERE kind = 'heading') WHERE level = low AND low <= 2")
def heading_starts(spark: SparkSession, d: str) -> DataFrame:
    return structure.heading_starts(_blocks(spark, d)).select("book", "chapter", "block", "level")


@_query(r""", n AS (SELECT anchor, regexp_replace(lower(text), '[\s\x{0085}\x{2028}\x{2029}\x{3000}\x{00a0}·・:：.。、,，;；\-—_=「」『』【】()（）\[\]<>《》]+', '', 'g') AS k, regexp_replace(lower(title), '[\s\x{0085}\x{2028}\x{2029}\x{3000}\x{00a0}·・:：.。、,，;；\-—_=「」『』【】()（）\[\]<>《》]+', '', 'g') AS t, kind FROM blocks) SELECT anchor, kind = 'heading' AND k = t AS same FROM n""")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("anchor", ((F.col("kind") == "heading") & (T.same_title(F.col("text")) == T.same_title(F.col("title")))).alias("same"))


@_query("SELECT page_id, regexp_replace(split_part(split_part(url, '://', 2), '#', 1), '/+$', '') AS path, CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) ELSE '' END AS fragment FROM pages", False)
def href_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", T.resolve_href(F.lit("a/b"), F.concat(F.lit("../.././"), F.split_part("url", F.lit("://"), F.lit(2)))).alias("r"))
    return rows.select("page_id", "r.path", "r.fragment")


_TOC = """toc AS (SELECT l_orderkey AS book, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord, CAST(CASE WHEN l_quantity <= 20 THEN 0 WHEN l_quantity <= 40 THEN 1 ELSE 2 END AS BIGINT) AS depth, 't' || l_partkey AS title, 'f' || l_suppkey AS path, CASE WHEN l_discount > 0.05 THEN 'x' || l_linenumber ELSE '' END AS fragment FROM lineitem)"""


def _toc(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("book"), F.row_number().over(order).cast("long").alias("ord"), F.when(q <= 20, 0).when(q <= 40, 1).otherwise(2).cast("long").alias("depth"), F.concat(F.lit("t"), "l_partkey").alias("title"),
        F.concat(F.lit("f"), "l_suppkey").alias("path"), F.when(F.col("l_discount") > 0.05, F.concat(F.lit("x"), "l_linenumber")).otherwise("").alias("fragment"),
    )


@_query(f"WITH {_TOC} SELECT book, ord, coalesce((SELECT string_agg(p.title, ' > ' ORDER BY p.ord) FROM toc p WHERE p.book = t.book AND p.ord < t.ord AND p.depth < t.depth AND NOT EXISTS (SELECT 1 FROM toc m WHERE m.book = t.book AND m.ord > p.ord AND m.ord < t.ord AND m.depth <= p.depth)), '') AS grp FROM toc t", False)
def toc_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return structure.toc_ancestors(_toc(spark, d)).select("book", "ord", F.array_join("ancestors", " > ").alias("grp"))


@_query(f"""WITH {_TOC}, p AS (
  SELECT t.*, (SELECT max_by(a.path, a.ord) FROM toc a WHERE a.book = t.book AND a.ord < t.ord AND a.depth < t.depth AND NOT EXISTS (SELECT 1 FROM toc m WHERE m.book = t.book AND m.ord > a.ord AND m.ord < t.ord AND m.depth <= a.depth)) AS up FROM toc t
), s AS (SELECT *, min(depth) OVER (PARTITION BY book) AS low FROM p WHERE path <> 'f1'), k AS (SELECT * FROM s WHERE depth = low OR path IS DISTINCT FROM up)
SELECT book, ord, title, path, fragment FROM k QUALIFY row_number() OVER (PARTITION BY book, path, fragment ORDER BY ord) = 1""", False)
def chapter_starts(spark: SparkSession, d: str) -> DataFrame:
    toc = _toc(spark, d)
    spine = toc.where("path <> 'f1'").select("book", "path").distinct()
    return structure.chapter_starts(structure.toc_ancestors(toc), spine).select("book", "ord", "title", "path", "fragment")


@_query(f"WITH {_TOC}, c AS (SELECT book, count(*) FILTER (depth = 0) AS nav, count(*) FILTER (depth > 0) AS ncx FROM toc GROUP BY book) SELECT book, CASE WHEN nav >= ncx AND nav > 0 THEN 'nav' WHEN ncx > 0 THEN 'ncx' ELSE '' END AS src FROM c", False)
def choose_toc(spark: SparkSession, d: str) -> DataFrame:
    return structure.choose_toc(_toc(spark, d).withColumn("src", F.when(F.col("depth") == 0, "nav").otherwise("ncx"))).select("book", "src")


@_query("""SELECT book, chapter, block, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY book, chapter, block ORDER BY ord) AS k FROM (
    SELECT book, chapter, ord, CASE WHEN id = '' THEN 0 ELSE coalesce(pos, 0) END AS block FROM (
      SELECT *, bool_or(id = '' OR pos IS NOT NULL) OVER (PARTITION BY book, chapter) AS hit, row_number() OVER (PARTITION BY book, chapter ORDER BY ord) AS n FROM (
        SELECT s.book, s.chapter, s.ord, s.id, i.pos FROM (
          SELECT book, chapter, CAST(o AS BIGINT) AS ord, CASE WHEN (chapter + o) % 5 = 0 AND chapter % 3 = 0 THEN '' ELSE 'h' || ((chapter + o) % 7) END AS id
          FROM (SELECT DISTINCT book, chapter FROM blocks), (SELECT unnest([0, 1, 2]) AS o)
        ) s LEFT JOIN (SELECT book, chapter, 'h' || level AS id, min(block) AS pos FROM blocks GROUP BY ALL) i ON i.book = s.book AND i.chapter = s.chapter AND i.id = s.id
      )
    ) WHERE id = '' OR pos IS NOT NULL OR (NOT hit AND n = 1)
  )
) WHERE k = 1""")
def resolve_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Three starts for each document: some without a fragment, some known, some not, some at one place."""
    b = _blocks(spark, d)
    starts = b.select("book", "chapter").distinct().select("book", "chapter", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("ord"))
    bare = ((F.col("chapter") + F.col("ord")) % 5 == 0) & (F.col("chapter") % 3 == 0)
    starts = starts.withColumn("id", F.when(bare, "").otherwise(F.concat(F.lit("h"), ((F.col("chapter") + F.col("ord")) % 7).cast("string"))))
    ids = structure.first_positions(b.withColumn("id", F.concat(F.lit("h"), F.col("level").cast("string"))), ["book", "chapter", "id"], "block")
    return structure.resolve_cuts(starts, ids, ["book", "chapter"], "id", "block", "ord").select("book", "chapter", "block", "ord")


@_query("SELECT event_type AS message, min(event_id) AS ord FROM events GROUP BY 1 ORDER BY 2 LIMIT 40", False)
def warnings_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.lit(1).alias("book"), F.col("event_id").alias("ord"), F.col("event_type").alias("message"))
    return structure.dedupe_warnings(rows).select("message", "ord")


# ---- chapters from prose ----------------------------------------------------

_PROSE = """, prose AS (SELECT book, chapter, block, CASE WHEN block % 5 = 0 THEN 'CHAPTER ' || (block // 5 + 1) || '. ' || substr(text, 1, 20) WHEN block % 5 = 1 THEN '-----' ELSE text END AS text FROM blocks)"""


def _prose(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("block")
    text = F.when(b % 5 == 0, F.concat(F.lit("CHAPTER "), (F.floor(b / 5) + 1).cast("string"), F.lit(". "), F.substring("text", 1, 20))).when(b % 5 == 1, "-----").otherwise(F.col("text"))
    return _blocks(spark, d).select("book", "chapter", "block", text.alias("text"))


_TITLE = r"""regexp_replace(regexp_replace(trim(text), '^[-—_=·*～~ \t\x{3000}\x{00a0}]+', ''), '[-—_=·*～~ \t\x{3000}\x{00a0}]+$', '')"""


@_query(_PROSE + f" SELECT book, chapter, count(*) FILTER (regexp_matches(text, '^(CHAPTER|Chapter|chapter) +([IVXLCDM]{{1,7}}|[0-9]{{1,4}})\\b')) AS markers FROM prose GROUP BY ALL".replace("\\\\", "\\"))
def rescue_markers(spark: SparkSession, d: str) -> DataFrame:
    return rescue.count_markers(_prose(spark, d))


@_query(_PROSE + f""", t AS (SELECT *, {_TITLE} AS bare, block % 5 = 0 AS is_title, block % 5 = 1 AS is_rule FROM prose), s AS (SELECT *, CAST(count(*) FILTER (is_title) OVER (PARTITION BY chapter ORDER BY block) AS BIGINT) AS part FROM t)
SELECT book, chapter, part, max(bare) FILTER (is_title) AS title, md5(coalesce(string_agg(text, ' ' ORDER BY block) FILTER (NOT is_title AND NOT is_rule), '')) AS digest FROM s GROUP BY ALL""")
def rescue_cut(spark: SparkSession, d: str) -> DataFrame:
    return rescue.cut_at_titles(_prose(spark, d)).select("book", "chapter", "part", "title", F.md5("body").alias("digest"))


@_query(_PROSE + """, t AS (SELECT book, chapter, count(*) FILTER (block % 5 = 0) AS markers, sum(greatest(1, floor(length(text) / 4.0 + 0.5))) AS tokens FROM prose GROUP BY ALL)
SELECT book, chapter, markers, CAST(tokens AS BIGINT) AS tokens, tokens > 500 AND markers >= 3 AND tokens / (markers + 1) <= 400 AS rescued FROM t""")
def rescue_predicate(spark: SparkSession, d: str) -> DataFrame:
    return rescue.predicate(_prose(spark, d), more_than=500, per_part=400)


@_query(_PROSE + f""", y AS (SELECT *, {_TITLE} AS bare FROM prose), x AS (SELECT *, lead(text, 1) OVER w AS l1, lead(text, 2) OVER w AS l2 FROM y WINDOW w AS (PARTITION BY chapter ORDER BY block))
SELECT chapter, block, CASE WHEN length(l2) BETWEEN 1 AND 40 AND NOT regexp_matches(l2, '[。．.！？!?；;]$') AND length(bare) < 40 AND l1 = '-----' THEN bare || ' ' || l2 ELSE bare END AS title FROM x WHERE block % 5 = 0""")
def title_repair(spark: SparkSession, d: str) -> DataFrame:
    return rescue.repair_titles(_prose(spark, d), shorter_than=40).select("chapter", "block", "title")


@_query()
def split_blocks_footnotes(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    notes = b.withColumn("footnotes", F.array(F.struct(F.lit(1).alias("number"), F.lit("n").alias("text"))))
    return rescue.split_blocks(notes, 100).select("chapter", "block", "piece", "text", "tokens", F.size("footnotes").cast("long").alias("notes"))


@_query()
def hard_split_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(packing.split_pieces(F.regexp_replace("text", "[。！？!?；;…\n]", " "), 60)).alias("piece", "t"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), T.count_tokens(F.col("t")).alias("tokens"))


@_query()
def html_parse_blocks(spark: SparkSession, d: str) -> DataFrame:
    from leafwright.sources.markup import html_blocks

    return html_blocks(table(spark, d, "pages"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
