"""Column expressions on text: white space, token estimates, sentences, titles and anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of characters that count as a token each.
CJK = "[\\u1100-\\u11ff\\u2e80-\\u2eff\\u3000-\\u303f\\u3040-\\u30ff\\u3130-\\u318f\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff\\uff00-\\uffef]"
# The characters after which a sentence ends.
SENTENCE_ENDS = "。！？!?；;…\n"
# What white space is folded, and what a title comparison ignores.
FOLDED = "[ \\t\\r\\n\\f\\u000b\\u00a0\\u3000]+"
TITLE_NOISE = "[\\s\\u0085\\u2028\\u2029\\u3000\\u00a0·・:：.。、,，;；\\-—_=「」『』【】()（）\\[\\]<>《》]+"
# The shapes of chapter titles in plain text.
_NUMERAL = "[0-9０-９一二三四五六七八九十百千零〇两廿卅]"
TITLE_SHAPES = (
    f"^第\\s*{_NUMERAL}{{1,6}}\\s*[回章節节卷篇部集](?=$|[\\s\\u3000：:、，,．.；;·—\\-])",
    f"^(?:卷|回|章|節|节)\\s*{_NUMERAL}{{1,6}}\\s*[、.．:：]",
    "^(?:CHAPTER|Chapter|chapter)\\s+(?:[IVXLCDM]{1,7}|[0-9]{1,4})\\b",
    "^(?:PART|Part|BOOK|Book)\\s+(?:[IVXLCDM]{1,7}|[0-9]{1,4})\\b",
)
RULE_CHARS = "\\-—_=·*～~ \\t\\u3000\\u00a0"
MAX_TITLE, SHORT_TITLE, MAX_CONTINUATION = 60, 14, 40


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, FOLDED, " "))


def cjk_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, CJK, ""))


def estimate(cjk: Column, rest: Column) -> Column:
    """Tokens for so many CJK and other characters: a quarter for each other one, rounded half up, one at least."""
    some = F.greatest(F.lit(1), F.floor(cjk + rest / 4 + 0.5))
    return F.when((cjk + rest) > 0, some).otherwise(F.lit(0)).cast("long")


def count_tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    cjk = cjk_chars(text)
    return estimate(cjk, F.length(text) - cjk)


def sentences(text: Column) -> Column:
    """Array of the text's sentences, without loss."""
    return F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+"), F.lit(0))


def same_title(text: Column) -> Column:
    """A title in the form in which titles are compared."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TITLE_NOISE, "")


def strip_rule(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, "^\\s+|\\s+$", ""), f"^[{RULE_CHARS}]+|[{RULE_CHARS}]+$", "")


def title_of(line: Column) -> Column:
    """The chapter title that a line is, or null."""
    bare = strip_rule(line)
    fits = F.lit(False)
    for shape in TITLE_SHAPES:
        fits = fits | bare.rlike(shape)
    return F.when((F.length(bare) > 0) & (F.length(bare) <= MAX_TITLE) & fits, bare)


def is_rule(line: Column) -> Column:
    """Is the line a drawn rule, of three characters or more?"""
    return F.regexp_replace(line, "^\\s+|\\s+$", "").rlike(f"^[{RULE_CHARS}]{{3,}}$")


def continues_title(line: Column) -> Column:
    """May the line be the second line of a title?"""
    bare = F.regexp_replace(line, "^\\s+|\\s+$", "")
    return (F.length(bare).between(1, MAX_CONTINUATION)) & ~bare.rlike("[。．.！？!?；;]$") & ~bare.startswith("- ") & ~bare.startswith("1. ") & title_of(line).isNull()


def anchor(chapter: Column, block: Column | None = None) -> Column:
    out = F.concat(F.lit("c"), chapter.cast("string"))
    return out if block is None else F.concat(out, F.lit("p"), block.cast("string"))


def parse_anchor(text: Column) -> Column:
    """(chapter, block) of an anchor like ``c3`` or ``c3p12``, in either case; null if it is none."""
    bare = F.trim(text)
    return F.when(bare.rlike("(?i)^c[0-9]+(?:p[0-9]+)?$"), F.struct(*(F.nullif(F.regexp_extract(bare, "(?i)^c([0-9]+)(?:p([0-9]+))?$", k), F.lit("")).cast("long").alias(n) for k, n in ((1, "chapter"), (2, "block")))))


def resolve_href(base_dir: Column, href: Column) -> Column:
    """(path, fragment) of a link: split at the first ``#``, unquoted, joined to ``base_dir`` and normalised."""
    raw = F.split_part(href, F.lit("#"), F.lit(1))
    unquote = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    fragment = F.when(F.instr(href, "#") > 0, unquote(F.substring(href, F.instr(href, "#") + 1, F.length(href)))).otherwise(F.lit(""))
    path = unquote(raw)
    joined = F.when(path.startswith("/") | (F.coalesce(base_dir, F.lit("")) == ""), path).otherwise(F.concat(base_dir, F.lit("/"), path))
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when(part.isin("", "."), acc).when((part == "..") & up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((part == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(part)))

    clean = F.array_join(F.aggregate(F.split(joined, "/"), empty, step), "/")
    return F.struct(F.when(path == "", F.lit("")).otherwise(clean).alias("path"), fragment.alias("fragment"))
