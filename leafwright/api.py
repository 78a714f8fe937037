"""Calls on one book. Each is a question over the DataFrames that ``leafwright.sources.epub`` builds for it.

For many books use those relations and ``leafwright.operators.query`` directly; nothing here is meant for a corpus.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.errors import AnchorError, NotABookError, ProtectedError
from leafwright.functions import text as T
from leafwright.operators import query, structure
from leafwright.sources import epub
from leafwright.sources.shared import Tables


def _held(df: DataFrame) -> DataFrame:
    """A relation of one book as local rows: calls on it start from a plan of one node. A book's size is bounded by its file's."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _rows(spark: SparkSession, path: str, container_only: bool = False) -> DataFrame:
    if "://" not in path and not os.path.exists(path):
        raise NotABookError(f"no such file: {path}")
    files = spark.read.format("binaryFile").load(path)
    rows = _held(epub.unpack(files, container_only))
    status = epub.of(rows, "status").first()["status"]
    if status == "protected":
        raise ProtectedError(f"{path} is encrypted")
    if status != "ok":
        raise NotABookError(f"{path}: {status}")
    return rows


def inspect(spark: SparkSession, path: str) -> dict:
    """What the container says; prose is not read."""
    rows = _rows(spark, path, container_only=True)
    meta = epub.metadata(rows).first().asDict()
    spine = [{"id": r["id"], "path": r["path"], "linear": r["flag"]} for r in epub.of(rows, "spine").orderBy("pos").collect()]
    manifest = [{"id": r["id"], "path": r["path"], "media_type": r["kind"], "properties": (r["extra"] or "").split()} for r in epub.of(rows, "manifest").orderBy("pos").collect()]
    return {"source": path, "opf_path": meta.pop("opf_path"), "meta": meta, "spine": spine, "manifest": manifest, "member_count": epub.of(rows, "status").first()["level"]}


def open_book(spark: SparkSession, path: str) -> Book:
    """Parses one book; raises NotABookError or ProtectedError."""
    return Book(_rows(spark, path), path)


class Book:
    def __init__(self, rows: DataFrame, source: str) -> None:
        self.source = source
        tables = Tables(rows.sparkSession)
        made = epub.build(rows, tables)
        self.meta = epub.metadata(rows).first().asDict()
        self.name = self.meta.get("title") or os.path.basename(source)
        self.blocks = _held(made["blocks"].withColumn("book", F.lit(self.name)))
        self.chapters = [r.asDict() for r in made["chapters"].orderBy("chapter").collect()]
        self.warnings = [r["message"] for r in made["warnings"].orderBy("ord").collect()]
        self.toc = _held(made["toc"].withColumn("book", F.lit(self.name)))
        tables.discard()

    def info(self) -> dict:
        return {**self.stats(), "meta": self.meta, "source": self.source}

    def stats(self) -> dict:
        row = query.stats(self.blocks).first()
        more = self.blocks.agg(F.sum(F.size("footnotes")).alias("footnotes"), F.countDistinct("page").alias("print_pages")).first()
        return {"title": self.name, "authors": self.meta["authors"], "language": self.meta["language"], **{k: row[k] if row else 0 for k in ("chapters", "blocks", "characters", "tokens")}, "footnotes": more["footnotes"] or 0, "print_pages": more["print_pages"], "warnings": len(self.warnings)}

    def chapter(self, index: int) -> dict:
        n = len(self.chapters)
        if not -n <= index < n:
            raise AnchorError(f"chapter {index} is out of range: there are {n}")
        return self.chapters[index]

    def resolve(self, target: str | int) -> tuple[int, int | None]:
        """(chapter, block) of a number, an anchor or a title."""
        if isinstance(target, int):
            return self.chapter(target)["chapter"], None
        import re

        if m := re.fullmatch(r"c(\d+)(?:p(\d+))?", target.strip(), re.I):
            return self.chapter(int(m[1]))["chapter"], int(m[2]) if m[2] else None
        low = target.strip().lower()
        exact = [c for c in self.chapters if c["title"].lower() == low]
        if exact:
            return exact[0]["chapter"], None
        found = [c for c in self.chapters if low in c["title"].lower()] if low else []
        if len(found) != 1:
            raise AnchorError(f"no chapter like {target!r}" if not found else f"{target!r} is ambiguous: " + ", ".join(c["title"] for c in found[:8]))
        return found[0]["chapter"], None

    def outline(self, depth: int = 2) -> list[dict]:
        per = {r["chapter"]: r for r in query.chapters(self.blocks).collect()}
        pages = {r["chapter"]: r["page"] for r in self.blocks.groupBy("chapter").agg(F.min_by("page", F.when(F.col("page").isNotNull(), F.col("block"))).alias("page")).collect()}
        inner: dict[int, list] = {}
        if depth > 1:
            heads = query.sections(self.blocks, depth)
            every = heads.withColumn("source", F.lit("heading")).unionByName(structure.toc_sections(self.toc, self.blocks, heads).withColumn("source", F.lit("toc")))
            for r in every.orderBy("chapter", "block", "anchor").collect():
                inner.setdefault(r["chapter"], []).append({k: r[k] for k in ("anchor", "title", "level", "tokens", "source")})
        return [{"anchor": c["anchor"], "title": c["title"], "tokens": per[c["chapter"]]["tokens"], "blocks": per[c["chapter"]]["n_blocks"], "page": pages.get(c["chapter"]), "depth": c["depth"], "group": c["grp"], **({"sections": inner.get(c["chapter"], [])} if depth > 1 else {})} for c in self.chapters if c["chapter"] in per]

    def search(self, text: str, limit: int = 20, all_terms: bool = False, regex: bool = False, max_tokens: int = 400, chapter: str | int | None = None) -> list[dict]:
        index = None if chapter is None else self.resolve(chapter)[0]
        notes = F.array_join(F.transform("footnotes", lambda n: F.concat(F.lit("\n[^"), n["number"].cast("string"), F.lit("] "), n["text"])), "")
        rows = self.blocks.withColumn("text", F.concat("text", notes)).withColumn("tokens", T.count_tokens(F.col("text")))
        hits = query.search(rows, text, "regex" if regex else "all_terms" if all_terms else "phrase", chapter=index, limit=limit)
        cut = query.snippet(F.col("text"), F.col("tokens"), F.col("position"), max_tokens)
        return [r.asDict() for r in hits.select("anchor", F.col("chapter").alias("chapter_index"), F.col("title").alias("chapter_title"), cut.alias("text"), "kind", "page", (F.col("tokens") > max_tokens).alias("truncated")).collect()]

    def read(self, target: str | int, max_tokens: int | None = None, include_footnotes: bool = True) -> dict:
        index, block = self.resolve(target)
        own = self.blocks.where(F.col("chapter") == index)
        if block is not None and own.where(F.col("block") == block).isEmpty():
            raise AnchorError(f"c{index}p{block} is out of range")
        notes = F.array_join(F.transform("footnotes", lambda n: F.concat(F.lit("\n[^"), n["number"].cast("string"), F.lit("]: "), n["text"])), "")
        rows = own.where(F.col("block") >= (block or 0))
        rows = rows.withColumn("text", F.concat("text", notes)) if include_footnotes else rows
        r = query.read(rows, max_tokens if max_tokens is not None else 1 << 28).first()
        title = self.chapters[index]["title"]
        if r is None:
            return {"anchor": f"c{index}p{block or 0}", "anchor_end": f"c{index}p{block or 0}", "next_anchor": self._after(index), "chapter_index": index, "chapter_title": title, "breadcrumb": f"{self.name} > {title}", "text": "", "tokens": 0, "truncated": False, "blocks_read": 0}
        following = r["next_anchor"]
        return {"anchor": r["anchor"], "anchor_end": r["anchor_end"], "next_anchor": following or self._after(index), "chapter_index": index, "chapter_title": title, "breadcrumb": " > ".join(dict.fromkeys(x for x in (self.name, self.chapters[index]["grp"], title) if x)), "text": r["text"], "tokens": r["tokens"], "truncated": r["truncated"], "blocks_read": r["blocks_read"]}

    def _after(self, index: int) -> str | None:
        row = self.blocks.where((F.col("chapter") > index) & ~F.col("dedup") & (F.trim("text") != "")).agg(F.min(F.struct("chapter", "block")).alias("at")).first()
        return f"c{row['at']['chapter']}p{row['at']['block']}" if row["at"] else None

    def chunks(self, max_tokens: int = 800, overlap: int = 0, offset: int = 0, limit: int | None = None) -> list[dict]:
        rows = query.chunks(self.blocks, max_tokens, overlap).orderBy("chapter", "chunk").offset(offset)
        return [r.asDict() for r in (rows if limit is None else rows.limit(limit)).collect()]

    def chunk_count(self, max_tokens: int = 800, overlap: int = 0) -> int:
        return query.chunks(self.blocks, max_tokens, overlap).count()

    def markdown(self, max_tokens: int | None = None, anchors: bool = False, start: int = 0, end: int | None = None) -> dict:
        rows = self.blocks.where(F.col("chapter") >= start)
        rows = rows if end is None else rows.where(F.col("chapter") <= end)
        r = query.markdown(rows, max_tokens, anchors, F.array(*map(F.lit, self.meta["authors"])) if self.meta["authors"] else None).first()
        out = r.asDict() if r else {"text": f"# {self.name}", "truncated": False, "next_chapter": None, "next_anchor": None}
        if end is not None and not out["truncated"] and end + 1 < len(self.chapters):
            out["next_chapter"] = end + 1
        return {**out, "characters": len(out["text"])}

    def doctor(self) -> dict:
        return {"stats": self.stats(), "toc_entries": self.toc.count(), "from_toc": sum(c["title_from_toc"] for c in self.chapters), "from_headings": [c["title"] for c in self.chapters if not c["title_from_toc"]][:10], "warnings": self.warnings}
