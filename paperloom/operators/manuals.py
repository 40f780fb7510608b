"""Manuals as page texts and HTML: chunks, sections, statutory index, contents, and the calls that list and open them.

The grammars are regular expressions under fixed values; other manuals need other values, not other code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import guideline_text, lookup_token, normal_space, slug, title18_citation
from paperloom.operators.hierarchy import header_block, html_headings, lines_of, next_boundary, outline_alias, sections, to_chunks, with_headings

# Heading lines of the manuals.
GUIDELINE_LEVELS = (("top_heading", r"^Section [IVX]+"), ("chapter_heading", r"^\d+\.\s+Chapter\s+\d+:"), ("subsection_heading", r"^[a-z]\.\s+"))
USSG_LEVELS = (("chapter_heading", r"^(?:CHAPTER|Chapter)\s+[A-Z0-9IVX]+"), ("part_heading", r"^(?:PART|Part)\s+[A-Z0-9]+"), ("section_heading", r"^§\s*[0-9A-Z]+[A-Z0-9.-]*"))
USSG_SUBHEADINGS = ("commentary", "application notes", "application note", "background", "introductory commentary", "historical note", "statutory provisions")
USSG_ARTIFACTS = ("=", "Il", "ǁ", "|", "*", "**")
STATUTE_LINE = r"^\d+\s+U\.S\.C\.\s+§{1,2}\s+.+$"
GUIDELINE_REFERENCE = r"\b\d[A-Z]\d+\.\d+\b"
OUTLINE_LEVELS = ((1, r"^(?:Section|Appendix) "), (2, r"^[A-Z]\."), (3, r"^\d+\."), (4, r"^[a-z]\."), (5, r"^\d+\)"), (6, r"^[a-z]\)"))


def is_artifact(line: Column, year: Column | int) -> Column:
    """Lines that a page adds: stray marks, page numbers, the running title of the year."""
    t = F.trim(line)
    return (t == "") | t.isin(*USSG_ARTIFACTS) | t.rlike(r"^\d+$") | (t == F.concat(F.lit("Guidelines Manual (November 1, "), (F.lit(year) if isinstance(year, int) else year).cast("string"), F.lit(")")))


def outline_level(title: Column) -> Column:
    """Depth of an outline entry by its marker, 0 if it has none."""
    t, level = guideline_text(title), None
    for n, pattern in OUTLINE_LEVELS:
        level = F.when(t.rlike(pattern), n) if level is None else level.when(t.rlike(pattern), n)
    return level.otherwise(0)


def outline_marker(title: Column) -> Column:
    """The marker itself: IV of ``Section IV``, B of ``Appendix B``, 3 of ``3.``."""
    t = guideline_text(title)
    found = (F.regexp_extract(t, p, 1) for p in (r"^Section\s+([IVXLC]+)\b", r"^Appendix\s+([A-Z])\b", r"^([A-Z]|\d+|[a-z])[.)]"))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def _page_lines(pages: DataFrame, key: str) -> DataFrame:
    return lines_of(pages, key, "text", "page").withColumn("text", normal_space(F.col("text"))).where("text <> ''")


def _path(*names: str) -> Column:
    return F.concat_ws(" > ", *(F.nullif(F.col(n), F.lit("")) for n in names))


def guideline_chunks(pages: DataFrame, key: str = "source_path", title: str = "Coding Guidelines", limit: int = 12000) -> DataFrame:
    """Chunks of coding guidelines: lines below a lettered subsection; headings without lines give nothing."""
    names = [n for n, _ in GUIDELINE_LEVELS]
    headed = with_headings(_page_lines(pages, key), key, [(n, F.col("text").rlike(p)) for n, p in GUIDELINE_LEVELS])
    body = sections(headed, key, names).where("subsection_heading is not null")
    text = F.concat(F.lit(f"Document: {title}\nTop heading: "), F.coalesce("top_heading", F.lit("")), F.lit("\nChapter: "), F.coalesce("chapter_heading", F.lit("")), F.lit("\nSubsection: "), F.col("subsection_heading"), F.lit("\n\n"), F.col("body"))
    rows = body.select(F.lit("guidelines").alias("source_type"), F.lit(title).alias("document_title"), F.col("subsection_heading").alias("chunk_title"), _path(*names).alias("semantic_path"), F.col(key).alias("source_path"), normal_space(text).alias("text"))
    return to_chunks(rows, limit)


def ussg_chunks(pages: DataFrame, year: int, key: str = "source_path", limit: int = 12000) -> DataFrame:
    """Chunks of a guidelines manual: one per section and subheading, boilerplate lines dropped, with the section's citation."""
    title = f"Guidelines Manual ({year})"
    lines = _page_lines(pages, key).where(~is_artifact(F.col("text"), year))
    grammar = [(n, F.col("text").rlike(p)) for n, p in USSG_LEVELS] + [("subheading", F.lower("text").isin(*USSG_SUBHEADINGS))]
    names = [n for n, _ in grammar]
    body = sections(with_headings(lines, key, grammar), key, names).where("section_heading is not null")
    head = header_block({"Document": F.lit(title), "Chapter": F.col("chapter_heading"), "Part": F.col("part_heading"), "Section": F.col("section_heading"), "Subsection": F.col("subheading")})
    rows = body.select(
        F.lit("ussg").alias("source_type"), F.lit(year).alias("source_year"), F.lit(title).alias("document_title"), F.concat_ws(" - ", "section_heading", "subheading").alias("chunk_title"), _path(*names).alias("semantic_path"),
        F.nullif(F.regexp_extract("section_heading", r"^(§\s*[0-9A-Z]+[A-Z0-9.-]*)", 1), F.lit("")).alias("citation"), F.col(key).alias("source_path"), normal_space(F.concat(head, F.lit("\n\n"), F.col("body"))).alias("text"),
    )
    return to_chunks(rows, limit)


def title18_sections(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """(key, ord, document_title, part_heading, chapter_heading, heading, body) of the sections of statute HTML.

    Title, part and chapter hold until the next heading of their class; a part ends the chapter. Sections without text are
    left out, text below headings of other classes is too.
    """
    h = html_headings(pages, key, "html").withColumn("class", F.lower("class"))
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)

    def last(name: str) -> Column:
        return F.max(F.when(F.col("class") == name, F.struct("ord", "heading"))).over(order)

    out = h.withColumns({"_t": last("usc-title-head"), "_p": last("part-head"), "_c": last("chapter-head")})
    chapter = F.when(F.col("_p").isNull() | (F.col("_c.ord") > F.col("_p.ord")), F.col("_c.heading"))
    return out.where("class = 'section-head' and body <> ''").select(key, "ord", F.col("_t.heading").alias("document_title"), F.col("_p.heading").alias("part_heading"), chapter.alias("chapter_heading"), "heading", "body")


def title18_chunks(pages: DataFrame, year: int, key: str = "source_path", limit: int = 12000) -> DataFrame:
    s = title18_sections(pages, key).withColumn("document_title", F.coalesce("document_title", F.lit(f"Title 18 United States Code ({year})")))
    head = header_block({"Document": F.col("document_title"), "Part": F.col("part_heading"), "Chapter": F.col("chapter_heading"), "Section": F.col("heading")})
    rows = s.select(F.lit("usc_title18").alias("source_type"), F.lit(year).alias("source_year"), "document_title", F.col("heading").alias("chunk_title"), _path("document_title", "part_heading", "chapter_heading", "heading").alias("semantic_path"), title18_citation(F.col("heading")).alias("citation"), F.col(key).alias("source_path"), normal_space(F.concat(head, F.lit("\n\n"), F.col("body"))).alias("text"))
    return to_chunks(rows, limit)


def title18_structure(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """Chapters with their sections in order: chapter_id, chapter_heading, part_heading, section_count, sections."""
    s = title18_sections(pages, key).where("chapter_heading is not null").withColumn("chapter_id", slug(F.col("chapter_heading")))
    entry = F.struct("ord", slug(F.col("heading")).alias("section_id"), "heading", title18_citation(F.col("heading")).alias("citation"), "body")
    return s.groupBy(key, "chapter_id").agg(F.min_by("chapter_heading", "ord").alias("chapter_heading"), F.min_by("part_heading", "ord").alias("part_heading"), F.count("*").alias("section_count"), F.array_sort(F.collect_list(entry)).alias("sections"))


def open_chapters(structure: DataFrame, requests: DataFrame) -> DataFrame:
    """Chapters by id for a table of requests (request_id, chapter_id); misses have status ``not_found``."""
    return requests.join(structure, "chapter_id", "left").withColumn("status", F.when(F.col("section_count").isNull(), "not_found").otherwise("found"))


def appendix_entries(pages: DataFrame, year: int, key: str = "source_path") -> DataFrame:
    """The statutory index: statute lines with the guideline sections named on the first line below them that names any.

    Looked for on the same page, up to the next statute line or running title; from the page that says APPENDIX A to the
    one that begins the index after the first entry; a statute with the same sections counts once.
    """
    marked = pages.withColumns({"_in": F.col("text").contains("APPENDIX A"), "_end": F.col("text").contains("INDEX TO GUIDELINES MANUAL")})
    order = Window.partitionBy(key).orderBy("page")
    begun = F.max(F.col("_in").cast("int")).over(order) == 1
    own = marked.withColumn("_begun", begun).where("_begun")
    lines = lines_of(own, key, "text", "page").withColumn("text", F.trim("text")).where("text <> ''")
    stop = F.col("text").isin("APPENDIX A", "INDEX TO GUIDELINES MANUAL")
    statute = F.col("text").rlike(STATUTE_LINE)
    within = Window.partitionBy(key, "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumns({"_statute": statute, "_group": F.sum((statute | stop).cast("int")).over(within), "_refs": F.regexp_extract_all("text", F.lit(f"({GUIDELINE_REFERENCE})"), 1)})
    per = grouped.groupBy(key, "page", "_group").agg(
        F.min(F.when(F.col("_statute"), F.col("line"))).alias("line"), F.min_by(F.when(F.col("_statute"), F.col("text")), "line").alias("statute_citation"), F.min(F.when(~F.col("_statute") & (F.size("_refs") > 0), F.struct("line", "_refs"))["line"]).alias("_at"),
        F.min_by("_refs", F.when(~F.col("_statute") & (F.size("_refs") > 0), F.col("line"))).alias("_refs"),
    )
    found = per.where("statute_citation is not null and _at is not null").withColumn("guideline_sections", F.array_distinct("_refs"))
    first = found.groupBy(key).agg(F.min("page").alias("_first"))
    ends = marked.where("_end").select(key, F.col("page").alias("_end_page"))
    last = first.join(ends, key).where("_end_page > _first").groupBy(key).agg(F.min("_end_page").alias("_last"))
    kept = found.join(last, key, "left").where("_last is null or page < _last")
    one = kept.groupBy(key, "statute_citation", "guideline_sections").agg(F.min(F.struct("page", "line")).alias("at"))
    return one.select(key, F.concat(F.lit(f"ussg_appendix_a|{year}|"), lookup_token(F.col("statute_citation"))).alias("entry_id"), F.lit("ussg_appendix_a").alias("source_type"), F.lit(year).alias("source_year"), "statute_citation", "guideline_sections", "at")


# --- contents

# Lines of a table of contents.
_CHAPTER, _PART, _SUB = re.compile(r"CHAPTER\s+[A-Z0-9]+$", re.I), re.compile(r"(?:PART|Part)\s+[A-Z0-9]+\s*[-—]"), re.compile(r"\d+\.(?:$|\s)")
_NUMBER = re.compile(r"[.|]*\d+$|\|?\s*[ivxlcdm]+$", re.I)
_TAIL = re.compile(r"\s*[.|]*\d+\s*$")
CONTENTS = "chapter_ord int, part_ord int, sub_ord int, chapter string, title string, part string, subheading string"


def contents_of(lines: list[str]) -> Iterator[tuple[int, int, int, str | None, str | None, str | None, str | None]]:
    """Chapters, parts and subheadings of a table of contents, as numbered rows; a heading may run over several lines."""

    def kind(x: str) -> str:
        if _NUMBER.fullmatch(x) or x == "TABLE OF CONTENTS" or x in USSG_ARTIFACTS:
            return "skip"
        return "chapter" if _CHAPTER.match(x) else "part" if _PART.match(x) else "sub" if _SUB.match(x) else "text"

    def bare(x: str) -> str:
        return x if re.fullmatch(r"\d+\.", x) else _TAIL.sub("", x).rstrip(" .")

    blocks: list[list[str]] = []  # [kind, heading line, continuation]
    for x in lines:
        k = kind(x)
        if k == "skip":
            blocks.append(["skip", "", ""])
        elif k != "text":
            blocks.append([k, x if k == "chapter" else bare(x), ""])
        elif blocks and blocks[-1][0] != "skip":
            blocks[-1][2] = f"{blocks[-1][2]} {bare(x)}".strip()
    c = p = s = 0
    chapter = title = part = None
    for k, head, more in blocks:
        if k == "chapter":
            c, p, s, chapter, title, part = c + 1, 0, 0, head, more or None, None
            yield c, 0, 0, chapter, title, None, None
        elif k == "part" and chapter:
            p, s, part = p + 1, 0, f"{head} {more}".strip()
            yield c, p, 0, chapter, title, part, None
        elif k == "sub" and part:
            s += 1
            yield c, p, s, chapter, title, part, f"{head} {more}".strip()


def table_of_contents(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """The contents of each manual as rows (chapter_ord, part_ord, sub_ord, chapter, title, part, subheading).

    From the page that says TABLE OF CONTENTS to the first page that begins the text. The pages of one manual's front
    matter are a bounded group; their order is a true sequence, so they are read by one task each.
    """
    key_type = pages.schema[key].dataType.simpleString()
    start = pages.withColumn("_toc", F.col("text").contains("TABLE OF CONTENTS"))
    order = Window.partitionBy(key).orderBy("page")
    ends = F.exists(F.split("text", "\n"), lambda x: F.trim(x).rlike(r"^(?:Ch\.\s*\d+\b|§)"))
    own = start.withColumns({"_on": F.max(F.col("_toc").cast("int")).over(order), "_e": ends}).where("_on = 1")
    own = own.withColumn("_over", F.max(F.col("_e").cast("int")).over(order)).where("_over = 0").select(key, "page", "text")

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        lines = [" ".join(x.split()) for t in frame.sort_values("page")["text"] for x in t.splitlines() if x.strip()]
        out = pd.DataFrame(list(contents_of(lines)), columns=[c.split()[0] for c in CONTENTS.split(", ")])
        out.insert(0, key, frame[key].iloc[0])
        return out

    return own.groupBy(key).applyInPandas(read, f"{key} {key_type}, {CONTENTS}")


# --- contents of the coding guidelines

# The manual's name, lines its pages repeat, a marker that stands alone, and the pages of its contents.
GUIDELINES_NAME = "FY 2019 ICD-10-CM Official Guidelines for Coding and Reporting"
GUIDELINE_ARTIFACTS = ("FY 2019", "ICD-10-CM Official Guidelines for Coding and Reporting", "ICD-10-CM Official Guidelines for Coding and Reporting.")
_PAGE_OF = re.compile(r"Page \d+ of \d+")
_MARKER = re.compile(r"\d+[.)]|[A-Z][.)]|[a-z][.)]|(?:Section|Appendix) [IVXLC]+\.?")
CONTENTS_PAGES = (2, 7)


def guideline_artifact(line: Column) -> Column:
    """Lines that the pages of the guidelines repeat, and blank ones."""
    text = guideline_text(line)
    return (text == "") | text.isin(*GUIDELINE_ARTIFACTS) | text.rlike(rf"^{_PAGE_OF.pattern}$")


class _Contents:
    """Reads contents whose page numbers close each entry, and whose markers may have slipped before an earlier entry.

    Markers that found no title wait in a queue; an entry without a marker of its own takes the first one waiting. A
    chapter takes a marker that stands before it in its own lines, and then the one waiting longest is void.
    """

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def title(self, lines: list[str]) -> str | None:
        if not lines:
            return None
        chapter = next((i for i, x in enumerate(lines) if x.startswith("Chapter ")), None)
        words = [x for x in lines[chapter or 0 :] if not _MARKER.fullmatch(x)]
        marker = None
        if chapter is not None:
            own = [x for x in lines[:chapter] if _MARKER.fullmatch(x)]
            if not words:
                self.waiting += own
                return None
            marker = next(iter(own or self.waiting), None)
            self.waiting = self.waiting[1:] + own[1:]
        else:
            if _MARKER.fullmatch(lines[0]):
                marker = lines[0]
            elif self.waiting:
                marker = self.waiting.pop(0)
            if not words:
                self.waiting[:0] = [marker] if marker else []
                return None
        return " ".join(" ".join([marker, *words] if marker else words).split()).rstrip(".")


def guideline_contents(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """The contents of each coding guideline: (key, ord, section_id, title, level, target_page), from its first pages.

    Entries without a marker, and the manual's own name, are none. The lines are a true sequence with markers that wait
    over entries; those few pages of a manual are read by one task.
    """
    key_type = pages.schema[key].dataType.simpleString()
    lines = lines_of(pages.where(F.col("page").between(*CONTENTS_PAGES)), key, "text", "page").where(~guideline_artifact(F.col("text"))).select(key, "page", "line", guideline_text(F.col("text")).alias("text"))

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        state, open_, out = _Contents(), [], []
        for text in frame.sort_values(["page", "line"])["text"]:
            if not text.isdecimal():
                open_.append(text)
            elif open_:
                title = state.title(open_)
                open_ = []
                if title and title != GUIDELINES_NAME:
                    out.append((frame[key].iloc[0], len(out) + 1, title, int(text)))
        return pd.DataFrame(out, columns=[key, "ord", "title", "target_page"])

    found = lines.groupBy(key).applyInPandas(read, f"{key} {key_type}, ord int, title string, target_page int").withColumn("level", outline_level(F.col("title"))).where("level > 0")
    return found.select(key, "ord", F.concat_ws("|", F.lit("guidelines"), F.col("target_page").cast("string"), slug(F.col("title"))).alias("section_id"), "title", "level", "target_page")


# --- outlines


def outline(entries: DataFrame, key: str) -> DataFrame:
    """Outline entries (key, ord, title) with level, marker, alias such as I.C.4 and the first later entry not below them."""
    marked = entries.withColumns({"level": outline_level(F.col("title")), "marker": outline_marker(F.col("title"))}).where("level > 0")
    return next_boundary(outline_alias(marked.withColumn("level", F.col("level") - 1), key, len(OUTLINE_LEVELS)), key)


def list_outline(entries: DataFrame, prefix: str | None = None, level: int | None = None, limit: int | None = None) -> DataFrame:
    """Entries in order, by title prefix and level."""
    out = entries
    if prefix:
        out = out.where(F.lower("title").startswith(prefix.lower()))
    if level is not None:
        out = out.where(F.col("level") == level)
    out = out.orderBy("ord")
    return out if limit is None else out.limit(limit)


def open_outline(entries: DataFrame, lines: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The text of requested entries (request_id, wanted: alias or title), from their line to the next boundary.

    ``entries`` are those of ``outline`` with ``ord`` the line number; pages bound the text; unknown ones have found = false.
    """
    named = entries.select(key, "ord", "next_ord", "title", "alias", F.explode(F.array_distinct(F.array("alias", "title"))).alias("wanted"))
    one = requests.join(named, "wanted", "left")
    text = one.join(lines.select(key, "page", F.col("line").alias("_l"), "text"), key).where((F.col("_l") >= F.col("ord")) & (F.col("next_ord").isNull() | (F.col("_l") < F.col("next_ord"))))
    body = text.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return one.select("request_id", "wanted", "title", "alias").join(body, "request_id", "left").withColumn("found", F.col("title").isNotNull())
