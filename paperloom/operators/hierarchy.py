"""Headed texts to sections and chunks: a declarative grammar of heading levels over ordered lines.

A grammar is a list of (name, condition); level 0 is the outermost. A heading opens its level and closes all below. The
order of lines is carried by columns, never by file order; a document is the unit of order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import chunk_id, normal_space, strip_ws, token_estimate


def lines_of(df: DataFrame, key: str, text: str, page: str | None = None) -> DataFrame:
    """(key, page, line, text): the lines of each text in order, numbered from 1."""
    cut = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    return df.select(F.col(key), (F.col(page) if page else F.lit(1)).alias("page"), F.posexplode(cut).alias("line", "text")).withColumn("line", F.col("line") + 1)


def with_headings(lines: DataFrame, key: str, grammar: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``level`` (null for body lines) and, per level, the heading in force (null where none is).

    Each level's heading is the last one within the running group of the level above, so an outer heading resets the
    inner ones. One sort per document serves all windows.
    """
    level = None
    for i, (_, condition) in enumerate(grammar):
        level = F.when(condition, i) if level is None else level.when(condition, i)
    out = lines.withColumn("level", level)
    order = Window.partitionBy(key).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    groups: list[str] = []
    for i, (name, _) in enumerate(grammar):
        at = F.struct("page", "line", "text")
        last_here = F.max(F.when(F.col("level") == i, at)).over(order)
        last_outer = F.max(F.when(F.col("level") < i, F.struct("page", "line", "text"))).over(order) if i else None
        alive = last_here if i == 0 else F.when(last_outer.isNull() | (last_here > last_outer), last_here)
        out = out.withColumn(f"_h{i}", alive)
        groups.append(f"_h{i}")
    return out.select(*lines.columns, "level", *(F.col(f"{g}.text").alias(name) for g, (name, _) in zip(groups, grammar)), *(F.struct(f"{g}.page", f"{g}.line").alias(f"at_{name}") for g, (name, _) in zip(groups, grammar)))


def sections(headed: DataFrame, key: str, names: list[str], drop: Column | None = None) -> DataFrame:
    """One row per section that has body lines: its headings, body and first and last page, in document order."""
    body = headed.where(F.col("level").isNull() & (strip_ws(F.col("text")) != ""))
    if drop is not None:
        body = body.where(~drop)
    entries = F.array_sort(F.collect_list(F.struct("page", "line", strip_ws(F.col("text")).alias("text"))))
    grouped = body.groupBy(key, *names, *(f"at_{n}" for n in names)).agg(entries.alias("_lines"))
    return grouped.select(key, *names, F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("body"), F.element_at("_lines", 1)["page"].alias("first_page"), F.element_at("_lines", -1)["page"].alias("last_page"), F.element_at("_lines", 1)["line"].alias("first_line"))


def header_block(parts: dict[str, Column]) -> Column:
    """``Label: value`` lines, empty levels skipped."""
    return F.concat_ws("\n", *(F.when(F.coalesce(strip_ws(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts.items()))


def split_greedy(text: Column, limit: Column | int) -> Column:
    """Array of pieces of a text above the limit, cut at blank lines only.

    Blocks are stripped and blank ones dropped. The running length counts a block and its two newlines, but only the block
    itself after a cut; a single block above the limit stays whole, so the limit is a target.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    blocks = F.filter(F.transform(F.split(text, "\n\n"), strip_ws), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("len"))

    def step(a: Column, b: Column) -> Column:
        cut = a["cur"].isNotNull() & (a["len"] + F.length(b) + 2 > limit)
        pieces = F.when(cut, F.concat(a["pieces"], F.array(a["cur"]))).otherwise(a["pieces"])
        cur = F.when(cut | a["cur"].isNull(), b).otherwise(F.concat(a["cur"], F.lit("\n\n"), b))
        return F.struct(pieces.alias("pieces"), cur.alias("cur"), F.when(cut, F.length(b)).otherwise(a["len"] + F.length(b) + 2).alias("len"))

    def finish(a: Column) -> Column:
        return F.when(a["cur"].isNull(), a["pieces"]).otherwise(F.concat(a["pieces"], F.array(a["cur"])))

    cut = F.aggregate(blocks, start, step, finish)
    return F.when(F.length(text) <= limit, F.array(text)).when(F.size(cut) == 0, F.array(text)).otherwise(cut)


def to_chunks(sections_: DataFrame, limit: int = 12000, per_token: float = 4.0) -> DataFrame:
    """Chunks from rows with source_type, document_title, chunk_title, semantic_path, source_path and text.

    A text above the limit is cut into numbered parts: the title names the part only then, the id always carries it.
    """
    pieces = split_greedy(F.col("text"), limit)
    parts = sections_.withColumn("_n", F.length("text") > limit).select(*(c for c in sections_.columns if c != "text"), "_n", F.posexplode(pieces).alias("_i", "text"))
    title = F.when(F.col("_n"), F.concat(F.col("chunk_title"), F.lit(" (part "), (F.col("_i") + 1).cast("string"), F.lit(")"))).otherwise(F.col("chunk_title"))
    path = F.concat(F.col("semantic_path"), F.lit("|"), (F.col("_i") + 1).cast("string"))
    made = parts.withColumns({"chunk_title": title, "chunk_id": chunk_id(F.col("source_type"), F.col("source_path"), path), "text": normal_space(F.col("text"))})
    return made.withColumn("estimated_tokens", token_estimate(F.col("text"), per_token)).drop("_n", "_i")


def chunk_summary(chunks: DataFrame, price_per_million: float = 0.0) -> DataFrame:
    """One row: chunks, chunks by source type and by year (missing ones as ''), tokens and their price."""
    per = chunks.groupBy("source_type", "source_year").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("estimated_tokens").cast("long"), F.lit(0))).alias("tokens"))
    sides = F.array(*(F.struct(F.lit(name).alias("side"), F.coalesce(c.cast("string"), F.lit("")).alias("k")) for name, c in (("source", F.col("source_type")), ("year", F.col("source_year")))))
    counts = per.select("n", "tokens", F.explode(sides).alias("s")).groupBy("s.side", "s.k").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    of = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("k", "n")))))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("side") == "source", F.col(c))), F.lit(0))
    return counts.agg(total("n").alias("n_chunks"), of("source").alias("by_source"), of("year").alias("by_year"), total("tokens").alias("tokens")).withColumn("cost", F.round(F.col("tokens") / 1e6 * price_per_million, 6))


def enabled(chunks: DataFrame, sources: dict[str, bool], years: set[int] | None = None) -> DataFrame:
    """Rows of the enabled source types and, where given, of the years; a filter that reaches the scan. Types that are not
    named are off; rows without a year are of no year."""
    on = [s for s, wanted in sources.items() if wanted]
    out = chunks.where(F.col("source_type").isin(on)) if on else chunks.where(F.lit(False))
    return out if years is None else out.where(F.col("source_year").isin(sorted(years)))


# --- HTML with classed headings

# Fixed value: heading tags that carry a class.
HEADING = r'(?is)<h([1-4]) class="([^"]+)">(.*?)</h\1>'


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, level, class, heading, body): every classed heading and the text up to the next one of any class."""
    from paperloom.functions.text import strip_html

    marked = F.regexp_replace(F.col(html), HEADING, "\x1d$1\x1c$2\x1c$3\x1c")
    parts = F.slice(F.split(marked, "\x1d"), 2, 1_000_000)
    rows = pages.select(key, F.posexplode(parts).alias("ord", "_p")).withColumn("_f", F.split("_p", "\x1c"))
    return rows.select(key, "ord", F.col("_f")[0].cast("int").alias("level"), F.col("_f")[1].alias("class"), strip_html(F.col("_f")[2]).alias("heading"), strip_html(F.array_join(F.slice("_f", 4, 1_000_000), "")).alias("body"))


# --- positions in an outline


def next_boundary(entries: DataFrame, key: str, levels: int = 10) -> DataFrame:
    """Adds ``next_ord``: the first later entry of the same or an outer level, null at the end; levels are 0 to ``levels`` - 1.

    The nearest later entry of each level is a running minimum from the end; the answer is the least of those that are
    no deeper than the entry itself.
    """
    behind = Window.partitionBy(key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = entries.withColumns({f"_n{i}": F.min(F.when(F.col("level") == i, F.col("ord"))).over(behind) for i in range(levels)})
    least = F.least(*(F.when(F.col("level") >= i, F.col(f"_n{i}")) for i in range(levels)))
    return nearest.withColumn("next_ord", least).drop(*(f"_n{i}" for i in range(levels)))


def outline_alias(entries: DataFrame, key: str, levels: int) -> DataFrame:
    """Adds ``alias``: the markers of the enclosing levels and its own, joined by dots, such as I.C.4.A."""
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = entries
    for i in range(levels):
        here = F.max(F.when(F.col("level") == i, F.struct("ord", "marker"))).over(order)
        outer = F.max(F.when(F.col("level") < i, F.col("ord"))).over(order)
        out = out.withColumn(f"_m{i}", F.when((F.col("level") >= i) & (outer.isNull() | (here["ord"] > outer) | (F.lit(i) == 0)), here["marker"]))
    return out.withColumn("alias", F.concat_ws(".", *(f"_m{i}" for i in range(levels)))).drop(*(f"_m{i}" for i in range(levels)))


def title_match(lines: DataFrame, key: str, titles: DataFrame, most: int = 4) -> DataFrame:
    """Where each wanted title stands: the first run of 1 to ``most`` lines whose text is the title, on its page or later.

    ``titles`` has key, title (normalised) and page. Runs are joined to titles by equality, not compared pairwise.
    """
    w = Window.partitionBy(key).orderBy("page", "line").rowsBetween(0, most - 1)
    runs = lines.withColumn("_next", F.collect_list("text").over(w))  # at most ``most`` lines
    spans = runs.select(key, "page", "line", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_next")), lambda n: F.lower(F.array_join(F.slice("_next", 1, n), " ")))).alias("_s", "title")).withColumn("span", F.col("_s") + 1)
    found = titles.withColumnRenamed("page", "_from").join(spans, [key, "title"]).where(F.col("page") >= F.col("_from"))
    return found.groupBy(key, "title", F.col("_from").alias("from_page")).agg(F.min(F.struct("page", "line", "span")).alias("at")).select(key, "title", "from_page", "at.page", "at.line", "at.span")


def merge_citations(blocks: DataFrame, key: str) -> DataFrame:
    """Sections by citation in first-seen order, blocks appended; what the first block says of the section stands."""
    merged = blocks.groupBy(key, "citation").agg(F.min("ord").alias("ord"), F.min_by("heading", "ord").alias("heading"), F.array_sort(F.collect_list(F.struct("ord", "subheading", "text"))).alias("_b"))
    return merged.withColumn("blocks", F.transform("_b", lambda b: F.struct(b["subheading"].alias("subheading"), b["text"].alias("text")))).drop("_b")
