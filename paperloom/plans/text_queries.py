"""Texts, chunks, headings and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import citations, hierarchy, manuals, selection
from paperloom.session import table

# Fixed subheadings of the manuals.
SUBHEADINGS = ("Application Notes", "Commentary", "Background", "Historical Note")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return selection.latest(table(spark, d, "chunks_legal"), ["chunk_id"], [F.col("loaded_at").desc_nulls_last(), F.col("estimated_tokens").desc_nulls_last()])


def ws_normalize(spark: SparkSession, d: str) -> DataFrame:
    clean = t.normal_space(F.col("text"))
    return _chunks(spark, d).select("chunk_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<div class='x'><!-- skip\nme --><h2>"), F.coalesce("source", F.lit("")), F.lit("</h2><p>A&amp;B &lt;"), F.col("doc_id").cast("string"), F.lit("&gt;&nbsp;<b>bold</b><br/>end</p></div>"))
    return table(spark, d, "documents").select("doc_id", t.strip_html(html).alias("text"))


def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.nonblank_lines(F.col("text")).alias("n"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("text is not null").select("chunk_id", t.token_estimate(F.col("text")).alias("tokens"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", t.chunk_id(F.coalesce("source_type", F.lit("")), F.coalesce("source_path", F.lit("")), F.coalesce("semantic_path", F.lit(""))).alias("made"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", t.slug(F.coalesce("chunk_title", F.lit(""))).alias("slug"), t.lookup_token(F.coalesce("citation", F.lit(""))).alias("token"))


def citations_found(spark: SparkSession, d: str) -> DataFrame:
    section, sub = t.query_citation(F.col("chunk_title"))
    return _chunks(spark, d).select("chunk_id", t.guideline_citation(F.col("chunk_title")).alias("heading"), section.alias("section"), sub.alias("subsection"), t.chapter_number(F.col("semantic_path")).alias("chapter"))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts of manual chunks cut at their own subheadings; lines before the first belong to none."""
    rows = _chunks(spark, d).where("text is not null").select("chunk_id", "text")
    lines = hierarchy.lines_of(rows, "chunk_id", "text")
    headed = hierarchy.with_headings(lines, "chunk_id", [("subheading", F.trim("text").isin(*SUBHEADINGS))])
    made = hierarchy.sections(headed, "chunk_id", ["subheading"])
    return made.select("chunk_id", "subheading", "first_line", F.length("body").alias("n"), F.md5("body").alias("digest"))


def split_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("text is not null").select("chunk_id", F.posexplode(hierarchy.split_greedy(F.col("text"), 2000)).alias("i", "piece"))
    return rows.select("chunk_id", "i", F.length("piece").alias("n"))


def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    made = hierarchy.chunk_summary(_chunks(spark, d), 0.13)
    return made.select("n_chunks", F.array_join(F.transform(F.array_sort(F.map_entries("by_source")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("by_source"), "tokens", "cost")


def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    return selection.cap_per_group(_chunks(spark, d).select("chunk_id", "source_type"), ["source_type"], [F.col("chunk_id")], 50)


def rechunked(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("text is not null").select("source_type", "document_title", "chunk_title", F.col("chunk_id").alias("semantic_path"), "source_path", "text")
    return hierarchy.to_chunks(rows, 9000).select("chunk_id", "chunk_title", "estimated_tokens", F.length("text").alias("n"))


def statute_tiers(spark: SparkSession, d: str) -> DataFrame:
    entries = _chunks(spark, d).where("citation is not null").groupBy("citation").agg(F.min("chunk_id").alias("entry_id")).withColumnRenamed("citation", "statute_citation")
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("18 U.S.C. § "), (100 + F.col("s_suppkey") * 7).cast("string"), F.lit("(a)"))).when(F.col("s_suppkey") % 3 == 1, (100 + F.col("s_suppkey")).cast("string")).otherwise(F.concat(F.lit(""), (F.col("s_suppkey") * 11).cast("string"))).alias("query"))
    return citations.match_statutes(asked, entries)


def next_boundary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ord")).agg((F.min("l_partkey") % 3).cast("int").alias("level"))
    return hierarchy.next_boundary(rows, "l_orderkey").select("l_orderkey", "ord", "level", "next_ord")


def outline_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ord")).agg((F.min("l_partkey") % 3).cast("int").alias("level")).withColumn("marker", F.chr(64 + F.col("ord")))
    return hierarchy.outline_alias(rows, "l_orderkey", 3).select("l_orderkey", "ord", "alias")


def title_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("text is not null").select("chunk_id", "text")
    lines = hierarchy.lines_of(rows, "chunk_id", "text").where(F.trim("text") != "")
    titles = rows.select("chunk_id", F.explode(F.array(*(F.lit(x.lower()) for x in SUBHEADINGS))).alias("title"), F.lit(1).alias("page"))
    return hierarchy.title_match(lines, "chunk_id", titles).select("chunk_id", "title", "line", "span")


def snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("text is not null")
    return rows.select("chunk_id", F.md5(t.snippet(F.col("text"), F.lit("offense level"), F.lit("paragraph"))).alias("digest"))


def title18_html(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as statute HTML, one page each, and parsed back into sections."""
    rows = _chunks(spark, d).where("text is not null and chunk_title is not null")
    html = F.concat(F.lit('<h3 class="chapter-head">'), F.split("semantic_path", " > ")[0], F.lit('</h3><h4 class="section-head">'), F.col("chunk_title"), F.lit("</h4>"), F.col("text"))
    made = manuals.title18_sections(rows.select(F.col("chunk_id").alias("source_path"), html.alias("html")))
    return made.select(F.col("source_path").alias("chunk_id"), "chapter_heading", "heading", F.md5("body").alias("digest"))


def ussg_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts read as pages of their files and cut into sections by the manual's grammar."""
    rows = _chunks(spark, d).where("text is not null")
    pages = rows.select("source_path", F.col("chunk_id").alias("page"), F.regexp_replace("text", r"(?m)^Section: ", "").alias("text"))
    return manuals.ussg_chunks(pages, 2018).select("chunk_id", "citation", "estimated_tokens")


def statute_entries(spark: SparkSession, d: str) -> DataFrame:
    """A statutory index written from the chunks' citations, one page a file, and read back."""
    rows = _chunks(spark, d).where("citation is not null")
    line = F.concat("citation", F.lit("\n"), F.coalesce(F.regexp_extract("chunk_title", r"^§(\S+)", 1), F.lit("")))
    page = rows.groupBy("source_path").agg(F.concat(F.lit("APPENDIX A\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("text")).withColumn("page", F.lit(1))
    return manuals.appendix_entries(page, 2018).select("source_path", "statute_citation", F.array_join("guideline_sections", ",").alias("sections"))


QUERIES = {f.__name__: f for f in (ws_normalize, html_strip, nonblank_lines, token_estimates, chunk_ids, slugs, citations_found, heading_sections, split_greedy, chunk_summary, per_source_cap, rechunked, statute_tiers, next_boundary, outline_alias, title_match, snippets, title18_html, ussg_pages, statute_entries)}

_C = "c AS (SELECT * FROM chunks_legal QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, estimated_tokens DESC NULLS LAST) = 1)"
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0b]+', ''), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0b]+$', '')"
_SPACE = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))
_LINES = r"l AS (SELECT chunk_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS line FROM c WHERE text IS NOT NULL)"
_HEADS = "('Application Notes', 'Commentary', 'Background', 'Historical Note')"
_RANKED = "o AS (SELECT l_orderkey, l_linenumber AS ord, CAST(min(l_partkey) % 3 AS INT) AS level FROM lineitem GROUP BY ALL)"
_PIECES = rf"""blocks AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS i, x FROM (SELECT chunk_id, k, {_STRIP.format('u')} AS x FROM (SELECT chunk_id, unnest(string_split(text, chr(10) || chr(10))) AS u, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM c WHERE length(text) > @LIMIT)) WHERE x <> ''),
 walk(chunk_id, i, piece, filled) AS (SELECT chunk_id, i, CAST(0 AS BIGINT), length(x) + 2 FROM blocks WHERE i = 1
  UNION ALL SELECT b.chunk_id, b.i, CASE WHEN filled + length(b.x) + 2 > @LIMIT THEN piece + 1 ELSE piece END, CASE WHEN filled + length(b.x) + 2 > @LIMIT THEN length(b.x) ELSE filled + length(b.x) + 2 END FROM walk w JOIN blocks b ON b.chunk_id = w.chunk_id AND b.i = w.i + 1),
 pieces AS (SELECT chunk_id, piece, string_agg(x, chr(10) || chr(10) ORDER BY i) AS x, true AS long FROM walk JOIN blocks USING (chunk_id, i) GROUP BY ALL
  UNION ALL SELECT chunk_id, 0, text, length(text) > @LIMIT FROM c WHERE text IS NOT NULL AND (length(text) <= @LIMIT OR chunk_id NOT IN (SELECT chunk_id FROM blocks)))"""
ORACLES = {
    "title18_html": f"WITH {_C} SELECT chunk_id, {_STRIP.format("split_part(semantic_path, ' > ', 1)")} AS chapter_heading, {_STRIP.format('chunk_title')} AS heading, md5({_SPACE}) AS digest FROM c WHERE text IS NOT NULL AND chunk_title IS NOT NULL AND {_SPACE} <> ''",
    "statute_entries": rf"WITH {_C} SELECT DISTINCT source_path, citation AS statute_citation, regexp_extract(chunk_title, '^§([0-9][A-Z][0-9]+\.[0-9]+)', 1) AS sections FROM c WHERE regexp_matches(citation, '^[0-9]+ U\.S\.C\. §+ .+$') AND regexp_matches(chunk_title, '^§[0-9][A-Z][0-9]+\.[0-9]+\b')",
    "ws_normalize": f"WITH {_C} SELECT chunk_id, length({_SPACE}) AS n, md5({_SPACE}) AS digest FROM c",
    "html_strip": "SELECT doc_id, ltrim(coalesce(source, '') || chr(10) || chr(10) || 'A&B <' || doc_id || '>' || chr(160) || ' bold ' || chr(10) || 'end', chr(10)) AS text FROM documents",
    "nonblank_lines": r"SELECT doc_id, len(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents WHERE text IS NOT NULL",
    "token_estimates": f"WITH {_C} SELECT chunk_id, greatest(1, CAST(floor(length(text) / 4.0 + 0.9999) AS INT)) AS tokens FROM c WHERE text IS NOT NULL",
    "chunk_ids": f"WITH {_C}, r AS (SELECT chunk_id, concat_ws('|', coalesce(source_type, ''), coalesce(source_path, ''), coalesce(semantic_path, '')) AS raw FROM c) SELECT chunk_id, regexp_replace(substr(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 187), '-+$', '') || '-' || substr(sha1(raw), 1, 12) AS made FROM r",
    "slugs": f"WITH {_C} SELECT chunk_id, regexp_replace(regexp_replace(lower(coalesce(chunk_title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(replace(coalesce(citation, ''), '§', '')), '[^a-z0-9]+', '', 'g') AS token FROM c",
    "citations_found": rf"WITH {_C} SELECT chunk_id, nullif(regexp_extract(chunk_title, '^\s*(§\s*[0-9][A-Z][0-9]+\.[0-9]+)', 1), '') AS heading, nullif(upper(regexp_extract(chunk_title, '(?i)§?\s*([0-9][A-Z][0-9]+\.[0-9]+)', 1)), '') AS section, nullif(regexp_extract(chunk_title, '(?i)[0-9][A-Z][0-9]+\.[0-9]+((?:\([A-Za-z0-9]+\))+)', 1), '') AS subsection, TRY_CAST(regexp_extract(semantic_path, '(?i)chapter\s+([0-9]+)', 1) AS INT) AS chapter FROM c",
    "heading_sections": rf"""WITH {_C}, {_LINES}, h AS (SELECT chunk_id, line, x, trim(x) IN {_HEADS} AS is_head, max(CASE WHEN trim(x) IN {_HEADS} THEN line END) OVER (PARTITION BY chunk_id ORDER BY line) AS at FROM l)
 SELECT b.chunk_id, any_value(k.x) AS subheading, min(b.line) AS first_line, length(string_agg({_STRIP.format('b.x')}, chr(10) ORDER BY b.line)) AS n, md5(string_agg({_STRIP.format('b.x')}, chr(10) ORDER BY b.line)) AS digest
 FROM h b LEFT JOIN h k ON k.chunk_id = b.chunk_id AND k.line = b.at WHERE NOT b.is_head AND {_STRIP.format('b.x')} <> '' GROUP BY b.chunk_id, b.at""",
    "chunk_summary": f"WITH {_C}, p AS (SELECT coalesce(source_type, '') AS k, count(*) AS n, sum(coalesce(estimated_tokens, 0)) AS tok FROM c GROUP BY source_type) SELECT CAST(sum(n) AS BIGINT) AS n_chunks, string_agg(k || '=' || n, ';' ORDER BY k) AS by_source, CAST(sum(tok) AS BIGINT) AS tokens, round(sum(tok) / 1e6 * 0.13, 6) AS cost FROM p",
    "per_source_cap": f"WITH {_C} SELECT chunk_id, source_type FROM c QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY chunk_id) <= 50",
    "next_boundary": f"WITH {_RANKED} SELECT a.l_orderkey, a.ord, a.level, min(b.ord) AS next_ord FROM o a LEFT JOIN o b ON b.l_orderkey = a.l_orderkey AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL",
    "outline_alias": f"""WITH {_RANKED}, m AS (SELECT a.l_orderkey, a.ord, b.level, max(b.ord) AS pos FROM o a JOIN o b ON b.l_orderkey = a.l_orderkey AND b.ord <= a.ord AND b.level <= a.level GROUP BY ALL)
 SELECT l_orderkey, ord, string_agg(chr(CAST(64 + pos AS INT)), '.' ORDER BY level) AS alias FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.l_orderkey = x.l_orderkey AND y.ord = x.ord AND y.level < x.level AND y.pos > x.pos) GROUP BY ALL""",
    "title_match": f"""WITH {_C}, {_LINES}, q AS (SELECT chunk_id, line, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3 FROM l WHERE trim(x) <> '' WINDOW w AS (PARTITION BY chunk_id ORDER BY line)),
 s AS (SELECT chunk_id, line, 1 AS span, lower(x) AS title FROM q UNION ALL SELECT chunk_id, line, 2, lower(x || ' ' || x1) FROM q UNION ALL SELECT chunk_id, line, 3, lower(x || ' ' || x1 || ' ' || x2) FROM q UNION ALL SELECT chunk_id, line, 4, lower(x || ' ' || x1 || ' ' || x2 || ' ' || x3) FROM q)
 SELECT chunk_id, title, line, span FROM s WHERE title IN ('application notes', 'commentary', 'background', 'historical note') QUALIFY row_number() OVER (PARTITION BY chunk_id, title ORDER BY line, span) = 1""",
    "snippets": f"""WITH {_C}, p AS (SELECT chunk_id, text, coalesce(nullif(strpos(text, 'offense level'), 0), nullif(strpos(text, 'paragraph'), 0)) AS pos FROM c WHERE text IS NOT NULL)
 SELECT chunk_id, md5(CASE WHEN pos IS NULL THEN substr(text, 1, 260) ELSE {_STRIP.format('substr(text, greatest(1, pos - 80), pos + 260 - greatest(1, pos - 80))')} END) AS digest FROM p""",
    "statute_tiers": f"""WITH {_C}, e AS (SELECT min(chunk_id) AS entry_id, regexp_replace(lower(replace(citation, '§', '')), '[^a-z0-9]+', '', 'g') AS token FROM c WHERE citation IS NOT NULL GROUP BY citation),
 v AS (SELECT s_suppkey AS request_id, r, k, s_suppkey % 3 = 0 AS structured FROM supplier, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['18usc' || (100 + s_suppkey * 7) || 'a', '18usc' || (100 + s_suppkey * 7), CAST(100 + s_suppkey * 7 AS VARCHAR)] WHEN s_suppkey % 3 = 1 THEN [CAST(100 + s_suppkey AS VARCHAR)] ELSE [CAST(s_suppkey * 11 AS VARCHAR)] END) AS k, unnest([1, 2, 3]) AS r) WHERE k IS NOT NULL),
 hit AS (SELECT request_id, r, entry_id, CASE WHEN token = k THEN 1 WHEN starts_with(token, k) AND NOT regexp_full_match(substr(token, length(k) + 1, 1), '[0-9]') THEN 2 WHEN NOT structured AND contains(token, k) THEN 3 END AS tier FROM v, e),
 best AS (SELECT request_id, min((tier, r)) AS b FROM hit WHERE tier IS NOT NULL GROUP BY 1)
 SELECT DISTINCT hit.request_id, hit.tier, entry_id FROM hit JOIN best ON best.request_id = hit.request_id AND (hit.tier, hit.r) = best.b""",
    "split_greedy": f"WITH RECURSIVE {_C}, {_PIECES.replace("@LIMIT", "2000")} SELECT chunk_id, CAST(piece AS INT) AS i, length(x) AS n FROM pieces",
    "rechunked": f"""WITH RECURSIVE {_C}, {_PIECES.replace("@LIMIT", "9000")}, m AS (SELECT p.chunk_id AS source_chunk, piece + 1 AS part, long, c.chunk_title AS t, concat_ws('|', c.source_type, c.source_path, p.chunk_id || '|' || (piece + 1)) AS raw, {_SPACE.replace("text", "x")} AS y FROM pieces p JOIN c USING (chunk_id))
 SELECT regexp_replace(substr(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 187), '-+$', '') || '-' || substr(sha1(raw), 1, 12) AS chunk_id, CASE WHEN long THEN t || ' (part ' || part || ')' ELSE t END AS chunk_title, CAST(greatest(1, floor(length(y) / 4.0 + 0.9999)) AS INT) AS estimated_tokens, length(y) AS n FROM m""",
}
