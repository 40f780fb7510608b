"""Citation matching in tiers and lookups of sections by citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import is_structured_query, lookup_token, query_citation, snippet, statute_variants

# Tiers of a match.
EXACT, PARENT, CONTAINS = 1, 2, 3


def match_statutes(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries for each request (request_id, query), by the first variant of the query that hits, in tiers.

    A variant hits exactly, or as the parent of an entry (the entry goes on, not with a digit), or, for a query that does
    not name a statute, anywhere in the entry. The exact tier is an equi-join; parents are found through the prefixes of the
    entry tokens, also by equality; only loose queries that hit nothing are compared by containment, through shared
    token trigrams (shorter queries: what they have).
    """
    tokens = entries.withColumn("token", lookup_token(F.col("statute_citation")))
    asked = requests.select("request_id", "query", is_structured_query(F.col("query")).alias("structured"), F.posexplode(statute_variants(F.col("query"))).alias("rank", "variant"))
    exact = asked.join(tokens, asked["variant"] == tokens["token"]).select("request_id", F.lit(EXACT).alias("tier"), "rank", "entry_id")
    n = F.length("token")
    prefixes = tokens.select("entry_id", "token", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("_n")).where(F.col("_n") < n)
    prefixes = prefixes.select("entry_id", F.substr("token", F.lit(1), F.col("_n")).alias("prefix"), F.substr("token", F.col("_n") + 1, F.lit(1)).alias("next")).where(~F.col("next").rlike("[0-9]"))
    parent = asked.join(prefixes, asked["variant"] == prefixes["prefix"]).select("request_id", F.lit(PARENT).alias("tier"), "rank", "entry_id")
    starts = F.sequence(F.lit(1), n)
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.substr(F.col("token"), i, k))))
    grams = tokens.where(n > 0).select("entry_id", "token", F.explode(F.array_distinct(pieces)).alias("gram"))
    loose = asked.where(~F.col("structured")).withColumn("gram", F.substring("variant", 1, 3))
    inside = loose.join(grams, "gram").where(F.col("token").contains(F.col("variant"))).select("request_id", F.lit(CONTAINS).alias("tier"), "rank", "entry_id")
    hits = exact.unionByName(parent).unionByName(inside)
    best = hits.groupBy("request_id").agg(F.min(F.struct("tier", "rank")).alias("b")).select("request_id", F.col("b.tier").alias("tier"), F.col("b.rank").alias("rank"))
    return hits.join(best, ["request_id", "tier", "rank"]).select("request_id", "tier", "entry_id").distinct()


def open_sections(sections: DataFrame, requests: DataFrame, year: int | None = None) -> DataFrame:
    """Sections by citation, whichever of its spellings is asked for: blocks and their combined text; ``status`` found or
    not_found."""
    own = sections if year is None else sections.where(F.col("source_year") == year)
    keyed = own.select("*", F.explode(F.array_distinct(F.array(lookup_token(F.col("citation")), lookup_token(F.col("section_heading")), lookup_token(F.col("entry_id"))))).alias("token")).where("token <> ''")
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws("\n", F.nullif(b["subheading"], F.lit("")), b["text"])), "\n\n")
    got = requests.select("request_id", lookup_token(F.col("citation")).alias("token")).join(keyed, "token", "left")
    return got.withColumns({"text": text, "status": F.when(F.col("entry_id").isNull(), "not_found").otherwise("found")}).drop("token")


def lookup_guideline(sections: DataFrame, requests: DataFrame, year: int = 2024) -> DataFrame:
    """The section a free query names, with the subsection, a snippet around it and the length of the whole.

    status: found, not_found, or unsupported_query where the query names no section.
    """
    section, sub = query_citation(F.col("query"))
    asked = requests.withColumns({"citation": section, "subsection": sub})
    opened = open_sections(sections, asked.select("request_id", "citation"), year)
    out = asked.join(opened.select("request_id", "text", "status", "section_heading"), "request_id", "left")
    found = F.coalesce(snippet(F.col("text"), F.concat(F.lit("§"), F.col("citation"), F.coalesce("subsection", F.lit(""))), F.concat(F.col("citation"), F.coalesce("subsection", F.lit(""))), F.concat(F.lit("§"), F.col("citation")), F.col("citation")), F.lit(""))
    return out.withColumns({"status": F.when(F.col("citation").isNull(), "unsupported_query").otherwise(F.coalesce("status", F.lit("not_found"))), "snippet": F.when(F.col("status") == "found", found), "text_length": F.length("text")}).drop("text")


def by_prefix(subheadings: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections under each subheading: those whose citation starts with its prefix. Joined on the prefixes of the citations,
    which are short."""
    n = F.length("citation")
    cut = sections.where(n > 0).select("*", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr("citation", F.lit(1), k))).alias("prefix"))
    return subheadings.join(cut.dropDuplicates(["entry_id", "prefix"]), "prefix")
