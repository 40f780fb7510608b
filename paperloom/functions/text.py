"""Scalar rules as column functions. Every function takes and returns columns and stays inside generated code."""

from __future__ import annotations

from functools import reduce
from html.entities import html5
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Characters that count as white space at the ends of a text, beyond Java's Unicode class.
_WS = r"[\s\x1c-\x1f]"


def strip_ws(c: Column) -> Column:
    """Both ends stripped of all Unicode white space (``trim`` knows blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)^{_WS}+", ""), rf"(?U){_WS}+$", "")


def blank_to_null(c: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip_ws(c.cast("string")), F.lit(""))


# --- codes


def code_listed(c: Column) -> Column:
    """Codes of change files: stripped, dots dropped, upper case."""
    return F.upper(F.replace(strip_ws(c), F.lit("."), F.lit("")))


def code_stored(c: Column) -> Column:
    """Codes of the diagnosis table: dots dropped, upper case, blanks kept."""
    return F.upper(F.replace(c, F.lit("."), F.lit("")))


def code_scored(c: Column) -> Column:
    """Codes compared in scoring and lookup: letters and digits only, upper case; null gives an empty string."""
    return F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def first_token(c: Column) -> Column:
    """First word of a payload; null if it is blank."""
    return F.nullif(F.regexp_extract(c, r"(?U)^\s*(\S+)", 1), F.lit(""))


def code_list(c: Column, clean: bool = True) -> Column:
    """A list from JSON array text or from text split at comma, newline, semicolon or bar; order and repeats are kept.

    With ``clean`` each entry is reduced to letters and digits, else stripped; empty entries go. Null and blank give an
    empty list. A lone carriage return splits only beside another separator.
    """
    text = strip_ws(F.coalesce(c, F.lit("")))
    parsed = F.from_json(F.when(text.startswith("["), text), "array<string>", {"mode": "PERMISSIVE"})
    usable = parsed.isNotNull() & text.endswith("]")
    pieces = F.when(text.rlike(r"[,\n;|]"), F.split(text, r"[,\n\r;|]")).otherwise(F.array(text))
    one = (lambda x: code_scored(x)) if clean else (lambda x: strip_ws(F.coalesce(x, F.lit(""))))
    return F.filter(F.transform(F.when(usable, parsed).otherwise(pieces), one), lambda x: x != "")


def integer_text(c: Column) -> Column:
    """An integer from text: signed digits only; null, blank, ``null`` and anything else give null."""
    t = strip_ws(c.cast("string"))
    return F.when(t.rlike(r"^[-+]?[0-9]+$"), t.try_cast("int"))


# --- years


def year_bounds(group: Column, offset: Column) -> tuple[Column, Column]:
    """First and last year of a group such as ``2011 - 2013``, moved by an offset; null where there is no year."""
    first = F.nullif(F.regexp_extract(group, r"(\d{4})", 1), F.lit("")).try_cast("int")
    last = F.nullif(F.regexp_extract(group, r".*(\d{4})", 1), F.lit("")).try_cast("int")
    return first + offset, last + offset


# --- white space, markup


def normal_space(c: Column) -> Column:
    """Line ends to newline, runs of blanks and tabs to one blank, three and more newlines to two, ends stripped."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip_ws(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# Entities of the HTML standard by the standard library's table: names with their semicolon, the older ones that need none
# (two to six letters), and what the numbers 128 to 159 stand for.
_NAMED = {n: v for n, v in html5.items() if n.endswith(";")}
_BARE = {n: v for n, v in html5.items() if not n.endswith(";")}
_UPPER = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};)"


def _table(entries: dict[str, str]) -> Column:
    return F.map_from_arrays(F.split(F.lit(" ".join(entries)), " "), F.split(F.lit("\x00".join(entries.values())), "\x00"))


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character for what is none, null for null."""
    good = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(F.concat(F.hex(F.lit(0xD7C0) + F.floor(number / 1024)), F.hex(F.lit(0xDC00) + number % 1024)))
    upper = F.substr(F.lit(_UPPER), number.cast("int") - 127, F.lit(1))
    return F.when(number.between(128, 159), upper).when(good, F.decode(F.unhex(units), "UTF-16BE")).when(number.isNotNull(), F.lit("\ufffd"))


def unescape(c: Column) -> Column:
    """Named and numeric entities as characters, each read once; unknown ones stay."""
    named, old = _table(_NAMED), _table(_BARE)

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, _ENTITY, 1)
        digits = F.regexp_extract(name, r"^#([0-9]+)", 1)
        hexed = F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]+)", 1)
        # more digits than a code point has are no character
        number = F.when(digits != "", F.coalesce(digits.try_cast("long"), F.lit(1 << 40))).when(hexed != "", F.when(F.length(hexed) > 12, F.lit(1 << 40)).otherwise(F.conv(hexed, 16, 10).try_cast("long")))
        whole = F.concat(F.coalesce(F.try_element_at(named, name), _character(number)), F.substr(piece, F.length(name) + 1))
        begun = (F.concat(F.try_element_at(old, F.substring(piece, 1, k)), F.substr(piece, F.lit(k + 1))) for k in range(6, 1, -1))
        return F.coalesce(whole, *begun, F.concat(F.lit("&"), piece))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), read), ""))).otherwise(c)


def normal_space_html(c: Column) -> Column:
    """``normal_space`` of a text whose entities are resolved first."""
    return normal_space(unescape(F.regexp_replace(c, r"\r\n?", "\n")))


def strip_html(c: Column) -> Column:
    """Text of a piece of HTML: comments to a blank, block tags to a newline, other tags to a blank."""
    t = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|p|div|tr|li|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|tr|li|h[1-6])>", "\n")
    return normal_space_html(F.regexp_replace(t, r"<[^>]+>", " "))


def guideline_text(c: Column) -> Column:
    """Curly quotes straightened, runs of blanks and of newlines to one blank, ends stripped."""
    t = F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), r"\r\n?", "\n")
    return strip_ws(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n+", " "))


def one_line(c: Column) -> Column:
    """All white space collapsed to single blanks."""
    return strip_ws(F.regexp_replace(c, rf"(?U){_WS}+", " "))


def nonblank_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != ""))


# --- identifiers


def token_estimate(c: Column, per_token: Column | float = 4.0) -> Column:
    """Estimated tokens of a text: characters by a rate, rounded up, at least one."""
    return F.greatest(F.lit(1), (F.length(c) / per_token + F.lit(0.9999)).cast("int"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def chunk_id(source_type: Column, path: Column, semantic: Column) -> Column:
    """Readable and unique id: a slug of the three parts, cut so that with its digest it has at most 200 characters."""
    raw = F.concat_ws("|", source_type, path, semantic)
    readable = F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "-"), "^-+|-+$", "")
    return F.concat(F.regexp_replace(F.substring(readable, 1, 187), "-+$", ""), F.lit("-"), F.substring(F.sha1(raw.cast("binary")), 1, 12))


def lookup_token(c: Column) -> Column:
    """What two spellings of a citation share: lower-case letters and digits."""
    return F.regexp_replace(F.lower(F.translate(c, "\x00§", "")), "[^a-z0-9]+", "")


# --- citations


# Fixed value: a statute named with its title.
STATUTE = r"(?i)([0-9]+)\s*u\.?s\.?c\.?\s*§*\s*([0-9]+[a-z]*)"


def statute_variants(query: Column) -> Column:
    """Lookup tokens of a statute query, most exact first: as given, without subsections and, where it names a title, the
    full form and the bare section."""
    title, section = (F.nullif(F.regexp_extract(query, STATUTE, i), F.lit("")) for i in (1, 2))
    forms = (query, F.regexp_replace(query, r"\([^)]*\)", ""), F.concat(title, F.lit(" U.S.C. § "), section), section)
    return F.array_distinct(F.filter(F.array(*(lookup_token(F.coalesce(x, F.lit(""))) for x in forms)), lambda x: x != ""))


def is_structured_query(query: Column) -> Column:
    """A query that names a statute, so that a loose match would mislead."""
    return query.rlike(r"(?i)u\.?s\.?c\.?|§")


def is_parent_token(token: Column, query: Column) -> Column:
    """``token`` continues ``query``, and not with a digit: 924c belongs to 924, 9245 does not."""
    return token.startswith(query) & (token != query) & ~F.substr(token, F.length(query) + 1, F.lit(1)).rlike("[0-9]")


def guideline_citation(c: Column) -> Column:
    """Section citation at the start of a heading, such as §2K2.1."""
    return F.nullif(F.regexp_extract(c, r"^\s*(§\s*[0-9][A-Z][0-9]+\.[0-9]+)", 1), F.lit(""))


def title18_citation(c: Column) -> Column:
    """``§ 793. Gathering …`` as ``18 U.S.C. § 793``."""
    section = F.nullif(strip_ws(F.regexp_extract(c, r"\[?§+\s*([^.\]]+)", 1)), F.lit(""))
    return F.concat(F.lit("18 U.S.C. § "), section)


def query_citation(c: Column) -> tuple[Column, Column]:
    """(section, subsection) a query names, such as 2K2.1 and (b)(1); null if none."""
    section = F.nullif(F.upper(F.regexp_extract(c, r"(?i)§?\s*([0-9][A-Z][0-9]+\.[0-9]+)", 1)), F.lit(""))
    sub = F.nullif(F.regexp_extract(c, r"(?i)[0-9][A-Z][0-9]+\.[0-9]+((?:\([A-Za-z0-9]+\))+)", 1), F.lit(""))
    return section, sub


# Numbers written out in chapter headings.
CHAPTER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def chapter_number(c: Column) -> Column:
    """Number of ``CHAPTER TWO`` or ``Chapter 2``."""
    word = F.lower(F.regexp_extract(c, r"(?i)chapter\s+([a-z]+|[0-9]+)", 1))
    table = F.create_map(*chain.from_iterable((F.lit(w), F.lit(i + 1)) for i, w in enumerate(CHAPTER_WORDS)))
    return F.coalesce(F.try_element_at(table, word), word.try_cast("int"))


def heading_prefix(chapter: Column, part: Column, subheading: Column) -> Column:
    """Prefix of the section citations below a subheading, such as 2A1. for Chapter TWO, Part A, ``1. …``; null if a part of
    it is missing."""
    code = F.nullif(F.upper(F.regexp_extract(part, r"(?i)part\s+([a-z0-9]+)", 1)), F.lit(""))
    number = F.nullif(F.regexp_extract(subheading, r"^\s*([0-9]+)\.", 1), F.lit(""))
    return F.concat(chapter_number(chapter).cast("string"), code, number, F.lit("."))


def snippet(text: Column, *needles: Column, before: int = 80, after: int = 260) -> Column:
    """Surroundings of the first needle found, tried in order; else the start of the text."""
    at = F.coalesce(*(F.nullif(F.call_function("locate", n, text), F.lit(0)) for n in needles))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at.isNull(), F.substring(text, 1, after)).otherwise(strip_ws(F.substr(text, start, at + after - start)))


# --- model output


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer: fences dropped, else from the first to the last brace; null if none."""
    t = strip_ws(F.regexp_replace(strip_ws(c), r"^```(?:json|JSON)?\s*|\s*```$", ""))
    inner = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    whole = F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    found = F.when(F.try_parse_json(inner).isNotNull(), inner)
    return F.when(t.startswith("["), None).otherwise(F.coalesce(whole, found))


def flat_content(c: Column) -> Column:
    """Message content as text: a string as it is, a JSON list of strings and {text} objects joined by newlines."""
    items = F.from_json(F.when(strip_ws(c).startswith("["), c), "array<string>")
    text = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.when(~x.startswith("{"), x)))
    return F.when(items.isNull(), c).otherwise(F.array_join(F.filter(text, lambda x: x.isNotNull()), "\n"))


def drop_empty(c: Column, kind: DataType) -> Column:
    """A nested value of a type without its blank strings and what is empty through them; null if nothing is left.

    Strings are stripped; structs keep their fields, as nulls; arrays and maps lose their empty elements.
    """
    if isinstance(kind, StringType):
        return blank_to_null(c)
    if isinstance(kind, StructType):
        fields = [drop_empty(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(reduce(or_, (f.isNotNull() for f in fields)), F.struct(*fields))
    if isinstance(kind, ArrayType):
        kept = F.filter(F.transform(c, lambda x: drop_empty(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, MapType):
        kept = F.map_filter(F.transform_values(c, lambda _, v: drop_empty(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return c


# --- numbers and display


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def hhmmss(seconds: Column) -> Column:
    """A duration as HH:MM:SS; hours may pass two digits; null and negative give 00:00:00."""
    s = F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def bullets(items: Column) -> Column:
    """``- item`` lines."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def numbered_blocks(items: Column, *labels: str, text: str = "text") -> Column:
    """``[i] label=value | label=value`` and the text below, for an array of structs; blocks are parted by a blank line."""

    def block(x: Column, i: Column) -> Column:
        head = F.concat_ws(" | ", *(F.concat(F.lit(f"{n}="), F.coalesce(x[n].cast("string"), F.lit(""))) for n in labels))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), head, F.lit("\n"), F.coalesce(x[text], F.lit("")))

    return F.array_join(F.transform(items, block), "\n\n")


def stale(at: Column, now: Column, minutes: int) -> Column:
    """A claim older than ``minutes``; null and unreadable times are stale, times without offset are UTC."""
    t = F.try_to_timestamp(at.cast("string"))
    return F.coalesce(t < now - F.make_interval(mins=F.lit(minutes)), F.lit(True))


def file_document_id(c: Column) -> Column:
    return F.regexp_replace(c, r"\.docintel\.json$", "")


def docket_of_path(c: Column, root: str = "") -> Column:
    """First component of a path under a root if it is a number, else null."""
    tail = F.regexp_replace(F.regexp_replace(c, r"^(?:dbfs:|file:)", ""), "^" + root.rstrip("/"), "") if root else F.regexp_replace(c, r"^(?:dbfs:|file:)", "")
    return F.nullif(F.regexp_extract(tail, r"^/*([0-9]+)/", 1), F.lit(""))


def volume_path(c: Column) -> Column:
    """One form of a volume path: forward slashes, no scheme, drive or repeated slashes."""
    t = F.translate(c, "\\", "/")
    t = F.regexp_replace(t, r"^(?:dbfs:|file:)", "")
    t = F.regexp_replace(t, r"^[A-Za-z]:(?=/)", "")
    return F.regexp_replace(t, "/{2,}", "/")


def diagnosis_lines(text: Column, title: str, stop: str, most: int = 12) -> Column:
    """Distinct non-blank lines after a section title up to a stop title or a blank line, ``most`` of them."""
    init = F.struct(F.lit(False).alias("on"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        line = strip_ws(x)
        begins = ~a["on"] & ~a["done"] & line.rlike(title)
        rest = strip_ws(F.regexp_replace(line, title, ""))
        ends = a["on"] & (line.rlike(stop) | ((line == "") & (F.size(a["out"]) > 0)))
        take = a["on"] & ~ends & (line != "") & ~F.array_contains(a["out"], line)
        out = F.when(take, F.concat(a["out"], F.array(line))).when(begins & (rest != ""), F.concat(a["out"], F.array(rest))).otherwise(a["out"])
        return F.struct(((a["on"] | begins) & ~ends).alias("on"), (a["done"] | ends).alias("done"), out.alias("out"))

    return F.slice(F.aggregate(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), init, step)["out"], 1, most)
