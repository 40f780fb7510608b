"""Problem 1: personal information inside free text: find it and put typed placeholders in its place.

Method: bootstrapped contextual extraction. One pass over the texts lists candidate spans: runs of digits (also spelled
out), number-and-street spans, capitalised word groups, and addresses of electronic mail, written plainly (seeds: no
other thing has that form) or with words for their signs. A candidate has a shape (the instance node of the graph) and lexical contexts (the pattern nodes: pairs of words before and
behind it). A few entities of unmistakable form are the seeds. Spark scores the bipartite graph of patterns and
instances iteratively: a pattern is as good as the instances it surrounds, an instance as good as the patterns it occurs
in. Patterns of high confidence then admit shapes no seed has.

Names need one step more, as they come in any case and order. The graph of the capitalised candidates yields a lexicon of
given and family names; a second pass finds lexicon words in any spelling, through a Bloom filter sized by their number, and an
exact join removes its false positives.

What is shuffled are (pattern, instance) counts, combined per task first, and candidate spans without their texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.llm.filters import Filter
from paperloom.llm.filters import build as build_filter
from paperloom.session import materialize

#: Rounds of the propagation over the graph.
ROUNDS = 4
#: Belief added to the denominators, so that rare patterns and instances stay modest.
DOUBT = 1.5
#: Belief from which an instance is trusted, as a share of the best belief among those that are no seeds (names: not seeds alone):
#: beliefs grow with the number of occurrences, their order does not. It must have been seen so often.
TRUSTED = {"phone": 0.72, "id_number": 0.62, "address": 0.62, "name": 0.45, "email": 0.45}
LEAST_SEEN = 3
#: Score of the best pattern around an occurrence that a trusted instance still needs, as a share of the same belief, and
#: the score that admits an unknown one.
NEEDED_PATTERN, STRONG_PATTERN = 0.3, 0.8
#: Seeds that a mail address with words for its signs counts as: its form says much, but its words may say something else.
HALF_SEED = 0.5
#: Score from which a given name is trusted.
TRUSTED_GIVEN = 0.33
KINDS = ("name", "email", "phone", "id_number", "address")

# Escapes of JSON strings.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
# Seeds. Forms that nothing else has: national and international phone formats, the social security
# format, street types behind a house number, titles and suffixes of persons, words of firms.
PHONE_SEEDS = ("(d3) d3-d4", "(d3)d3-d4", "+d1 d3 d3 d4", "d1-d3-d3-d4", "d3-d3-d4")
ID_SEEDS = ("d3-d2-d4",)
STREET_SEEDS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "boulevard", "blvd", "drive", "way", "court")
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sr", "sra", "señor", "señora")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
FIRMS = ("llc", "inc", "ltd", "co", "corp", "company", "holdings", "group", "sons", "bank", "union", "clinic", "trucking", "freight", "logistics", "imports", "hauling", "cooperative", "pharmacy", "credit", "savings", "salvage", "consulting", "partners", "services")
PARTICLES = ("de", "la", "del", "da", "di", "van", "von", "der", "den", "bin", "al", "el", "dos", "y")
# Words that do not stand between a house number and its street type.
NO_STREET = ("mile", "miles", "along", "on", "of", "the", "near", "at", "in", "from", "to", "toward", "and", "a", "an", "by", "days", "hours", "months", "levels", "years", "people", "blocks", "off", "down", "for", "with")
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh", "double")

_UNESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([\"\\/bfnrt])|&#(\d{1,6});|&#x([0-9a-fA-F]{1,6});|&amp;|[！-～]|\"")
_SPECIAL = re.compile(r"[\\\"&！-～]")
#: Marks the ends of JSON strings: no span or context reaches across.
CUT = "\x1e"

_EMAIL = regex.compile(
    r"(?<![\w*.+'’-])(?P<local>[\p{L}\p{N}][\p{L}\p{N}._+'’-]*)"
    r"(?:\s?@\s{0,2}|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+(?=[\w-]+\s+dot\s))"
    r"(?P<domain>[\p{L}\p{N}-]+(?:(?:\.|\s+dot\s+|\s*[(\[{]\s*dot\s*[)\]}]\s*)[\p{L}\p{N}-]+)*(?:\.|\s+dot\s+|\s*[(\[{]\s*dot\s*[)\]}]\s*)\p{L}{2,})",
    regex.IGNORECASE,
)
_DIGITS = re.compile(r"(?<![\w/$§#.,:-])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d[\d .–‐-]{4,12}\d(?!\w)|(?<![\w/$§#.,:-])\d{3} / \d{3}[ .-]?\d{4}(?!\w)|(?<![\w/$§#.,:-])(?:[A-Z]{1,2}-?)?\+?\d[\d]*(?:[ .–‐-]\d+)*(?:-[A-Z])?(?![\w/%]|[.,]\d)")
_SPELLED = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})(?:[\s,-]+(?:{'|'.join(DIGIT_WORDS)})){{6,}}\b", re.IGNORECASE)
# what a text must hold for the costlier patterns to be tried
_MAY_MAIL = re.compile(r"@|[(\[{]\s*at\s*[)\]}]|\bdot\b", re.IGNORECASE)
_RUN = re.compile(r"\d[\d .()/–‐+-]{5,}")
_W = r"[\p{Lu}][\p{L}'’.-]*"
_ADDRESS = regex.compile(
    rf"(?<![\w$§#/.,-])(?<!(?i:ext)\. )(?<!(?i:ext) )(?:(?:number|no\.?|nº)\s+)?(?P<no>\d{{1,5}}(?:[ -]?[A-Z])?),?[ \t]+(?P<words>(?:{_W}[ \t]+){{0,3}}{_W})(?=[\s,.;:#)\x1e]|$)"
    rf"|(?P<pre>(?:{_W}[ \t]+){{0,2}}{_W}),?[ \t]+(?P<no2>\d{{1,5}}[A-Za-z]?)\b(?![\w/%$-])"
    rf"|(?<![\w$§#/.,-])(?P<no3>\d{{1,5}}(?:-[A-Za-z])?)[ \t]+(?P<low>(?:(?:[NSEW]\.|\p{{L}}[\p{{L}}'’-]*)[ \t]+){{1,3}}(?:{'|'.join(STREET_SEEDS)}))(?![\w-])"
)
_TITLE = "|".join(TITLES)
_NAME = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}@._/\\-])(?:(?P<title>(?i:{_TITLE}))\.?\s+)?"
    rf"(?P<words>(?:\p{{Lu}}\.\s?){{1,3}}\s?(?:(?i:{'|'.join(PARTICLES)})[\s-]){{0,3}}\p{{Lu}}[\p{{L}}'’-]+(?:-\p{{L}}+)*"
    rf"|(?(title)(?:(?:{'|'.join(PARTICLES)})[ \t]+){{0,3}}|)(?:(?i:al|el)-)?\p{{Lu}}[\p{{L}}'’-]+(?:(?:[ \t]+|[ \t]*\r?\n[ \t]*)(?:[“\"'‘]\p{{Lu}}\p{{L}}+[”\"'’]|\p{{Lu}}\.|(?:{'|'.join(PARTICLES)})\b|(?:al|el)-\p{{Lu}}[\p{{L}}'’-]+|\p{{Lu}}[\p{{L}}'’-]+|&)){{0,6}})"
    rf"(?:,?\s+(?P<suffix>Jr|Sr|II|III|IV)\b\.?)?"
)
_CONTEXT = regex.compile(r"[\p{L}\p{N}'’]+|[:;,.!?\x1e(]")
_LOWER = regex.compile(r"(?<![\p{L}\p{N}])\p{Ll}[\p{L}'’-]*")
_BREAK = regex.compile(r"\x1e|\r?\n\s*\n|(?:\p{L}{4,}|\d|\))[.!?][”\"’]?\s+(?=[^\p{Ll}])")
_WORD = regex.compile(r"\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*")


def plain(text: str) -> tuple[str, list[int], list[int]]:
    """The text with escapes read as the characters they stand for, and where its characters come from.

    Returns the plain text and two parallel lists: positions in it at which an offset starts, and the raw positions they
    map to. Quotes that end JSON strings become ``CUT``.
    """
    if not _SPECIAL.search(text):
        return text, [0], [0]
    json_like = text.lstrip()[:1] in ("{", "[", "`")
    out: list[str] = []
    at, raw_at = [0], [0]
    size = last = 0
    for m in _UNESCAPE.finditer(text):
        if m.group(0) == '"' and not json_like:
            continue
        if m.group(0)[0] == "\\" and not json_like and not m.group(1):
            continue
        piece = text[last : m.start()]
        if m.group(1):
            c = chr(int(m.group(1), 16))
        elif m.group(2):
            c = _ESCAPES[m.group(2)]
        elif m.group(3) or m.group(4):
            code = int(m.group(3)) if m.group(3) else int(m.group(4), 16)
            c = chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group(0)
        elif m.group(0) == "&amp;":
            c = "&"
        elif m.group(0) == '"':
            c = CUT
        else:
            c = chr(ord(m.group(0)) - 0xFEE0)
        if "\ud800" <= c <= "\udfff":
            c = "�"
        elif "！" <= c <= "～":
            c = chr(ord(c) - 0xFEE0)
        out += (piece, c)
        size += len(piece) + len(c)
        last = m.end()
        at.append(size)
        raw_at.append(last)
    out.append(text[last:])
    return "".join(out), at, raw_at


def raw_span(start: int, end: int, at: list[int], raw_at: list[int]) -> tuple[int, int]:
    """Where a span of the plain text stands in the raw one."""

    def back(p: int) -> int:
        k = bisect_right(at, p) - 1
        return raw_at[k] + p - at[k]

    a = back(start)
    k = bisect_right(at, end - 1) - 1  # the last character's own end: an escape is taken whole
    b = raw_at[k + 1] if k + 1 < len(at) and at[k + 1] == end else raw_at[k] + end - at[k]
    return a, max(b, a)


def shape(run: str) -> str:
    """Digits by their number, letters as L, dashes alike."""
    s = re.sub(r"[–‐]", "-", run)
    s = re.sub(r"[A-Z]+", "L", s)
    s = re.sub(r"\s+", " ", s)
    return re.sub(r"\d+", lambda m: f"d{len(m.group(0))}", s)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: pairs of neighbouring words up to six words before it, and the pair behind it.

    Numbers are one word; a context stops at the end of its sentence, paragraph or JSON string.
    """
    left = text[max(0, start - 70) : start]
    k = max((m.end() for m in _BREAK.finditer(left)), default=-1)
    words = _CONTEXT.findall(left[max(k, 0) :].lower())[-7:]
    if start - 70 > 0 and k < 0 and len(words) == 7:
        words = words[1:]  # the first may be cut
    words = ["0" if w[0].isdigit() else w for w in words]
    if len(words) < 2 or k >= 0:
        words = ["^", *words]
    out = [f"L {a} {b}" for a, b in zip(words, words[1:])]
    right = text[end : end + 40]
    k = right.find(CUT)
    behind = ["0" if w[0].isdigit() else w for w in _CONTEXT.findall((right if k < 0 else right[:k]).lower())[:3]]
    behind = [w for w in behind if w not in ".,"][:2]
    if behind and (len(behind) == 2 or len(right) < 40):
        out.append("R " + " ".join(behind))
    return list(dict.fromkeys(out))


def name_parts(words: str) -> tuple[str, str] | None:
    """(given, family) of a word group, lower case; the given name is empty for initials, the family name its head word
    without particles; None if it is no such group."""
    core = [t for t in words.split() if not re.fullmatch(r"[“\"'‘].*[”\"'’]", t)]
    if any(t == "&" for t in core) or not core:
        return None
    initials = re.fullmatch(r"(?:[^\W\d_]\.)+", core[0]) is not None
    rest = core[1:]
    while rest and re.fullmatch(r"[^\W\d_]\.", rest[0]):
        rest = rest[1:]
    if initials and not rest and "." in core[0].rstrip("."):
        return None
    heads = [t for t in rest if t.lower() not in PARTICLES]
    if len(heads) != 1 or heads[0] is not rest[-1]:
        return None
    return ("" if initials else core[0].lower().rstrip("."), heads[0].lower().replace("’", "'"))


def titled_family(words: str) -> str | None:
    """Family name of a word group behind a title, lower case: its last word; None if it holds no name."""
    core = [t for t in words.split() if t.lower() not in PARTICLES and not re.fullmatch(r"[“\"'‘].*[”\"'’]|[^\W\d_]\.", t)]
    if not core or "&" in core or core[-1].lower() in (*FIRMS, *TITLES, *SUFFIXES, *STREET_SEEDS):
        return None
    return core[-1].lower().replace("’", "'")


def in_capitals(text: str, start: int, end: int) -> bool:
    """Whether a span and a word beside it are written in capitals, so that capitals say nothing."""
    if not text[start:end].isupper():
        return False
    before = re.search(r"([^\W\d_]{2,})\W*$", text[max(0, start - 25) : start])
    behind = re.match(r"\W*([^\W\d_]{2,})", text[end : end + 25])
    return any(m is not None and m.group(1).isupper() for m in (before, behind))


def candidates_of(text: str) -> list[tuple[str, str, bool, int, int, list[str]]]:
    """(kind of candidate, instance, seed, start, end, patterns) of a plain text; kinds number, street, name, email."""
    found = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    if _MAY_MAIL.search(text):
        for m in _EMAIL.finditer(text):
            if CUT not in m.group(0) and not m.group("domain").split(".")[-1].isdigit():
                plainly = "@" in m.group(0) and "." in m.group("domain")
                found.append(("email", "a@b.c" if plainly else "a at b.c" if "." in m.group("domain") else "a at b dot c", plainly, m.start(), m.end(), contexts(text, *m.span())))
                taken.append(m.span())
    last = 0
    for run in _RUN.finditer(text):
        if sum(map(str.isdigit, run.group(0))) < 7:
            continue
        # a number begins with two letters, a sign and a bracket at most and ends with a letter: all inside this stretch
        for m in _DIGITS.finditer(text, max(last, run.start() - 5), run.end() + 6):
            if m.start() >= run.end():  # cut off: the next stretch has it whole
                break
            last = m.end()
            n = sum(map(str.isdigit, m.group(0)))
            if 7 <= n <= 13 and free(*m.span()):
                s = shape(m.group(0))
                if s not in ("d4-d2-d2", "d2-d2-d4", "d2.d2.d4", "d1-d2-d4", "d2-d1-d4"):
                    found.append(("number", s, False, m.start(), m.end(), contexts(text, *m.span())))
                    taken.append(m.span())
    low = text.lower()
    if sum(map(low.count, DIGIT_WORDS)) >= 7:
        for m in _SPELLED.finditer(text):
            n = len(re.findall(r"[a-z]+", m.group(0).lower()))
            if free(*m.span()) and n <= 14:
                found.append(("number", f"w{n}", False, m.start(), m.end(), contexts(text, *m.span())))
                taken.append(m.span())
    for m in _ADDRESS.finditer(text):
        if not free(*m.span()):
            continue
        if m.group("words"):
            tokens = list(re.finditer(r"\S+", m.group("words")))
            # a sentence may end inside the group: what follows is another one's first word
            stop = next((i for i, t in enumerate(tokens) if t.group(0).endswith(".") and len(t.group(0)) > 2), len(tokens) - 1)
            tokens = tokens[: stop + 1]
            words = [t.group(0).lower().strip(".,") for t in tokens]
            if (len(words) == 1 and words[0] in STREET_SEEDS) or any(w in NO_STREET for w in words[:-1]):
                continue
            k = next((i for i, w in enumerate(words) if i and w in STREET_SEEDS), len(words) - 1)
            form = f"n {words[k]}"
            end = m.start("words") + tokens[k].end()
            seed = k > 0 and words[k] in STREET_SEEDS
            if seed or not in_capitals(text, m.start(), end):
                found.append(("street", form, seed, m.start(), end, contexts(text, m.start(), end)))
                taken.append((m.start(), end))
        elif m.group("low"):
            if any(w in NO_STREET for w in m.group("low").lower().split()):
                continue
            found.append(("street", f"n {m.group('low').lower().split()[-1]}", True, m.start(), m.end(), contexts(text, m.start(), m.end())))
            taken.append(m.span())
        elif m.group("pre"):
            word = m.group("pre").lower().split()[-1].strip(".")
            if word in NO_STREET or word in PARTICLES or in_capitals(text, m.start(), m.end()):
                continue
            found.append(("street", f"{word} n", False, m.start(), m.end(), contexts(text, m.start(), m.end())))
    for m in _NAME.finditer(text):
        title, suffix, words = m.group("title", "suffix", "words")
        if not title and len(words.split(None, 1)) < 2 or not free(*m.span()):
            continue  # a single word is a name behind a title only
        if words.split()[-1].lower() in SUFFIXES:
            words, suffix = words.rsplit(None, 1)[0] if len(words.split()) > 1 else words, words.split()[-1]
        parts = None if words.split()[0] in PARTICLES else name_parts(words)
        behind = _WORD.match(text[m.end() :].lstrip(" ")[:20])
        firm = text[m.end() : m.end() + 3].lstrip().startswith("&") or (behind is not None and behind.group(0).lower() in FIRMS)
        if "\n" in words.strip() or (words.isupper() and len(words.split()) > 1):
            continue  # two lines may hold two things, and capitals alone say nothing: the lexicon finds such names later
        if parts is None:
            # "miss" and the like in small letters may be another word
            family = titled_family(words) if title and (title[0].isupper() or text[m.end("title")] == ".") and len(words.split()) <= 3 and not firm else None
            if family:
                found.append(("name", family, True, m.start(), m.end(), contexts(text, *m.span())))
            continue
        if firm or parts[1] in FIRMS:
            continue
        nick = re.search(r"\s[“\"'‘]", m.group("words")) is not None
        middle = re.search(r"[^\W\d_]\S+\s+[^\W\d_]\.\s", m.group("words")) is not None
        around = contexts(text, *m.span())
        found.append(("name", parts[1], bool(title or suffix or nick or middle), m.start(), m.end(), [*around, f"G {parts[0]}"] if parts[0] else around))
    return found


FIELDS = ("case_summary", "case_facts")


def long_texts(inputs: DataFrame, id_col: str = "input_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text) of the fields; null and blank texts hold nothing and are left out."""
    stacked = inputs.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))).alias("x"))
    return stacked.select("id", "x.field", "x.text").where(F.length(F.trim("text")) > 0)


def extract(texts: DataFrame) -> DataFrame:
    """First pass: (id, field, kind, instance, seed, start, end, patterns, n); positions are those of the raw text.

    Rows of kind ``lower`` have no position: they count the words written in lower case, combined per task.
    """
    id_type = to_arrow_type(texts.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (id_type, pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64())
        names = ["id", "field", "kind", "instance", "seed", "start", "end", "patterns", "n"]
        lower: Counter = Counter()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def counts() -> pa.RecordBatch:
            rows = [(None, None, "lower", w, False, None, None, [], n) for w, n in lower.items()]
            lower.clear()
            return batch_of(rows)

        for batch in batches:
            rows = []
            for key, field, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text, at, raw_at = plain(raw)
                rest, last = [], 0
                for kind, instance, seed, a, b, patterns in candidates_of(text):
                    if kind == "email":  # its parts are no words
                        rest.append(text[last:a])
                        last = b
                    rows.append((key, field, kind, instance, seed, *raw_span(a, b, at, raw_at), patterns, 1))
                rest.append(text[last:])
                lower.update(filter(str.islower, _LOWER.findall(" ".join(rest))))
            yield batch_of(rows)
            if len(lower) > 200_000:
                yield counts()
        yield counts()

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, field string, kind string, instance string, seed boolean, start int, end int, patterns array<string>, n bigint")


def graph_of_kind() -> F.Column:
    """Graph of the candidates that are in one only."""
    return F.when(F.col("kind") == "street", "address").otherwise(F.col("kind"))


def observations(candidates: DataFrame) -> DataFrame:
    """(obs, graph, instance, patterns, n, seeds, others): alike occurrences with their number, for each graph they are in.

    The graphs of phones and identity numbers share their candidates. An occurrence that is no seed speaks against its
    patterns as long as it is not believed.
    """
    alike = candidates.where("kind <> 'lower'").groupBy("kind", "instance", "seed", F.array_sort("patterns").alias("patterns")).agg(F.count("*").alias("n"))
    i = F.col("instance")
    graphs = F.when(
        F.col("kind") == "number",
        F.array(
            F.struct(F.lit("phone").alias("graph"), i.isin(*PHONE_SEEDS).alias("is_seed"), (~i.isin(*PHONE_SEEDS)).alias("is_other")),
            F.struct(F.lit("id_number").alias("graph"), i.isin(*ID_SEEDS).alias("is_seed"), (~i.isin(*ID_SEEDS)).alias("is_other")),
        ),
    ).otherwise(F.array(F.struct(graph_of_kind().alias("graph"), F.col("seed").alias("is_seed"), (~F.col("seed")).alias("is_other"))))
    rows = alike.select("instance", "patterns", "n", F.explode(graphs).alias("g"))
    return rows.select(F.xxhash64("g.graph", "instance", "patterns", "g.is_seed").alias("obs"), "g.graph", "instance", "patterns", "n", F.when(F.col("g.is_seed"), F.col("n")).when(F.col("g.graph") == "email", F.col("n") * HALF_SEED).otherwise(0).alias("seeds"), F.when(F.col("g.is_other"), F.col("n")).otherwise(0).alias("others"))


def propagate(obs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(graph, pattern, score, support) and (graph, instance, belief).

    A pattern's score is the share of belief in what it surrounds, damped by ``DOUBT``; an occurrence is believed as far
    as its best pattern, an instance as far as its occurrences on average, and at least by its share of seeds.
    """
    obs = materialize(obs, "pii-observations")
    edges = materialize(obs.select("obs", "graph", "instance", "n", "others", F.explode("patterns").alias("pattern")), "pii-edges")
    prior = materialize(obs.groupBy("graph", "instance").agg((F.sum("seeds") / F.sum("n")).alias("prior"), F.sum("n").alias("total")), "pii-priors")
    belief = prior.select("graph", "instance", F.col("prior").alias("belief"))
    patterns = None
    for turn in range(rounds):
        told = edges.join(belief, ["graph", "instance"])
        against = F.sum(F.col("others") * (1 - F.col("belief")))
        patterns = materialize(told.groupBy("graph", "pattern").agg((F.sum(F.col("n") * F.col("belief")) / (F.sum(F.col("n") * F.col("belief")) + against + DOUBT)).alias("score"), F.sum("n").alias("support")), "pii-patterns")
        best = edges.join(patterns, ["graph", "pattern"]).groupBy("obs", "graph", "instance").agg(F.max("score").alias("score"), F.first("n").alias("n"))
        said = best.groupBy("graph", "instance").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + DOUBT)).alias("said"))
        belief = materialize(prior.join(said, ["graph", "instance"], "left").select("graph", "instance", F.greatest("prior", F.coalesce("said", F.lit(0.0))).alias("belief"), "prior", "total"), "pii-beliefs")
        if turn < rounds - 1:
            belief = belief.drop("prior", "total")
    return patterns, belief


# --- names in any spelling

_BEFORE = regex.compile(
    rf"(?:(?<!\p{{L}})(?P<title>{_TITLE})\.?\s+)?(?:(?<![\p{{L}}\p{{N}}@._-])(?:(?P<initials>(?:\p{{L}}\.\s?){{1,3}})|(?P<given>\p{{L}}[\p{{L}}'’-]*)))?"
    rf"(?:\s+[“\"'‘]\p{{L}}+[”\"'’])?(?:\s+\p{{L}}\.){{0,2}}\s*(?:(?<!\p{{L}})(?:{'|'.join(PARTICLES)})\s+){{0,3}}$",
    regex.IGNORECASE,
)
_INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._-])(?:\p{{Lu}}\.\s?){{1,3}}\s*(?:(?:(?i:{'|'.join(PARTICLES)}))\s+){{0,3}}$")
_AFTER = regex.compile(r"[ \t]*,\s+(?:(?P<initials>\p{Lu}\.)|(?P<given>\p{L}[\p{L}'’-]*))")
_OTHER = regex.compile(rf"[ \t]*(?:&|(?:{'|'.join(FIRMS + STREET_SEEDS)})\b)", regex.IGNORECASE)


class _Families(dict):
    """Whether a token may be a family name, asked of the filter once per distinct token."""

    def __init__(self, table: bytes):
        super().__init__()
        self.may_hold = Filter(table).may_hold_text

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        r = self[token] = self.may_hold(token.lower().replace("’", "'"))
        return r


def named(text: str, families: _Families) -> list[tuple[int, int, str, str]]:
    """(start, end, family, given) of names in a plain text whose family name may be known; given is empty where a title or
    initials stand for it."""
    found = []
    mails: list[tuple[int, int]] | None = None
    for m in _WORD.finditer(text):
        if not families[m.group(0)]:
            continue
        if mails is None:
            mails = [x.span() for x in _EMAIL.finditer(text)]
        s, e = m.span()
        if any(a <= s < b for a, b in mails) or text[s - 1 : s] in ("@", "_", ".", "/") or text[e : e + 1] in ("@", "_") or _OTHER.match(text, e, e + 20):
            continue
        family = m.group(0).lower().replace("’", "'")
        cut = max(text.rfind(CUT, 0, s), text.rfind("\n\n", 0, s)) + 1
        words = text[cut:s].rsplit(None, 12)  # more words than the pattern takes
        start = cut + len(words[0]) if len(words) > 12 else cut
        before = _BEFORE.search(text, start, s)
        after = _AFTER.match(text, e, e + 40)
        if before and (before.group("given") or before.group("initials")):
            found.append((before.start("given") if before.group("given") else before.start("initials"), e, family, (before.group("given") or "").lower()))
        initial = _INITIAL.search(text, start, s)
        if initial:
            found.append((initial.start(), e, family, ""))
        if before and before.group("title"):
            found.append((before.start("title"), e, family, ""))
        elif before and before.group("given") and before.group("given").lower() in TITLES:
            found.append((before.start("given"), e, family, ""))
        if after:
            found.append((s, after.end(), family, (after.group("given") or "").lower()))
    return found


_filters: list = [None, None]


def find_names(texts: DataFrame, names: Filter) -> DataFrame:
    """Second pass: (id, field, start, end, family, given) of possible names; positions are those of the raw text."""
    shared = texts.sparkSession.sparkContext.broadcast(names.table)
    key = crc32(names.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _filters[0] != key:
            _filters[:] = [key, _Families(shared.value)]
        for batch in batches:
            rows = []
            for i, field, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text, at, raw_at = plain(raw)
                rows += [(i, field, *raw_span(s, e, at, raw_at), family, given) for s, e, family, given in named(text, _filters[1])]
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "field", "start", "end", "family", "given"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, field string, start int, end int, family string, given string")


# --- the operator


def find_personal(inputs: DataFrame, id_col: str = "input_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, kind, start, end) of the personal items in the fields; a span may be reported in overlapping parts.

    Positions count code points of the stored text, escapes included. Null and blank texts hold nothing; rows delivered
    repeatedly count once per distinct span; masked values are no candidates; extra columns are ignored.
    """
    texts = long_texts(inputs, id_col, fields)
    spans = materialize(extract(texts), "pii-candidates")
    patterns, belief = propagate(observations(spans))
    # the best pattern around each candidate, and what is believed of its shape
    graph_of = F.when(F.col("kind") == "number", F.array(F.lit("phone"), F.lit("id_number"))).otherwise(F.array(graph_of_kind()))
    open_ = spans.where("kind <> 'lower'").select("id", "field", "kind", "instance", "seed", "start", "end", F.explode(graph_of).alias("graph"), F.explode_outer("patterns").alias("pattern"))
    near = open_.join(patterns.select("graph", "pattern", "score"), ["graph", "pattern"], "left").groupBy("id", "field", "start", "end", "graph", "instance", "seed").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("near"), (F.count("pattern") == 0).alias("bare"))
    judged = near.join(belief, ["graph", "instance"])
    mail = F.col("graph") == "email"
    seen = (F.col("total") >= LEAST_SEEN) | mail
    best = {r["graph"]: r["best"] for r in belief.where(seen & (F.col("prior") < F.when(F.col("graph").isin("name", "email"), 0.9).otherwise(0.5))).groupBy("graph").agg(F.max("belief").alias("best")).collect()}  # one number a graph
    share = lambda g, part: F.lit(best.get(g, 1.0 if g == "email" else 2.0) * part)
    level = lambda parts: F.coalesce(*(F.when(F.col("graph") == g, share(g, parts[g])) for g in TRUSTED if g != "name"), F.lit(2.0))
    trust, needed = level(TRUSTED), level(dict.fromkeys(TRUSTED, NEEDED_PATTERN))
    rare = (F.col("total") < LEAST_SEEN) & (F.col("near") >= STRONG_PATTERN) & (F.col("graph") != "name")
    # nothing around a mail address speaks against it
    known = (F.col("belief") >= trust) & seen & ((F.col("near") >= needed) | (mail & F.col("bare")))
    good = judged.where(known | rare | (F.col("seed") & F.col("graph").isin("address", "name", "email")) | F.col("instance").isin(*PHONE_SEEDS) & (F.col("graph") == "phone"))
    # a number is of one kind: the one believed more
    one = good.groupBy("id", "field", "start", "end").agg(F.max_by("graph", F.struct("belief", "near")).alias("kind"))
    # a word that is written small more often than it ends a capitalised group is a word of the language
    small = spans.where("kind = 'lower'").groupBy(F.regexp_replace("instance", "’", "'").alias("instance")).agg(F.sum("n").alias("n_lower"))
    families = materialize(belief.join(small, "instance", "left").where(F.coalesce("n_lower", F.lit(0)) <= F.col("total")).where((F.col("graph") == "name") & (F.col("belief") >= share("name", TRUSTED["name"])) & seen).select(F.col("instance").alias("family")), "pii-families")
    given = patterns.where((F.col("graph") == "name") & F.col("pattern").startswith("G ") & (F.col("score") >= TRUSTED_GIVEN)).select(F.expr("substring(pattern, 3)").alias("given"))
    allowed = given.unionByName(texts.sparkSession.createDataFrame([("",)], "given string"))
    names = find_names(texts, build_filter(families, "family", families.count())).join(families, "family", "left_semi").join(allowed, "given", "left_semi").select("id", "field", F.lit("name").alias("kind"), "start", "end")
    return one.select("id", "field", "kind", "start", "end").unionByName(names).distinct()


def personal_kinds(found: DataFrame) -> DataFrame:
    return found.select("id", "field", "kind").distinct()


def redact(inputs: DataFrame, id_col: str = "input_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id_col`` and the fields with a typed placeholder such as [PHONE] in place of each item, the rest unchanged.

    One row per id (repeated deliveries have the same texts); null texts stay null. Overlapping finds are replaced once,
    by the placeholder of the longest. The finds of a text are no more than its words.
    """
    found = find_personal(inputs, id_col, fields)
    per = found.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    per = per.groupBy("id").agg(*(F.first(F.when(F.col("field") == f, F.col("spans")), ignorenulls=True).alias(f"spans_{f}") for f in fields))
    one = inputs.select(F.col(id_col).alias("id"), *fields).dropDuplicates(["id"])
    source = one.join(per, "id", "left").select("id", *(c for f in fields for c in (f, f"spans_{f}")))

    def fill(text: str | None, spans) -> str | None:
        if text is None or spans is None:
            return text
        out, last, group = [], 0, []

        def close() -> None:
            nonlocal last
            if group:
                a, b = group[0][0], max(x[1] for x in group)
                kind = max(group, key=lambda x: x[1] - x[0])[2]
                out.append(text[last:a] + f"[{kind.upper()}]")
                last = b
                group.clear()

        for s in spans:
            item = (int(s["start"]), int(s["end"]), s["kind"])
            if group and item[0] >= max(x[1] for x in group):
                close()
            group.append(item)
        close()
        return "".join(out) + text[last:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], **{f: [fill(t, s) for t, s in zip(frame[f], frame[f"spans_{f}"])] for f in fields}})

    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{f} string" for f in fields)).withColumnRenamed("id", id_col)
