"""Problem 3: find and repair the noise in text read from scanned pages.

Method: noisy-channel correction. The corpus itself gives the language model (counts of words and of word pairs over all
texts) and the channel (how often a character is read as another, estimated from rare words that a known confusion turns
into frequent ones). A word whose count is explained by misreadings of a more frequent word is suspicious; for each line
the words actually meant are decoded by Viterbi over the candidates of its suspicious words. A word that is not
suspicious has one candidate, so a line falls into independent runs of suspicious words between certain ones, which is
where the decoding is done.

Layout noise is found beside it: page-number lines by their form; running headers as line templates that crowd into few
files, where a heading of the manual would spread over all, and damaged copies of them by edit distance; divided words
by comparing how often the corpus writes the joined and the hyphenated form.

Scale: two passes over the texts, both without a shuffle of texts. What is shuffled are word and pair counts, combined
per task first, candidate lines and suspicious words. Workers get Bloom filters sized by the vocabulary, of at most 32 MB
(a larger vocabulary is walked part by part), and the channel table, whose size is that of the inventory of confusions;
everything else is joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.filters import Filter, parts_for, prefixes
from paperloom.llm.filters import build as build_filter
from paperloom.session import default_partitions, materialize

# File types of scanned pages.
SCANNED = r"(?i)\.(pdf|tiff?|jpe?g|png|djvu)\s*$"
# Characters a scanner leaves at a divided line end.
HYPHENS = "-‐‑¬­"
# Confusions of optical character recognition, (meant, read), lower case.
CONFUSIONS = [
    ("a", "á"), ("a", "à"), ("a", "o"), ("b", "6"), ("b", "8"), ("b", "h"), ("c", "e"), ("c", "("), ("d", "cl"), ("e", "c"), ("e", "é"), ("f", "t"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("g", "9"), ("g", "q"), ("h", "b"), ("h", "li"),
    ("i", "1"), ("i", "l"), ("i", "|"), ("i", "í"), ("i", "!"), ("l", "1"), ("l", "i"), ("l", "|"), ("l", "!"), ("m", "rn"), ("m", "nn"), ("m", "iii"), ("n", "ri"), ("n", "u"), ("n", "ii"), ("o", "0"), ("o", "ó"), ("o", "c"), ("q", "9"),
    ("rn", "m"), ("s", "5"), ("s", "$"), ("t", "f"), ("t", "+"), ("t", "7"), ("u", "n"), ("u", "ii"), ("u", "v"), ("v", "u"), ("v", "y"), ("w", "vv"), ("y", "v"), ("z", "2"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ri", "n"),
]
#: A confusion is used if it explains at least this share of its character's occurrences.
LEAST_RATE = 2e-5
#: A misread word shows this share of its confusable characters misread at most.
MOST_MISREAD = 0.5
#: Counts of misread words may pass what the channel expects so many times.
TOLERANCE = 10.0
#: A word is suspicious if misreadings, so tolerated, explain at least this share of its count.
EXPLAINED = 0.5
#: Texts that were not scanned hold no misreadings: at most this share of a suspicious word's count is theirs.
CLEAN = 0.02
#: Distinct entries a task collects before it hands them on.
FLUSH = 400_000
#: Largest share of a header's characters in which a damaged copy in its file may differ, and the same for one in a file that
#: shows it damaged only; characters above which the damage grows no more, and below which a header is one of its own files.
DAMAGE, DAMAGE_ELSEWHERE, DAMAGE_UP_TO, SHORT_HEADER = 0.2, 0.1, 100, 9
#: How many times rarer than its header a repeated damaged copy is.
RARER = 30
#: Pairs of a file's templates and headers that are compared directly; those of a busier file meet by pieces.
PAIRS_OF_FILE = 10_000
#: How much more a line template must crowd into files than chance would have it.
CROWDED = 1.5
#: Share of a template's copies that must interrupt a sentence which reads on behind them.
INTERRUPTS = 0.3
#: Copies below which a template proves nothing by itself.
LEAST_COPIES = 3

_LINES = re.compile(r"\r\n|\n|\r")
_DIVISION = re.compile(rf"[{HYPHENS}][ \t]*[\r\n]")
_META = re.compile(r"\s*(?:Document|Chapter|Part|Section):\s")
_LOWRUN = re.compile(r"(?<![\w'’-])[a-zß-öø-ÿ]{4,}[ ,;]{1,3}[a-zß-öø-ÿ]{4,}|(?<![\w'’-])[a-zß-öø-ÿ]{2,}[ ,;]{1,3}[a-zß-öø-ÿ]{2,}[ ,;]{1,3}[a-zß-öø-ÿ]{2,}")
_LONG = re.compile(r"[^\W\d_]{4,}")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = r"(?=[0-9lIiO|o]*[0-9l])[0-9lIiO|o]{1,5}"
_PAGE = re.compile(rf"[\s\-–—~*|\[(]*(?:(?:page|pagina|página|seite|pg|p)\.?\s*)?{_NUMBER}(?:\s*(?:of|/|de|von)\s*{_NUMBER})?[\s\-–—~*|\])]*", re.IGNORECASE)
_ROMAN = re.compile(r"[\s\-–—~*|\[(]*(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})[\s\-–—~*|\])]*", re.IGNORECASE)
_EDGE = ".,;:()[]{}\"'“”‘’«»!?…*"
_WORDLIKE = re.compile(r"[^\W\d_][^\s]*[^\W\d_]")


def file_of(path: Column) -> Column:
    """A file by its last three path components, whatever separators and prefixes its path has."""
    return F.regexp_extract(F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+", "/"), r"((?:[^/]+/){0,2}[^/]+)$", 1)


def is_page_number(line: str) -> bool:
    """A line that holds a page number and nothing else, with its usual decoration; some digits may be misread."""
    s = line.strip()
    return 0 < len(s) <= 24 and not s.endswith(".") and (_PAGE.fullmatch(s) is not None or _ROMAN.fullmatch(s) is not None)


def is_header_like(line: str) -> bool:
    """A line without lower-case words in a row, half of whose longer words are capitalised: a header, stamp, heading or
    the like, even if a letter of it is misread."""
    s = line.strip()
    if len(s) <= 3 or _LOWRUN.search(s) or _META.match(s) or len(_LETTER.findall(s)) < 4:
        return False
    words = _LONG.findall(s)
    capitals = sum(not w[0].islower() for w in words)
    return 2 * capitals >= len(words) and (capitals > 0 or s[0].isupper())


def template(line: str) -> str:
    """What a header repeats: lower case, numbers as #, single blanks."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", line.strip().lower()))


def bare(token: str) -> str:
    """A token as the language model counts it; numbers are one word, and so are codes, which have more digits than letters."""
    w = token.strip(_EDGE).lower()
    digits = sum(map(str.isdigit, w))
    if not digits:
        return w
    letters = len(_LETTER.findall(w))
    return "#" if not letters else w if letters >= digits and "§" not in w else "#code"


class _Bare(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        w = self[token] = bare(token)
        return w


_bare = _Bare()


def divided_words(lines: list[str]) -> list[tuple[int, int, str, str]]:
    """(line, line of the rest, left part, right part) of words whose line ends in a hyphen and that go on below."""
    found = []
    for i, line in enumerate(lines):
        s = line.rstrip()
        if not s or s[-1] not in HYPHENS or len(s) < 2 or is_page_number(s):
            continue
        left = s[:-1].rsplit(None, 1)[-1] if s[:-1].strip() and not s[-2].isspace() else ""
        left = left.lstrip(_EDGE + "—–/")
        if not left or not _LETTER.search(left[-1]) and not left[-1].isalnum() and left[-1] != "|":
            continue
        for j in range(i + 1, len(lines)):  # up to the first line of running text
            t = lines[j].strip()
            if not t or is_page_number(t) or is_header_like(t) or _META.match(t):
                continue
            right = t.split(None, 1)[0]
            body = right.rstrip(_EDGE + "—–/")
            if body and (body[0].islower() or body[0].isdigit() or body[0] in "|ﬁﬂ") and _LETTER.search(left):
                found.append((i, j, left, body))
            break
    return found


def running_words(lines: list[str], divided: list[tuple[int, int, str, str]]) -> list[tuple[int, str]]:
    """(line, word) of a scanned text in order; divided words are whole and stand on their first line."""
    starts = {i: left + right for i, _, left, right in divided}
    rests = {j for _, j, _, _ in divided}
    out = []
    for i, line in enumerate(lines):
        if _META.match(line):
            continue
        words = line.split()
        if i in rests and words:
            words = words[1:]
        if i in starts and words:
            words[-1] = starts[i]
        out += [(i, w) for w in words]
    return out


def interrupted(lines: list[str], i: int) -> str | None:
    """What line ``i`` stands between, if a sentence seems to go on behind it: last word above, first below, its own first."""
    above = next((t for t in (lines[k].strip() for k in range(i - 1, -1, -1)) if t and not is_page_number(t)), "")
    below = next((t for t in (lines[k].strip() for k in range(i + 1, len(lines))) if t and not is_page_number(t)), "")
    if not above or not below or above[-1] in ".!?:;" or not below[0].islower() or _META.match(above):
        return None
    if above[-1] in HYPHENS:
        return "-"
    return "\t".join((_bare[above.split()[-1]], _bare[below.split()[0]], _bare[lines[i].split()[0]]))


def _spill(counter: Counter, kind: str) -> Iterator[tuple[str, str, str, int]]:
    if kind != "b":
        for w, n in counter.items():
            yield kind, w, "", n
    else:
        for (a, b), n in counter.items():
            yield kind, a, b, n


def count_pass(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First pass: (kind, a, b, n) counts of all texts (u words, c words of texts not scanned, b pairs), and the lines and
    divided words of scanned ones (chunk_id, file, kind line, page or divided, line, rest, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, clean, pairs = Counter(), Counter(), Counter()
        names = ["chunk_id", "file", "kind", "line", "rest", "a", "b", "n"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def counts() -> Iterator[pa.RecordBatch]:
            rows = []
            for counter, kind in ((words, "u"), (clean, "c"), (pairs, "b")):
                for k, a, b, n in _spill(counter, kind):
                    rows.append((None, None, k, None, None, a, b, n))
                    if len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows = []
                counter.clear()
            yield batch_of(rows)

        for batch in batches:
            rows = []
            for chunk, file, scanned, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                tokens = list(map(_bare.__getitem__, text.split()))
                if scanned:
                    lines = _LINES.split(text)
                    divided = divided_words(lines) if _DIVISION.search(text) else []
                    for i, j, left, right in divided:
                        rows.append((chunk, file, "divided", i, j, left.lower(), right.lower(), 1))
                        words[_bare[right]] -= 1
                    for i, line in enumerate(lines):
                        if not line:
                            continue
                        if is_page_number(line):
                            rows.append((chunk, file, "page", i, None, None, None, 1))
                        elif is_header_like(line):
                            rows.append((chunk, file, "line", i, None, template(line), interrupted(lines, i), 1))
                else:
                    clean.update(tokens)
                words.update(tokens)
                pairs.update(zip(tokens, tokens[1:]))
            yield batch_of(rows)
            if len(words) + len(pairs) > FLUSH:
                yield from counts()
        yield from counts()

    source = chunks.select("chunk_id", "file", "scanned", "text")
    out = materialize(source.mapInArrow(run, "chunk_id string, file string, kind string, line int, rest int, a string, b string, n bigint"), "scan-pass")
    counts = out.where("kind in ('u', 'c', 'b')").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where("n > 0 and a <> ''")
    return materialize(counts, "scan-counts"), out.where("kind not in ('u', 'c', 'b')").drop("n")


# --- running headers


def header_lines(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk_id, line) of running headers and their damaged copies.

    A template is a header if it crowds into few files, or if its copies interrupt sentences: the words around it are
    a pair that the corpus writes more often than the pair of the word above and the line's own first word.

    A template counts once per chunk, so that a list of headings inside one chunk is no repetition. The number of files
    a template would reach if its copies fell on chunks at random follows from the sizes of the files (a histogram of at
    most 64 classes); a header reaches far fewer.
    """
    lines = materialize(marks.where("kind = 'line'").select("chunk_id", "file", "line", F.col("a").alias("template"), F.col("b").alias("around")).dropDuplicates(["chunk_id", "line"]), "scan-lines")
    per_file = lines.groupBy("template", "file").agg(F.count_distinct("chunk_id").alias("n"))
    spread = per_file.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))
    sizes = marks.select("file", "chunk_id").distinct().groupBy("file").agg(F.count("*").alias("size"))
    histogram = [(float(r["size"]), r["files"]) for r in sizes.groupBy(F.round(F.log2("size") * 2).alias("class")).agg(F.avg("size").alias("size"), F.count("*").alias("files")).collect()]
    total = sum(s * k for s, k in histogram) or 1.0
    expected = sum((F.lit(float(k)) * (1 - F.exp(-F.col("n") * F.lit(s / total))) for s, k in histogram), F.lit(0.0))
    repeated = materialize(spread.where(F.col("n") >= LEAST_COPIES).select("template", "n", (expected / F.col("n_files") >= CROWDED).alias("crowded")), "scan-repeated")
    # a template's copies by what stands around them; both questions of a copy meet the pair counts in one join
    open_ = lines.join(repeated.where(~F.col("crowded")).select("template"), "template", "left_semi").groupBy("template", "around").agg(F.count("*").alias("copies"))
    words = F.split("around", "\t")
    asked = open_.select("template", "copies", "around", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.try_element_at(words, F.lit(2)).alias("b")), F.struct(F.lit(-1).alias("side"), F.try_element_at(words, F.lit(3)).alias("b")))).alias("q"), words[0].alias("a")).select("template", "around", "copies", "a", "q.side", "q.b")
    pairs = counts.where("kind = 'b'").select("a", "b", F.col("n").alias("n_pair"))
    told = asked.join(pairs, ["a", "b"], "left").groupBy("template", "around").agg(F.first("copies").alias("copies"), F.sum(F.col("side") * F.coalesce("n_pair", F.lit(0))).alias("more"))
    breaks = (F.col("around") == "-") | (F.col("more") > 0)
    interrupting = told.groupBy("template").agg((F.sum(F.when(breaks, F.col("copies")).otherwise(0)) / F.sum("copies")).alias("share")).where(F.col("share") >= INTERRUPTS)
    headers = materialize(repeated.where("crowded").select("template").unionByName(interrupting.select("template")), "scan-header-templates")
    headers = materialize(headers.join(repeated.select("template", "n"), "template"), "scan-headers")
    anchors, elsewhere = anchor_headers(headers, spread.select("template"))
    # in its file a header may be damaged more than elsewhere; a short one is known there only
    own = materialize(per_file.where("file is not null").join(anchors.withColumn("is_header", F.lit(True)), "template", "left").select(F.col("file").alias("scope"), "template", F.coalesce("is_header", F.lit(False)).alias("is_header")), "scan-own")
    busy = own.groupBy("scope").agg((F.count("*") * F.count_if("is_header")).alias("pairs")).where(F.col("pairs") > 0)
    mine = own.join(busy, "scope").select("scope", "template", "is_header", (F.col("pairs") > PAIRS_OF_FILE).alias("busy"))
    given = mine.where("is_header").select("scope", F.col("template").alias("header"), "busy")
    few = mine.where("not busy").join(given.where("not busy").drop("busy"), "scope").where(F.levenshtein("template", "header") <= damage_of(F.length("header"), DAMAGE)).select("scope", "template")
    many = near_headers(mine.where("busy").select("scope", "template"), given.where("busy").select("scope", "header"), DAMAGE)
    anywhere = elsewhere.unionByName(headers.select("template")).select(F.lit("").alias("scope"), "template")
    alike = few.unionByName(many).unionByName(anywhere).distinct()
    scoped = lines.select("chunk_id", "line", "template", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("file", F.lit(""))))).alias("scope"))
    return scoped.join(alike, ["scope", "template"], "left_semi").select("chunk_id", "line").distinct()


def anchor_headers(headers: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template) of the headers that are no damaged copies of much more frequent ones, and (template) of what is near
    them anywhere.

    A damaged copy of a header may itself be repeated; what is near such a copy only is no copy of the header. Rounds go
    from the most frequent headers down by factors of ``RARER``, so there are as many as that fits into the largest count.
    """
    open_, rest = headers.where(F.length("template") >= SHORT_HEADER), materialize(templates.distinct(), "scan-templates")
    anchors, found = headers.where(F.length("template") < SHORT_HEADER).select("template"), rest.limit(0)
    while (most := open_.agg(F.max("n")).first()[0]) is not None:
        level = open_.where(F.col("n") * RARER >= most).select("template")
        near = materialize(near_headers(rest.select(F.lit("").alias("scope"), "template"), level.select(F.lit("").alias("scope"), F.col("template").alias("header")), DAMAGE_ELSEWHERE).select("template"), "scan-near")
        anchors, found = anchors.unionByName(level), found.unionByName(near)
        open_, rest = open_.join(near, "template", "left_anti"), rest.join(near, "template", "left_anti")
    return anchors, found


def damage_of(size: Column, damage: float) -> Column:
    """Characters in which a copy of a header of that length may differ."""
    return F.greatest(F.lit(1), F.floor(F.least(size, F.lit(DAMAGE_UP_TO)) * damage)).cast("int")


def near_headers(templates: DataFrame, headers: DataFrame, damage: float) -> DataFrame:
    """(scope, template) of the templates within the damage of a header of their scope: all of them, by pieces.

    A template falls into one piece more than any header that is near it may differ from it, so one piece at least is
    whole in such a header, shifted no further than the edits before and behind it allow. Headers list the pieces they
    could share with a template of each length; a join on pieces gives the candidates.
    """

    def edits(size: Column) -> Column:
        """The most that a header near a template of that length may differ from it: it is longer by no more than that."""
        return damage_of(F.ceil(size / (1 - damage)), damage)

    def bound(i: Column, n: Column, k: Column) -> Column:
        """Where piece i of a text of length n cut into k + 1 pieces begins."""
        return F.floor(i * n / (k + 1)).cast("int")

    l, k, i = F.col("l"), F.col("k"), F.col("i")
    begin, width = bound(i, l, k), bound(i + 1, l, k) - bound(i, l, k)
    cut = templates.select("scope", "template", F.length("template").alias("l")).withColumn("k", edits(l)).withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    here = cut.select("scope", "template", "l", "i", F.substr("template", begin + 1, width).alias("piece"))
    n, d = F.length("header"), damage_of(F.length("header"), damage)
    there = headers.select("scope", "header", n.alias("n"), F.explode(F.sequence(F.greatest(F.lit(1), n - d), n + d)).alias("l")).withColumn("k", edits(l)).withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    more = F.col("n") - l
    there = there.select("scope", "header", "n", "l", "i", width.alias("width"), F.greatest(F.lit(0), begin - i, begin + more - (k - i)).alias("low"), F.least(F.col("n") - width, begin + i, begin + more + (k - i)).alias("high"))
    there = there.where("low <= high and width > 0").withColumn("at", F.explode(F.sequence("low", "high")))
    there = there.select("scope", "header", "l", "i", F.substr("header", F.col("at") + 1, F.col("width")).alias("piece")).distinct()
    pairs = here.join(there, ["scope", "l", "i", "piece"])
    return pairs.where(F.levenshtein("template", "header") <= damage_of(F.length("header"), damage)).select("scope", "template").distinct()


# --- misread words


def meanings(word: str, undo: dict[str, list[tuple[str, int]]], longest: int, may_hold: Callable[[int], bool], edits: int | None = None) -> dict[str, tuple[int, ...]]:
    """Words that confusions turn into ``word``, with the confusions used (fewest first); at most ``edits`` if given.

    The meant word grows character by character and is given up as soon as no known word begins so: ``may_hold`` tells of
    the CRC-32 of a beginning, or of a whole word and ``END``. So the walk visits beginnings of known words only.
    """
    found: dict[str, tuple[int, ...]] = {}
    size = len(word)
    stack = [(0, 0, "", ())]  # characters read, checksum and text of what was meant so far, confusions
    while stack:
        i, crc, text, used = stack.pop()
        if i == size:
            if used and text != word and may_hold(crc32(b"\x00", crc)) and (text not in found or (len(used), used) < (len(found[text]), found[text])):
                found[text] = used
            continue
        steps = [(word[i], 1, None)]
        if edits is None or len(used) < edits:
            for k in range(1, min(longest, size - i) + 1):
                steps += [(meant, k, number) for meant, number in undo.get(word[i : i + k], ())]
        for meant, k, number in steps:
            c = crc
            for x in meant:
                c = crc32(x.encode("utf-8", "surrogatepass"), c)
                if not may_hold(c):
                    break
            else:
                stack.append((i + k, c, text + meant, used if number is None else (*used, number)))
    return found


def correction_model(words: DataFrame) -> DataFrame:
    """(word, n, meant, n_meant, score, explained): for each suspicious word what it may stand for and the log probability of
    that reading.

    ``words`` has word, n and n_clean (its count in texts that were not scanned). The channel is estimated from clear
    cases (one confusion, the meant word at least fifty times as frequent); it has one number per confusion of the
    inventory.
    """
    known = words.where("n > 0").select("word", "n")
    letters = known.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = parts_for(letters)  # one, unless the vocabulary outgrows a filter; then each part of it is walked by itself
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    shared = [words.sparkSession.sparkContext.broadcast(build_filter(known.where(part == k).select(F.explode(prefixes(F.col("word"))).alias("prefix")), "prefix", letters // parts).table) for k in range(parts)]

    # words are few bytes but much work each, so they are spread by number, not by size
    doubtful = words.where(F.col("n_clean") <= CLEAN * F.col("n")).select("word", "n").repartition(default_partitions(words.sparkSession))
    partners = known.select(F.col("word").alias("meant"), F.col("n").alias("n_meant"))

    def candidates(numbers: list[int], edits: int | None) -> DataFrame:
        """Known words that the numbered confusions (up to ``edits`` of them) turn into a doubtful one."""
        undo: dict[str, list[tuple[str, int]]] = {}
        for number in numbers:
            undo.setdefault(CONFUSIONS[number][1], []).append((CONFUSIONS[number][0], number))
        longest = max(map(len, undo), default=0)

        def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [Filter(x.value).may_hold for x in shared]
            for batch in batches:
                out: tuple[list, list, list, list] = ([], [], [], [])
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if len(word) < 2 or word.startswith("#"):
                        continue
                    for may_hold in asked:  # what a filter lets through by chance has no partner in the join
                        for meant, used in meanings(word, undo, longest, may_hold, edits).items():
                            if meant.isalpha() or _WORDLIKE.fullmatch(meant) and not any(map(str.isdigit, meant)):
                                for column, value in zip(out, (word, n, meant, used)):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int32()))], names=["word", "n", "meant", "used"])

        return doubtful.mapInArrow(generate, "word string, n bigint, meant string, used array<int>").join(partners, "meant").where("n_meant > n")

    clear = candidates(list(range(len(CONFUSIONS))), 1).where(F.col("n_meant") >= 50 * F.greatest("n", F.lit(1))).groupBy(F.col("used")[0].alias("k")).agg(F.sum("n").alias("n"))
    seen = {r["k"]: r["n"] for r in clear.collect()}
    exposure = words.agg(*(F.sum(F.col("n") * F.floor((F.length("word") - F.length(F.replace("word", F.lit(m), F.lit("")))) / len(m))).alias(f"e{i}") for i, m in enumerate(sorted({m for m, _ in CONFUSIONS})))).first()
    shown = {m: exposure[f"e{i}"] or 0 for i, m in enumerate(sorted({m for m, _ in CONFUSIONS}))}
    rate = [seen.get(k, 0) / max(1, shown[m]) for k, (m, _) in enumerate(CONFUSIONS)]
    # only confusions this corpus shows are combined
    found = candidates([k for k, r in enumerate(rate) if r >= LEAST_RATE], None)
    # few words are misread, but those in several characters: one word in ``burst``, in which a confusion is that much likelier
    burst = max(1.0, (words.agg(F.sum("n")).first()[0] or 1) / max(1, sum(seen.values())))
    channel = F.array(*(F.lit(log(min(r * burst, MOST_MISREAD)) if r >= LEAST_RATE else -100.0) for r in rate))
    score = F.aggregate("used", F.lit(-log(burst)), lambda a, k: a + F.element_at(channel, k + 1))
    scored = found.select("word", "n", "meant", "n_meant", score.alias("score")).where("score > -80")
    # misreadings of the meant word that the corpus should show; a joined word that it never writes has n = 0
    expected = F.col("n_meant") * F.exp("score")
    best = scored.withColumn("explained", F.sum(expected).over(Window.partitionBy("word")))
    return best.where(F.col("explained") * TOLERANCE >= EXPLAINED * F.col("n")).select("word", "n", "meant", "n_meant", "score", "explained")


class _Suspects(dict):
    """Whether a token may be suspicious, asked of the filter once per distinct token."""

    def __init__(self, table: bytes):
        super().__init__()
        self.may_hold = Filter(table).may_hold_text

    def __missing__(self, token: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        w = _bare[token]
        hit = not w.startswith("#") and self.may_hold(w)
        r = self[token] = w if hit else None
        return r


_suspects: list = [None, None]


def suspicious_places(chunks: DataFrame, suspects: Filter) -> DataFrame:
    """Second pass over scanned texts: (chunk_id, at, line, word, before, behind) of words that may be suspicious."""
    shared = chunks.sparkSession.sparkContext.broadcast(suspects.table)
    key = crc32(suspects.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _suspects[0] != key:
            _suspects[:] = [key, _Suspects(shared.value)]
        ask = _suspects[1]
        for batch in batches:
            rows = []
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = _LINES.split(text)
                divided = divided_words(lines) if _DIVISION.search(text) else []
                if not any(map(ask.__getitem__, text.split())) and not any(ask[left + right] for _, _, left, right in divided):
                    continue
                words = running_words(lines, divided)
                last = len(words) - 1
                for k, (line, w) in enumerate(words):
                    hit = ask[w]
                    if hit is not None:
                        rows.append((chunk, k, line, hit, _bare[words[k - 1][1]] if k else "", _bare[words[k + 1][1]] if k < last else ""))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["chunk_id", "at", "line", "word", "before", "behind"])

    source = chunks.where("scanned and text is not null").select("chunk_id", "text")
    return source.mapInArrow(run, "chunk_id string, at int, line int, word string, before string, behind string")


#: Weight of the word count behind a pair count, as so many pairs.
BACKOFF = 20.0


def decode_runs(places: DataFrame, model: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(chunk_id, line, at, word, meant) of the words that the best path through their run replaces.

    The join with the model leaves suspicious words only; neighbours among them are a run, between certain words. The
    lattice of a run has the word itself and its meanings at each place; a step costs the channel and the pair
    probability, smoothed by the word counts. A suspicious word's own count is not believed: misreadings explain it.
    """
    options = model.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.struct("meant", F.col("n_meant").alias("count"), "score")).alias("meanings"))  # as many as a word has readings
    # places of one run have the same distance between place and rank; a chunk has no more places than words
    nth = F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("at"))
    stay = F.array(F.struct(F.col("word").alias("meant"), F.col("n").alias("count"), F.lit(0.0).alias("score")))
    lattice = places.join(options, "word").withColumn("run", F.col("at") - nth).withColumn("options", F.concat(stay, "meanings"))
    whole = lattice.groupBy("chunk_id", "run").agg(F.min_by("before", "at").alias("left"), F.max_by("behind", "at").alias("right"), F.array_sort(F.array_distinct(F.collect_list(F.struct("at", "line", "word", "n", "options")))).alias("places"))
    whole = materialize(whole, "scan-lattice")
    # one row per step of a place, then one per pair of readings
    names = F.concat(F.array(F.array("left")), F.transform("places", lambda p: F.transform(p["options"], lambda o: o["meant"])), F.array(F.array("right")))
    steps = whole.select("chunk_id", "run", names.alias("names")).select("chunk_id", "run", F.explode(F.arrays_zip(F.slice("names", 1, F.size("names") - 1).alias("a"), F.slice("names", 2, F.size("names") - 1).alias("b"))).alias("s"))
    needed = steps.select("chunk_id", "run", F.explode("s.a").alias("a"), "s.b").select("chunk_id", "run", "a", F.explode("b").alias("b"))
    pairs = counts.where("kind = 'b'").select("a", "b", F.col("n").alias("n_pair"))
    singles = counts.where("kind = 'u'").select("a", F.col("n").alias("n_pair"))
    ends = whole.select("chunk_id", "run", F.explode(F.array("left", "right")).alias("a")).join(singles, "a").withColumn("b", F.lit(None).cast("string"))
    # pairs that the corpus never writes need no row: their count is 0
    told = needed.join(pairs, ["a", "b"]).unionByName(ends).groupBy("chunk_id", "run").agg(F.collect_list(F.struct("a", "b", "n_pair")).alias("prices"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                places = list(r.places)
                price = {} if r.prices is None else {(x["a"], x["b"]): x["n_pair"] for x in r.prices}
                number = {w: price.get((w, None), 0) for w in (r.left, r.right)} | {o["meant"]: o["count"] for p in places for o in p["options"]}
                lessen = {p["word"]: 0.002 / max(p["n"], 1) for p in places}

                def step(a: str, b: str) -> float:
                    p, n_a, n_b = price.get((a, b), 0), number[a], number[b]
                    fa, fb = lessen.get(a, 1.0), lessen.get(b, 1.0)
                    prior = (n_b * fb + 0.01) / total
                    return log((p * fa * fb + BACKOFF * prior) / (n_a * fa + BACKOFF))

                best = {r.left: (0.0, ())}
                for p in places:
                    nxt = {}
                    for o in p["options"]:
                        cost, way = max((c + step(a, o["meant"]), w) for a, (c, w) in best.items())
                        cost += o["score"]
                        if o["meant"] not in nxt or cost > nxt[o["meant"]][0]:
                            nxt[o["meant"]] = (cost, (*way, o["meant"]))
                    best = nxt
                way = max((c + step(a, r.right), w) for a, (c, w) in best.items())[1]
                out += [(r.chunk_id, p["line"], p["at"], p["word"], m) for p, m in zip(places, way) if m != p["word"]]
            yield pd.DataFrame(out, columns=["chunk_id", "line", "at", "word", "meant"])

    return whole.join(told, ["chunk_id", "run"], "left").select("chunk_id", "run", "left", "right", "places", "prices").mapInPandas(run, "chunk_id string, line int, at int, word string, meant string")


# --- the operator


def scanned_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", file_of(F.col("source_path")).alias("file"), F.coalesce(F.col("source_path").rlike(SCANNED), F.lit(False)).alias("scanned"), F.col("text").cast("string").alias("text"))


def find_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise, line, at, rest, word, meant): every finding in the texts of scanned files.

    noise is hyphen, misread, header or page_number; ``line`` counts from 0. Null and empty texts and texts of other files
    have no findings but count in the language model; a null path is no scanned file; a chunk delivered repeatedly gives
    its findings once; extra columns are ignored.
    """
    source = scanned_chunks(chunks)
    counts, marks = count_pass(source)
    headers = materialize(header_lines(marks, counts), "scan-header-lines")
    singles = counts.where("kind = 'u'").select(F.col("a").alias("word"), "n")
    divided = materialize(marks.where("kind = 'divided'").select("chunk_id", "line", "rest", F.col("a").alias("left_part"), F.col("b").alias("right_part"), F.concat("a", "b").alias("joined"), F.concat("a", F.lit("-"), "b").alias("compound")).distinct(), "scan-divided")
    # words that occur divided only are judged too
    none, zero = F.lit(None), F.lit(0).cast("long")
    lexicon = materialize(
        singles.select("word", "n", zero.alias("n_clean"))
        .unionByName(counts.where("kind = 'c'").select(F.col("a").alias("word"), zero.alias("n"), F.col("n").alias("n_clean")))
        .unionByName(divided.select(F.col("joined").alias("word"), zero.alias("n"), zero.alias("n_clean")))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean")),
        "scan-lexicon",
    )
    model = materialize(correction_model(lexicon), "scan-model")
    total = counts.where("kind = 'u'").agg(F.sum("n")).first()[0] or 1
    suspects = model.select("word").distinct()
    n_suspects = model.agg(F.approx_count_distinct("word")).first()[0]
    misread = decode_runs(suspicious_places(source, build_filter(suspects, "word", n_suspects)), model, counts, total)
    pages = marks.where("kind = 'page'").select("chunk_id", "line").distinct()
    noise_lines = headers.unionByName(pages).distinct()
    misread = misread.join(noise_lines, ["chunk_id", "line"], "left_anti")
    # a division is one of a word if the joined form, or what it was misread from, is written more than the compound
    roles = ("joined", "compound", "left_part", "right_part")
    forms = divided.select("left_part", "right_part", "joined", "compound").distinct()
    asked = forms.select("left_part", "right_part", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in roles))).alias("q")).select("left_part", "right_part", "q.role", "q.word")
    told = singles.select("word", "n", F.lit(0.0).alias("explained")).unionByName(model.select("word", F.lit(0).cast("long").alias("n"), "explained")).groupBy("word").agg(F.sum("n").alias("n"), F.max("explained").alias("explained"))
    of = asked.join(told, "word").groupBy("left_part", "right_part").agg(*(F.sum(F.when(F.col("role") == r, F.col("n"))).alias(f"n_{r.removesuffix('_part')}") for r in roles), F.max(F.when(F.col("role") == "joined", F.col("explained"))).alias("explained"))
    judged = divided.join(of, ["left_part", "right_part"], "left").fillna(0)
    written = F.col("n_joined") + F.when(F.col("explained") > 0, 1).otherwise(0)
    unknown = (written == 0) & (F.col("n_compound") == 0)
    both_words = (F.col("n_left") >= 20) & (F.col("n_right") >= 20)
    hyphen = judged.where((written > F.col("n_compound")) | (unknown & ~both_words))
    parts = [
        hyphen.select("chunk_id", F.lit("hyphen").alias("noise"), "line", none.cast("int").alias("at"), "rest", F.col("compound").alias("word"), F.col("joined").alias("meant")),
        misread.select("chunk_id", F.lit("misread").alias("noise"), "line", "at", none.cast("int").alias("rest"), "word", "meant"),
        headers.select("chunk_id", F.lit("header").alias("noise"), "line", none.cast("int").alias("at"), none.cast("int").alias("rest"), none.cast("string").alias("word"), none.cast("string").alias("meant")),
        pages.join(headers, ["chunk_id", "line"], "left_anti").select("chunk_id", F.lit("page_number").alias("noise"), "line", none.cast("int").alias("at"), none.cast("int").alias("rest"), none.cast("string").alias("word"), none.cast("string").alias("meant")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def noise_kinds(findings: DataFrame) -> DataFrame:
    return findings.select("chunk_id", "noise").distinct()


# --- repair

_PARAGRAPH = re.compile(r"\n\s*\n")


def repaired(text: str, drop: set[int], divided: dict[int, int], meant: dict[tuple[int, str], str]) -> str:
    """Continuous paragraphs of a scanned text: noise lines out, divided words whole, misread words as meant."""
    lines = _LINES.split(text)
    parts: list[str] = []
    open_ = False  # whether the next words go on in the current paragraph
    skip_first: set[int] = set()
    joins = {i: j for i, j in divided.items() if j < len(lines) and lines[j].split()}

    def corrected(i: int, token: str) -> str:
        m = meant.get((i, bare(token)))
        if m is None:
            return token
        core = token.strip(_EDGE)
        at = token.find(core)
        if core.isupper():
            m = m.upper()
        elif core[:1].isupper() or (core[:1].isdigit() and token[:1].isupper()):
            m = m[:1].upper() + m[1:]
        return token[:at] + m + token[at + len(core) :]

    for i, line in enumerate(lines):
        if i in drop:
            continue
        if not line.strip():
            if not any(i < j and k < i for k, j in joins.items()):  # a gap inside a divided word ends no paragraph
                open_ = False
            continue
        words = line.split()
        if i in skip_first:
            words = words[1:]
        if i in joins and words:
            j = joins[i]
            words[-1] = words[-1].rstrip(HYPHENS) + lines[j].split()[0]
            skip_first.add(j)
        words = [corrected(i, w) for w in words]
        if not words:
            continue
        alone = bool(_META.match(line)) or (is_header_like(line) and not line.strip().endswith((".", ",")) and not open_)
        if open_ and not alone and not line.startswith("   "):
            parts[-1] += " " + " ".join(words)
        else:
            parts.append(" ".join(words))
        open_ = not alone
    return "\n\n".join(parts)


def repair(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, n_repairs): every chunk once, texts of scanned files with findings as continuous paragraphs.

    Texts without findings, null and empty ones are passed on as they are; of a chunk delivered repeatedly the text of the
    latest delivery is taken. The findings of a chunk are no more than its words.
    """
    findings = materialize(find_noise(chunks), "scan-findings")
    per = findings.groupBy("chunk_id").agg(F.collect_list(F.struct("noise", "line", "rest", "word", "meant")).alias("found"))
    latest = chunks.groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "text")).alias("v")).select("chunk_id", F.col("v.text").alias("text"))
    source = latest.join(per, "chunk_id", "left").select("chunk_id", "text", "found")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if not r.text or r.found is None:
                    out.append((r.chunk_id, r.text, 0))
                    continue
                drop = {int(x["line"]) for x in r.found if x["noise"] in ("header", "page_number")}
                divided = {int(x["line"]): int(x["rest"]) for x in r.found if x["noise"] == "hyphen"}
                meant = {(int(x["line"]), x["word"]): x["meant"] for x in r.found if x["noise"] == "misread"}
                out.append((r.chunk_id, repaired(r.text, drop, divided, meant), len(r.found)))
            yield pd.DataFrame(out, columns=["chunk_id", "text", "n_repairs"])

    return source.mapInPandas(run, "chunk_id string, text string, n_repairs int")
