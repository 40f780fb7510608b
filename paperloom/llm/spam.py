"""Problem 8: pages that consist of repeated keywords, links, menus or product tags instead of sentences.

Method: rank-frequency curves. One pass over the texts turns each page into its word counts (hashed words, no text) and
its frequency spectrum. SQL windows rank the spectrum and fit log frequency against log rank: slope, residual and the
number of types say how the page spreads its words. Pages whose curve is ordinary for their language and length are
the prose of that language; their word shares form a reference of fixed size. A page is flagged if it diverges far from
that prose and clearly further than prose of the same language at a comparable length does; with an extreme curve a
somewhat smaller divergence is enough. An extreme curve flags a page by itself if it says each word several times and is
no list with a purpose: such lists repeat words too, but words their language's prose uses, beside dates, page or item
numbers; they diverge little or count.

Copies: a corpus may hold one text very often, so norms and reference count each distinct page (words and their counts)
once, and a page is held against the prose of all others. The verdict goes back to every copy.

What moves: the spectrum (a few rows a page), the hashed counts (written once to the shared folder), keys of pages and
sums of fixed size. No page is joined with another.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.token_budget import normal_lang
from paperloom.session import materialize

#: Share of a language's prose below which a word counts as unknown; unknown words have this share. So the reference has at
#: most 1 / UNKNOWN words a language, and neither they nor the divergences change with the size of the corpus.
UNKNOWN = 1e-5
#: Pages with fewer words have no curve and are never flagged.
LEAST_WORDS = 8
#: Pages of a language and length from which their own norms are used; below, those of all languages at that length.
LEAST_PAGES = 20
#: Robust deviations from the norm within which a curve is ordinary, and beyond which it is extreme.
ORDINARY, EXTREME = 2.0, 8.0
#: Times that a page says each word on average, from which an extreme curve alone flags it, numbers a word from which it is a
#: list with a purpose, and nats above prose of its length. One sentence of prose said five times comes to 0.8 nats.
REPEATED, NUMBERS, ABOVE_IF_REPEATED = 4.0, 0.1, 1.2
#: Nats of divergence from prose that flag a page, alone or with an extreme curve, and what it must be above prose of its length.
FAR, FAR_WITH_CURVE, ABOVE = 4.15, 3.8, 1.9
#: Nats that flag a page with an ordinary curve if its own share is taken out of the prose; single pages of prose in a thin
#: language come to 5.2.
FAR_FROM_OTHERS = 5.65
ANY = "*"

_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/[\w./?=&%#~-]*", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")
_LINKED = re.compile(r"://|www\.|\.\w[\w-]*/", re.IGNORECASE)
_WORD = regex.compile(r"\x01|[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+")
_ASCII_WORD = re.compile(r"\x01|[a-z]+")


def page_words(text: str) -> list[str]:
    """Lower-case words; every link is one special word; characters of unspaced scripts stand alone; digits do not count."""
    low = text.replace("\x01", " ")
    if _LINKED.search(low):
        low = _URL.sub(" \x01 ", low)
    low = low.lower()
    return _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)


class _Slots(dict):
    """Hash of each word, computed once per worker; dropped when it grows past a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_slots = _Slots()


def page_keys(words: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each page's words and counts, whatever their order."""
    x = words.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return np.add.reduceat(x ^ x >> np.uint64(31), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, lang, page (key of words and counts), n (words), numbers, words (hashes), counts, freq and n_freq (the
    frequency spectrum, descending)."""

    def nested(lists: list, kind: type) -> pa.Array:
        ends = np.zeros(len(lists) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), kind, int(ends[-1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots.__getitem__
        for batch in batches:
            keep, n, numbers, words, counts, freq, n_freq = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = page_words(text) if text else []
                if len(found) < LEAST_WORDS:
                    continue
                c = Counter(found)
                spectrum = sorted(Counter(c.values()).items(), reverse=True)
                keep.append(i)
                n.append(len(found))
                numbers.append(len(_NUMBER.findall(text)))
                words.append(list(map(slot, c)))
                counts.append(c.values())
                freq.append([f for f, _ in spectrum])
                n_freq.append([m for _, m in spectrum])
            at = pa.array(keep, pa.int32())
            words, counts = nested(words, np.int64), nested(counts, np.int32)
            pages = page_keys(words.values.to_numpy(), counts.values.to_numpy(), words.offsets.to_numpy()[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(pages), pa.array(n, pa.int32()), pa.array(numbers, pa.int32()), words, counts, nested(freq, np.int32), nested(n_freq, np.int32)],
                names=["doc_id", "lang", "page", "n", "numbers", "words", "counts", "freq", "n_freq"],
            )

    code = normal_lang(F.col("lang"))
    # two-letter codes only, so that there are no more norms and prose counts than such codes
    source = documents.select(F.col("doc_id").cast("long"), F.when(F.length(code) == 2, code).otherwise("?").alias("lang"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, lang string, page bigint, n int, numbers int, words array<bigint>, counts array<int>, freq array<int>, n_freq array<int>")


def one_of_each(prints: DataFrame) -> DataFrame:
    """doc_id, page: for each distinct page the document that stands for it, one of its most frequent known label."""
    alike = prints.groupBy("page", "lang").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    return alike.groupBy("page").agg(F.max_by("doc_id", F.struct(F.col("lang") != "?", "copies", "lang")).alias("doc_id"))


def curves(prints: DataFrame) -> DataFrame:
    """Per page the fit of log frequency against log rank, weighted by the words at each rank: slope, residual, types.

    All words of one frequency share a step of the curve; its place is the middle of the ranks they hold.
    """
    steps = prints.select("doc_id", "lang", "n", F.explode(F.arrays_zip("freq", "n_freq")).alias("s")).select("doc_id", "lang", "n", F.col("s.freq").alias("f"), F.col("s.n_freq").alias("m"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("last_rank", F.sum("m").over(w)).select("doc_id", "lang", "n", "last_rank", F.log("f").alias("y"), F.log((F.col("last_rank") - (F.col("m") - 1) / 2)).alias("x"), (F.col("f") * F.col("m")).cast("double").alias("k"))
    sums = ranked.groupBy("doc_id", "lang", "n").agg(
        F.max("last_rank").alias("types"), F.sum("k").alias("k"), *(F.sum(F.col("k") * e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y"))))
    )
    vx, vxy, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("k"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("k"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("k")
    slope = F.when(vx > 1e-9, vxy / vx).otherwise(0.0)
    return sums.select("doc_id", "lang", F.round(F.log2("n")).cast("int").alias("size"), F.log("types").alias("types"), slope.alias("slope"), F.sqrt(F.greatest((vy - slope * vxy) / F.col("k"), F.lit(0.0))).alias("residual"))


def with_norms(df: DataFrame, columns: dict[str, float], among=None) -> DataFrame:
    """Adds ``norm_c`` (median) and ``mad_c`` (scaled, with a floor) of each column for the row's language and size.

    Where the language has too few pages of that size, the norm of all languages there is used. The tables of norms
    hold a row per language and size class.
    """
    base = df if among is None else df.where(among)

    def table(keys: list[str], tag: str) -> DataFrame:
        medians = base.groupBy(*keys).agg(F.count("*").alias(f"{tag}_n"), *(F.percentile_approx(c, 0.5, 2000).alias(f"{tag}_m_{c}") for c in columns))
        spread = base.join(F.broadcast(medians), keys).groupBy(*keys).agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"{tag}_m_{c}")), 0.5, 2000).alias(f"{tag}_d_{c}") for c in columns))
        return medians.join(F.broadcast(spread), keys)

    # two-letter codes and powers of two: at most some thousand rows, whatever the corpus
    out = df.join(F.broadcast(table(["lang", "size"], "own")), ["lang", "size"], "left").join(F.broadcast(table(["size"], "all")), ["size"], "left")
    enough = F.coalesce("own_n", F.lit(0)) >= LEAST_PAGES
    for c, floor in columns.items():
        out = out.withColumn(f"norm_{c}", F.when(enough, F.col(f"own_m_{c}")).otherwise(F.col(f"all_m_{c}"))).withColumn(f"mad_{c}", F.greatest(1.4826 * F.when(enough, F.col(f"own_d_{c}")).otherwise(F.col(f"all_d_{c}")), F.lit(floor)))
    return out.drop(*(f"{t}_{k}_{c}" for t in ("own", "all") for k in ("m", "d") for c in columns), "own_n", "all_n")


def _keys_of(labels: list[str], sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashed words under the language of their page; ``sizes`` is the number of words of each page."""
    seeds = np.fromiter((zlib.crc32(x.encode()) for x in labels), np.uint64, len(labels)) << np.uint64(32)
    return (words.astype(np.uint64) | np.repeat(seeds, sizes)).view(np.int64)


def _columns(batch: pa.RecordBatch, n: int, words: int, counts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the pages of a batch, their hashed words and the share of each word in its page."""
    ends = np.asarray(batch.column(words).offsets)
    sizes = np.diff(ends)
    total = np.repeat(batch.column(n).to_numpy(zero_copy_only=False), sizes)
    return sizes, batch.column(words).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], batch.column(counts).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] / total


def prose_reference(prose: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, float]]:
    """Keys (ascending) and summed shares of the known words of the prose pages, per language and of all, and pages per
    language. Sums are combined per batch, then in the JVM; the driver gets the known words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, shares = _columns(batch, 1, 2, 3)
            langs = batch.column(0).to_pylist()
            for labels in (langs, [ANY] * len(langs)):
                keys, first, where = np.unique(_keys_of(labels, sizes, words), return_index=True, return_inverse=True)
                of = np.repeat(np.arange(len(labels)), sizes)[first]
                yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in of], pa.string()), pa.array(keys), pa.array(np.bincount(where, weights=shares, minlength=len(keys)))], names=["lang", "key", "share"])

    sums = prose.select("lang", "n", "words", "counts").mapInArrow(run, "lang string, key bigint, share double").groupBy("lang", "key").agg(F.sum("share").alias("share"))
    pages = {r["lang"]: float(r["n"]) for r in prose.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pages[ANY] = sum(pages.values())
    enough = F.create_map(*(F.lit(x) for lang, n in pages.items() for x in (lang, n * UNKNOWN)))
    got = sums.where(F.col("share") >= F.element_at(enough, F.col("lang"))).select("key", F.col("share").cast("float").alias("share")).toArrow()
    keys, shares = got["key"].to_numpy(), got["share"].to_numpy()
    order = np.argsort(keys)
    return (keys[order], shares[order]), pages


def divergences(prints: DataFrame, reference: tuple[np.ndarray, np.ndarray], pages: dict[str, float]) -> DataFrame:
    """doc_id, lang, size, divergence: of the page's word shares from its language's prose (Kullback-Leibler, nats);
    ``from_others``: the same for a page that is in ``reference`` itself, without its own share in it.

    The label may be wrong or missing, so a page far from its own language's prose is held against the other languages
    too, and the least divergence counts. A language without another page says nothing.
    """
    shared = prints.sparkSession.sparkContext.broadcast((*reference, pages))
    known = sorted((x for x in pages if pages[x] >= LEAST_PAGES and x not in (ANY, "?")), key=lambda x: -pages[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_keys, known_shares, n_pages = shared.value
        known_keys, known_shares = np.append(known_keys, np.iinfo(np.int64).max), np.append(known_shares, np.float32(0))

        def kl(labels: list[str], sizes: np.ndarray, words: np.ndarray, p: np.ndarray, own: np.ndarray) -> np.ndarray:
            """``own``: 1 for pages whose share is to be taken out of the reference, else 0."""
            if not len(sizes):
                return np.zeros(0)
            pages_of = np.fromiter((n_pages[x] for x in labels), np.float64, len(labels)) - own
            keys = _keys_of(labels, sizes, words)
            at = np.searchsorted(known_keys, keys)
            share = np.maximum(np.where(known_keys[at] == keys, known_shares[at], 0) - p * np.repeat(own, sizes), 0)
            q = share / np.repeat(np.maximum(pages_of, 1), sizes) + UNKNOWN
            out = np.add.reduceat(p * np.log(p / q), np.cumsum(sizes) - sizes)
            out[(pages_of < 1) & (np.array(labels) != ANY)] = np.inf
            return out

        for batch in batches:
            langs = batch.column(1).to_pylist()
            n = batch.column(2).to_numpy(zero_copy_only=False)
            sizes, words, p = _columns(batch, 2, 3, 4)
            both = []
            for own in (np.zeros(len(langs)), np.ones(len(langs))):
                out = np.minimum(kl([ANY] * len(langs), sizes, words, p, own), kl([x if x in n_pages else ANY for x in langs], sizes, words, p, own))
                odd = np.flatnonzero(out > 2.5)
                if len(odd) and known:
                    mine = np.isin(np.repeat(np.arange(len(sizes)), sizes), odd)
                    for x in known:
                        out[odd] = np.minimum(out[odd], kl([x] * len(odd), sizes[odd], words[mine], p[mine], own[odd] * [langs[i] == x for i in odd]))
                both.append(pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(np.log2(n)).astype(np.int32)), *both], names=["doc_id", "lang", "size", "divergence", "from_others"])

    return prints.select("doc_id", "lang", "n", "words", "counts").mapInArrow(run, "doc_id bigint, lang string, size int, divergence double, from_others double")


def judge_pages(documents: DataFrame) -> DataFrame:
    """Per page with enough words: slope, residual, types and divergence with their norms, ``excess`` over prose, ``curve``
    (largest deviation of the curve in the direction of repetition) and ``spam``.

    Null, empty and very short texts give no row; a text repeated under other ids is judged for each; labels in several
    spellings are one language, missing ones a group of their own.
    """
    prints = materialize(fingerprints(documents), "page-words")
    single = materialize(one_of_each(prints), "page-single")
    one = prints.join(single.select("doc_id"), "doc_id", "left_semi")
    fits = materialize(with_norms(materialize(curves(one), "page-fits"), {"types": 0.08, "slope": 0.05, "residual": 0.05}), "page-curves")
    z = {c: (F.col(c) - F.col(f"norm_{c}")) / F.col(f"mad_{c}") for c in ("types", "slope", "residual")}
    ordinary = F.greatest(*(F.abs(v) for v in z.values())) <= ORDINARY
    prose = prints.join(fits.where(ordinary).select("doc_id"), "doc_id", "left_semi").select("lang", "n", "words", "counts")
    reference, pages = prose_reference(prose)
    far = divergences(prints, reference, pages).join(fits.select("doc_id", "slope", "residual", "types", ordinary.alias("ordinary"), F.greatest(-z["types"], -z["slope"], z["residual"]).alias("curve")), "doc_id")
    judged = with_norms(materialize(far, "page-divergence"), {"divergence": 0.1, "from_others": 0.1}, F.col("ordinary") & (F.col("divergence") <= FAR) & (F.col("from_others") <= FAR_FROM_OTHERS))
    # a length at which the corpus has no prose at all has no norm; the divergence itself decides there
    above = {c: F.col(c) - F.coalesce(f"norm_{c}", F.lit(0.0)) for c in ("divergence", "from_others")}
    far = (F.col("divergence") > FAR) | ((F.col("divergence") > FAR_WITH_CURVE) & (F.col("curve") > EXTREME))
    alone = F.col("ordinary") & (F.col("from_others") > FAR_FROM_OTHERS) & (above["from_others"] > ABOVE)
    verdict = judged.withColumn("excess", above["divergence"]).withColumn("spam", far & (above["divergence"] > ABOVE) | alone).join(single, "doc_id").drop("doc_id", "lang")
    # numbers are no words, so copies may differ in them
    listed = (F.col("curve") > EXTREME) & (F.col("excess") > ABOVE_IF_REPEATED) & (F.col("n") >= REPEATED * F.exp("types")) & (F.col("numbers") < NUMBERS * F.col("n"))
    return prints.select("doc_id", "lang", "page", "n", "numbers").join(verdict, "page").withColumn("spam", F.col("spam") | listed).drop("page", "n", "numbers")


def spam_pages(documents: DataFrame) -> DataFrame:
    return judge_pages(documents).where("spam").select("doc_id")
