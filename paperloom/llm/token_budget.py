"""Problem 4: how many tokens each document holds, and totals per source, year, language and domain.

Method: longest-match counting with a failure-link trie. The vocabulary is put into a trie; every node carries the
number of tokens that are certainly emitted when matching breaks off there and the node at which it goes on, so a word
is counted in one pass over its bytes, without backing up. Counts per distinct word are kept by the worker, a text is a
sum of lookups, and only the numbers leave the Python stage; the totals are ordinary partial aggregations.

Language and source labels come in several spellings; ``normal_type`` and ``normal_lang`` give each its one form.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.encoding import KEPT_BYTES, MAX_WORDS, parse_ranks, read_ranks, text_blocks, vocabulary_path, words_of

# ISO 639 three-letter codes and their two-letter forms.
LANG3 = dict(
    pair.split(":")
    for pair in """
    aar:aa abk:ab afr:af aka:ak alb:sq amh:am ara:ar arg:an arm:hy asm:as ava:av ave:ae aym:ay aze:az bak:ba bam:bm baq:eu bel:be ben:bn bis:bi
    bod:bo bos:bs bre:br bul:bg bur:my cat:ca ces:cs cha:ch che:ce chi:zh chu:cu chv:cv cor:kw cos:co cre:cr cym:cy cze:cs dan:da deu:de div:dv
    dut:nl dzo:dz ell:el eng:en epo:eo est:et eus:eu ewe:ee fao:fo fas:fa fij:fj fin:fi fra:fr fre:fr fry:fy ful:ff geo:ka ger:de gla:gd gle:ga
    glg:gl glv:gv gre:el grn:gn guj:gu hat:ht hau:ha heb:he her:hz hin:hi hmo:ho hrv:hr hun:hu hye:hy ibo:ig ice:is ido:io iii:ii iku:iu ile:ie
    ina:ia ind:id ipk:ik isl:is ita:it jav:jv jpn:ja kal:kl kan:kn kas:ks kat:ka kau:kr kaz:kk khm:km kik:ki kin:rw kir:ky kom:kv kon:kg kor:ko
    kua:kj kur:ku lao:lo lat:la lav:lv lim:li lin:ln lit:lt ltz:lb lub:lu lug:lg mac:mk mah:mh mal:ml mao:mi mar:mr may:ms mkd:mk mlg:mg mlt:mt
    mon:mn mri:mi msa:ms mya:my nau:na nav:nv nbl:nr nde:nd ndo:ng nep:ne nld:nl nno:nn nob:nb nor:no nya:ny oci:oc oji:oj ori:or orm:om oss:os
    pan:pa per:fa pli:pi pol:pl por:pt pus:ps que:qu roh:rm ron:ro rum:ro run:rn rus:ru sag:sg san:sa sin:si slk:sk slo:sk slv:sl sme:se smo:sm
    sna:sn snd:sd som:so sot:st spa:es sqi:sq srd:sc srp:sr ssw:ss sun:su swa:sw swe:sv tah:ty tam:ta tat:tt tel:te tgk:tg tgl:tl tha:th tib:bo
    tir:ti ton:to tsn:tn tso:ts tuk:tk tur:tr twi:tw uig:ug ukr:uk urd:ur uzb:uz ven:ve vie:vi vol:vo wel:cy wln:wa wol:wo xho:xh yid:yi yor:yo
    zha:za zho:zh zul:zu
    """.split()
)


def normal_type(c: Column) -> Column:
    """One spelling of a source type: trimmed, lower case, underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def normal_lang(c: Column) -> Column:
    """Two-letter language: region dropped, three-letter codes mapped; null and blank stay null."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    table = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in LANG3.items()))
    return F.nullif(F.coalesce(F.try_element_at(table, base), base), F.lit(""))


class LongestMatchCounter:
    """Exact number of tokens of greedy longest-match tokenisation over a byte vocabulary that holds all single bytes."""

    def __init__(self, vocabulary: list[bytes]):
        step: dict[int, int] = {}
        ends = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for token in vocabulary:
            node = 0
            for byte in token:
                nxt = step.get(node << 8 | byte)
                if nxt is None:
                    nxt = len(ends)
                    step[node << 8 | byte] = nxt
                    ends.append(False)
                    children.append([])
                    children[node].append((byte, nxt))
                node = nxt
            ends[node] = True
        emitted, fail = [0] * len(ends), [-1] * len(ends)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent]:
                    below.append(node)
                    if ends[node]:
                        emitted[node], fail[node] = 1, 0
                        continue
                    n, at = emitted[parent], fail[parent]
                    while at >= 0 and (at << 8 | byte) not in step:
                        n += emitted[at]
                        at = fail[at]
                    if at >= 0:
                        emitted[node], fail[node] = n, step[at << 8 | byte]
            level = below
        self.step, self.emitted, self.fail = step, emitted, fail
        self.cache: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        step, emitted, fail = self.step, self.emitted, self.fail
        node = n = 0
        for byte in word:
            nxt = step.get(node << 8 | byte)
            while nxt is None:
                if node == 0:  # a byte that is no token: counts as one, as an unknown does
                    n += 1
                    nxt = 0
                    break
                if fail[node] < 0:  # inside a token whose beginning is no token
                    n += 1
                    node = 0
                else:
                    n += emitted[node]
                    node = fail[node]
                nxt = step.get(node << 8 | byte)
            node = nxt
        while node > 0:
            n += emitted[node] if fail[node] >= 0 else 1
            node = max(fail[node], 0)
        return n

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split = [words_of(t) if t else [] for t in texts]
        cache = self.cache
        new = set(chain.from_iterable(split)).difference(cache)
        if new:
            if len(cache) > MAX_WORDS:
                cache.clear()
                new = set(chain.from_iterable(split))
            for w in new:
                cache[w] = self.count(w.encode("utf-8", "surrogatepass"))
        get = cache.__getitem__
        out = [sum(map(get, words)) for words in split]
        for w in new:
            if len(w) > KEPT_BYTES:
                del cache[w]
        return out


_counters: dict[int, LongestMatchCounter] = {}


def worker_counter(raw: bytes) -> LongestMatchCounter:
    key = hash(raw)
    if key not in _counters:
        _counters.clear()
        _counters[key] = LongestMatchCounter(list(parse_ranks(raw)))
    return _counters[key]


def longest_match_counts(df: DataFrame, keep: dict[str, Column], text: Column, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep``, the characters of the text (null for a null text) and its longest-match tokens."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))
    names = list(keep)
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(raw.value)
        for batch in batches:
            texts = batch.column(k).to_pylist()
            counts: list[int] = []
            for start, end in text_blocks(texts):
                counts += counter.count_batch(texts[start:end])
            chars = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(chars, pa.int64()), pa.array(counts, pa.int64())], names=[*(f"k{i}" for i in range(k)), "n_chars", "n_tokens"])

    source = df.select(*(keep[name].alias(f"k{i}") for i, name in enumerate(names)), text.cast("string").alias("text"))
    fields = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(k))
    return source.mapInArrow(run, f"{fields}n_chars bigint, n_tokens bigint").select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(names)), "n_chars", "n_tokens")


def chunk_tokens(chunks: DataFrame, config: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per chunk: its counted tokens, the estimate its source type's rate gives, and whether the stored one is usable.

    ``wrong`` is true where the text is not null and the stored estimate is null or another number than
    ``max(1, ceil(n_chars / rate))``; a null text has no estimate and is never wrong; a source type without a rate is
    left undecided (null). Rows delivered twice, which may differ in ``loaded_at``, give one row: the latest, ties by
    stored estimate. Empty texts count one estimated and no counted token.
    """
    counted = longest_match_counts(
        chunks,
        {"chunk_id": F.col("chunk_id"), "source_type": normal_type(F.col("source_type")), "source_year": F.col("source_year"), "lang": normal_lang(F.col("lang")), "stored": F.col("estimated_tokens"), "loaded_at": F.col("loaded_at")},
        F.col("text"),
        vocabulary,
    )
    # max over structs instead of a window: partial aggregation before the shuffle, no sort
    value = F.struct("loaded_at", F.col("stored").isNotNull(), "stored", "source_type", "source_year", "lang", "n_chars", "n_tokens")
    unique = counted.groupBy("chunk_id").agg(F.max(value).alias("v")).select("chunk_id", "v.source_type", "v.source_year", "v.lang", "v.stored", "v.n_chars", "v.n_tokens")
    rates = config.select(normal_type(F.col("source_type")).alias("source_type"), F.col("chars_per_token_estimate").alias("rate")).groupBy("source_type").agg(F.max("rate").alias("rate"))
    estimate = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / F.col("rate"))).cast("long")
    return (
        unique.join(rates, "source_type", "left")
        .withColumn("estimate", F.when(F.col("n_chars").isNotNull() & (F.col("rate") > 0), estimate))
        .withColumn("wrong", F.when(F.col("n_chars").isNull(), F.lit(False)).when(F.col("estimate").isNotNull(), ~F.col("stored").cast("long").eqNullSafe(F.col("estimate"))))
        .drop("rate")
    )


def chunk_budget(tokens: DataFrame) -> DataFrame:
    """Totals per source type, year and language (null years and languages are groups of their own)."""
    return tokens.groupBy("source_type", "source_year", "lang").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"),
        F.sum("n_tokens").alias("counted_tokens"),
        F.sum(F.coalesce("estimate", F.lit(0))).alias("estimated_tokens"),
        F.sum(F.coalesce(F.col("stored").cast("long"), F.lit(0))).alias("stored_tokens"),
        F.count_if(F.col("wrong")).alias("n_wrong"),
    )


def document_budget(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Totals per source, language and domain of a corpus with unique ids; null and empty texts count as documents."""
    counted = longest_match_counts(documents, {"source": F.col("source"), "lang": normal_lang(F.col("lang")), "domain": F.col("domain")}, F.col("text"), vocabulary)
    return counted.groupBy("source", "lang", "domain").agg(
        F.count("*").alias("n_docs"), F.count_if(F.coalesce("n_chars", F.lit(0)) == 0).alias("n_empty"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"), F.sum("n_tokens").alias("counted_tokens")
    )
