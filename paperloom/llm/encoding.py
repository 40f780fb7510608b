"""Problem 6: encode a whole corpus with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal. The byte-pair encoding of a string is characterised by one fact about each of
its prefixes, the last token of that prefix's encoding: token ``t`` ending at position ``i`` is that last token exactly
if ``t`` forms a compatible pair with the last token of the prefix that precedes it. The distinct words of a batch are
visited in lexicographic order, which is the depth-first order of their trie; the stack of last-token states holds the
current path, so whatever two neighbouring words share as a prefix is computed once. An encoding is read off by
walking the last tokens backwards.

Only distinct words that this worker has not met before enter the traversal; a text is then a chain of lookups. There
is no shuffle: the work is one pass over the texts, and the memory of a worker is bounded by ``MAX_WORDS``.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept by a worker before it starts afresh; bounds its memory, not the result.
MAX_WORDS = 400_000
#: Only shorter words are kept: long ones hardly ever come back.
KEPT_BYTES = 64

# Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNICODE = regex.compile(PATTERN)
#: The same language restricted to ASCII texts, where the standard engine is several times faster.
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\v\f\r A-Za-z0-9]+|[\t\n\v\f\r ]+(?![^\t\n\v\f\r ])|[\t\n\v\f\r ]+")


def read_ranks(path: str) -> bytes:
    """The vocabulary file as bytes; small (under 1 MB for the public ones) and sent to the workers as it is."""
    with open(path, "rb") as f:
        return f.read()


def vocabulary_path(name: str | None = None) -> str:
    name = name or DEFAULT_VOCABULARY
    return name if os.path.sep in name else os.path.join(os.environ.get("PAPERLOOM_TOKENIZERS", DEFAULT_DIR), name)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def words_of(text: str) -> list[str]:
    """Pre-tokens of a text; their concatenation is the text."""
    return _ASCII.findall(text) if text.isascii() else _UNICODE.findall(text)


class TrieEncoder:
    """Byte-pair encoder over distinct words. ``ranks``: token bytes to id, ids in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts = self._parts()
        self.merged = {pair: i for i, pair in self.parts.items() if pair[0] != i}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens each token is merged from: what its bytes come to with the merges of lower rank only."""
        out: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            if len(token) == 1:
                out[rank] = (rank, rank)
            else:
                pieces = self.merge(token, rank)
                out[rank] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else (rank, rank)
        return out

    def merge(self, word: bytes, below: int | None = None) -> list[bytes]:
        """Plain merging of one word, with merges under rank ``below`` only."""
        pieces = [word[i : i + 1] for i in range(len(word))]
        while len(pieces) > 1:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                r = self.ranks.get(pieces[i] + pieces[i + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def pair(self, left: int, right: int) -> bool:
        """True if the two tokens stay as they are when their bytes are encoded together.

        Undoes the merges of both tokens from the latest to the earliest and asks at each step whether the tokens that
        then meet would have merged before.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, 1 << 60, True
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                good = False
                break
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        break
        self.compatible[left, right] = good
        return good

    def learn(self, words: set[str]) -> None:
        """Encode distinct words in the order of their trie and keep the encodings."""
        ranks, cache, pair, longest = self.ranks, self.cache, self.pair, self.longest
        rest = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            i = ranks.get(raw)
            if i is not None:
                cache[w] = (i,)
            else:
                rest.append((raw, w))
        rest.sort()
        path: list[int] = []  # last token of each prefix of the current word
        before = b""
        for raw, w in rest:
            n, k = len(raw), 0
            stop = min(n, len(before))
            while k < stop and raw[k] == before[k]:
                k += 1
            del path[k:]
            for end in range(k + 1, n + 1):
                found = -1
                for start in range(max(0, end - longest), end):
                    t = ranks.get(raw[start:end])
                    if t is not None and (start == 0 or pair(path[start - 1], t)):
                        found = t
                        break
                path.append(found)
            out = []
            at = n
            while at > 0:
                t = path[at - 1]
                out.append(t)
                at -= len(self.tokens[t])
            out.reverse()
            cache[w] = tuple(out)
            before = raw

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [words_of(t) if t else [] for t in texts]
        cache = self.cache
        new = set(chain.from_iterable(split)).difference(cache)
        if new:
            if len(cache) > MAX_WORDS:
                cache.clear()
                self.compatible.clear()
                new = set(chain.from_iterable(split))
            self.learn(new)
        get = cache.__getitem__
        out = [list(chain.from_iterable(map(get, words))) for words in split]
        for w in new:
            if len(w) > KEPT_BYTES:
                del cache[w]
        return out

    def count_batch(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.encode_batch(texts)]


_encoders: dict[int, TrieEncoder] = {}


def worker_encoder(raw: bytes) -> TrieEncoder:
    """The encoder of this Python worker, built once per vocabulary."""
    key = hash(raw)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TrieEncoder(parse_ranks(raw))
    return _encoders[key]


#: Characters encoded at once; bounds a worker's memory whatever the length of the texts.
CHARS_AT_ONCE = 4_000_000


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold a bounded number of characters (one longer text stands alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``id_col`` and ``out_col`` (array of int) for every row of ``docs``.

    Special-token strings in a text are ordinary text; null and empty texts give an empty list; a row with a null id
    keeps it; repeated ids are encoded as often as they occur; other columns of ``docs`` are not read.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(raw.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in text_blocks(texts):
                lists = encoder.encode_batch(texts[start:end])
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), out=offsets[1:])
                values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, ids array<int>").select(F.col("id").alias(id_col), F.col("ids").alias(out_col))


def count_tokens(docs: DataFrame, keep: list[str], vocabulary: str | None = None, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` of every row and the number of tokens of its text (0 for null and empty)."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(raw.value)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            counts: list[int] = []
            for start, end in text_blocks(texts):
                counts += encoder.count_batch(texts[start:end])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(counts, pa.int64())], names=[*(f"k{i}" for i in range(n)), "n"])

    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(n))
    return source.mapInArrow(run, f"{schema}{', ' if n else ''}n bigint").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias(out_col))


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``id_col`` and the text of every row's ids; bytes that are no UTF-8 are replaced, null ids give null."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in parse_ranks(raw.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").select(F.col("id").alias(id_col), F.col("text").alias(out_col))
