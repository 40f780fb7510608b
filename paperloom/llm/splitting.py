"""Problem 5: cut oversized texts into pieces under a limit, at natural boundaries, with a fixed overlap.

Method: dynamic programming over boundary positions. The candidate cuts of a text are its natural boundaries, each with
a penalty (paragraph under line under sentence under clause under word); where no boundary lies within reach, hard cuts
on a grid are added. A cut chain is feasible if every piece, with the overlap it repeats from its predecessor, is within
the limit. Among feasible chains the one with the least sum of cut penalties and squared deviations from the even piece
size is taken.

Only texts above their limit reach Python; the rest is decided by a length comparison inside the scan stage.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.token_budget import normal_type

#: Penalties of a cut by the kind of boundary it is made at, relative to a deviation by one whole piece size (1.0).
PENALTY = {"paragraph": 0.0, "line": 0.05, "sentence": 0.1, "clause": 0.5, "word": 1.0, "hard": 4.0}
#: Cost of each further piece: chains with fewer pieces are preferred.
PIECE_COST = 0.5

_BOUNDARIES = [
    ("paragraph", regex.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")),
    ("line", regex.compile(r"\r\n|\n|\r")),
    ("sentence", regex.compile(r"[.!?][\"'”’)\]]*\s+|[。！？]\s*")),
    ("clause", regex.compile(r"[;:,]\s+|[，；：、]")),
    ("word", regex.compile(r"\s+")),
]


def boundaries(text: str, reach: int) -> tuple[list[int], list[float]]:
    """Positions where a cut may fall and their penalties; consecutive ones are at most ``reach`` apart.

    Finer kinds of boundaries are used only inside stretches that coarser ones leave longer than half the reach.
    """
    n = len(text)
    best: dict[int, float] = {}
    gaps = [(0, n)]
    for kind, pattern in _BOUNDARIES:
        rest = []
        for a, b in gaps:
            found = [m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b]
            for p in found:
                best.setdefault(p, PENALTY[kind])
            edges = [a, *found, b]
            rest += [(x, y) for x, y in zip(edges, edges[1:]) if y - x > reach // 2]
        gaps = rest
        if not gaps:
            break
    for a, b in gaps:
        last = a
        for grid in range(a + max(1, reach // 8), b, max(1, reach // 8)):
            p = grid
            while p > last and (unicodedata.combining(text[p]) or (text[p - 1] == "\r" and text[p] == "\n")):
                p -= 1
            if p <= last:  # no room to keep a character whole under this limit
                p = grid
            best.setdefault(p, PENALTY["hard"])
            last = p
    positions = sorted(best)
    return positions, [best[p] for p in positions]


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of an oversized text, the last being its length."""
    n = len(text)
    reach = limit - overlap
    if n <= limit:
        return [n]
    positions, penalty = boundaries(text, reach)
    positions.append(n)
    penalty.append(0.0)
    pieces = -(-(n - overlap) // reach)
    even = (n - overlap) / pieces
    cost = [float("inf")] * len(positions)
    came = [-1] * len(positions)
    for i, p in enumerate(positions):
        if p <= limit:  # the first piece repeats nothing
            cost[i] = penalty[i] + PIECE_COST + ((p - overlap - even) / even) ** 2
        lo = bisect_left(positions, p - reach)
        # a piece must bring something new beyond its overlap, and the overlap must exist in what precedes
        for j in range(lo, i):
            if positions[j] >= overlap and cost[j] < float("inf"):
                c = cost[j] + penalty[i] + PIECE_COST + ((p - positions[j] - even) / even) ** 2
                if c < cost[i]:
                    cost[i], came[i] = c, j
    ends = []
    i = len(positions) - 1
    while i >= 0:
        ends.append(positions[i])
        i = came[i]
    return ends[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a piece starts ``overlap`` characters before its predecessor ends."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    ends = cut_points(text, limit, overlap)
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


def oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Chunks above the limit of their source type, with limit and overlap; the test is made before any shuffle."""
    rules = config.select(normal_type(F.col("source_type")).alias("rule_type"), F.col("max_chunk_chars").alias("limit"), F.col("overlap_chars").alias("overlap")).groupBy("rule_type").agg(F.min("limit").alias("limit"), F.min("overlap").alias("overlap"))
    source = chunks.select("chunk_id", "semantic_path", normal_type(F.col("source_type")).alias("source_type"), "text", "loaded_at")
    return source.join(rules, source["source_type"] == rules["rule_type"]).where(F.length("text") > F.col("limit")).drop("rule_type")


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Pieces of every text that exceeds the limit of its source type.

    Columns: chunk_id, piece_no (from 1), n_pieces, semantic_path, start, end, text. A chunk delivered twice is split
    once (the latest delivery, ties by text). Null texts, texts within the limit and source types without a limit give
    no rows; an overlap of the limit or more counts as the limit less one; extra columns are ignored.
    """
    value = F.struct("loaded_at", "text", "semantic_path", "limit", "overlap")
    source = oversized(chunks, config).groupBy("chunk_id").agg(F.max(value).alias("v")).select("chunk_id", "v.*").select("chunk_id", "semantic_path", "text", "limit", "overlap")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                spans = split_text(row.text, int(row.limit), int(row.overlap) if pd.notna(row.overlap) else 0)
                yield pd.DataFrame(
                    {"chunk_id": row.chunk_id, "piece_no": range(1, len(spans) + 1), "n_pieces": len(spans), "semantic_path": row.semantic_path, "start": [a for a, _ in spans], "end": [b for _, b in spans], "text": [row.text[a:b] for a, b in spans]}
                )

    return source.mapInPandas(run, "chunk_id string, piece_no int, n_pieces int, semantic_path string, start int, end int, text string")


def reassembled(pieces: DataFrame) -> DataFrame:
    """(chunk_id, text, n_pieces, longest, overlaps): the text that the pieces of a chunk give when each drops what it
    repeats, the longest piece, and the distinct numbers of characters repeated, ascending."""
    one = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "text")))  # the pieces of one text
    parts = pieces.groupBy("chunk_id").agg(one.alias("p"))
    ends = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["end"]))
    fresh = F.transform("p", lambda x, i: F.substr(x["text"], F.element_at(ends, i + 1) - x["start"] + 1))
    repeated = F.array_sort(F.array_distinct(F.transform(F.slice("p", 2, 1 << 30), lambda x, i: F.element_at(ends, i + 2) - x["start"])))
    return parts.select("chunk_id", F.array_join(fresh, "").alias("text"), F.size("p").alias("n_pieces"), F.array_max(F.transform("p", lambda x: F.length(x["text"]))).alias("longest"), repeated.alias("overlaps"))
