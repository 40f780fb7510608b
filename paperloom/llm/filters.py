"""Bloom filters of strings, built by aggregation in the JVM and asked in Python workers.

A string enters by its CRC-32, which both sides compute alike and which Python can carry on character by character, so a
walk over prefixes pays one step a character. The table grows with the number of entries up to ``MOST_BITS``; who has
more entries splits them into parts (``parts_for``) and asks one filter after another, so no filter saturates.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one filter at most (32 MB), and bits per entry.
MOST_BITS, BITS_PER_ENTRY = 1 << 28, 16
LEAST_BITS = 1 << 16
# Fixed value: odd multiplier of the second hash, small enough that the product of two hashes fits a long.
_MIX = 0x1E3779B1
#: Marks the end of a whole word among prefixes.
END = "\x00"


def parts_for(entries: int) -> int:
    """Filters needed so that each keeps at least half of ``BITS_PER_ENTRY``."""
    return max(1, -(-entries * BITS_PER_ENTRY // (2 * MOST_BITS)))


class Filter:
    """The table and its size; ``may_hold`` takes a CRC-32."""

    def __init__(self, table: bytes):
        self.table = table
        self.mask = len(table) * 8 - 1
        self.shift = 32 - self.mask.bit_length()

    def may_hold(self, h: int) -> bool:
        a, b = h & self.mask, (h * _MIX & 0xFFFFFFFF) >> self.shift
        t = self.table
        return bool(t[a >> 3] >> (a & 7) & 1 and t[b >> 3] >> (b & 7) & 1)

    def may_hold_text(self, text: str) -> bool:
        return self.may_hold(zlib.crc32(text.encode("utf-8", "surrogatepass")))


def build(entries: DataFrame, column: str, n: int) -> Filter:
    """The filter of the strings of ``column``; ``n`` is about their number (an upper bound does). Nulls do not enter.

    The driver receives one row per 64 bits in use, so at most ``MOST_BITS / 64`` rows.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n) * BITS_PER_ENTRY - 1).bit_length()))
    h = F.crc32(F.col(column).cast("binary"))
    places = F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftright((h * F.lit(_MIX)).bitwiseAND(F.lit(0xFFFFFFFF)), 33 - bits.bit_length()))
    masks = entries.where(F.col(column).isNotNull()).select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    got = masks.toArrow()
    table = np.zeros(bits // 64, dtype="<i8")
    table[got["place"].to_numpy()] = got["mask"].to_numpy()
    return Filter(table.tobytes())


def prefixes(word: Column) -> Column:
    """All prefixes of a word and the word with its end marked."""
    return F.concat(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, F.lit(1), i)), F.array(F.concat(word, F.lit(END))))
