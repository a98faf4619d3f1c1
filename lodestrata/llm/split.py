"""Splitting oversized items at natural boundaries.

Every byte position of a text gets a boundary strength; a sparse table answers "strongest cut in this window, the
rightmost of equals" in constant time, so a text of any length is cut in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of a cut before a byte, weakest first.
MID_CHAR, CHAR, SPACE, CLAUSE, STATEMENT, LINE, OUTER_LINE, BLANK_LINE = -1, 0, 1, 2, 3, 4, 5, 6
#: Bytes indexed at once, so a text of many megabytes needs no table of its own size.
SEGMENT = 1 << 17


def strengths(b: np.ndarray) -> np.ndarray:
    """Strength of a cut before each byte of ``b`` (uint8 UTF-8); position 0 is never asked for."""
    n = len(b)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    prev, cur = b[:-1], b[1:]
    before = np.concatenate(([0], b[:-2]))
    s = out[1:]
    blank = (prev == 32) | (prev == 9)
    s[blank] = SPACE
    s[np.isin(prev, np.frombuffer(b",:)]>|", np.uint8))] = CLAUSE
    s[np.isin(prev, np.frombuffer(b";}", np.uint8))] = STATEMENT
    s[blank & np.isin(before, np.frombuffer(b".!?;", np.uint8))] = STATEMENT
    feed = (prev == 10) | ((prev == 13) & (cur != 10))
    s[feed] = LINE
    outer = feed & ~np.isin(cur, np.frombuffer(b" \t\r\n)]}", np.uint8))
    s[outer] = OUTER_LINE
    third = np.concatenate(([0, 0], b[:-3])) if n > 2 else np.zeros(n - 1, np.uint8)
    s[feed & ((before == 10) | ((before == 13) & (third == 10)) | ((before == 13) & (prev == 13)))] = BLANK_LINE
    s[(prev == 13) & (cur == 10)] = CHAR
    s[(cur & 0xC0) == 0x80] = MID_CHAR
    return out


class RangeMax:
    """Sparse table over boundary strengths; ties go to the right."""

    def __init__(self, strength: np.ndarray) -> None:
        n = len(strength)
        self.n = n
        level = strength * n + np.arange(n)
        self.levels = [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the strongest cut in [lo, hi]."""
        k = (hi - lo + 1).bit_length() - 1
        key = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return key % self.n, key // self.n


def cut(data: bytes, limit: int, overlap: int, slack: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of pieces of at most ``limit`` bytes covering ``data``.

    A cut falls in the upper half of what the limit permits; the next piece starts ``overlap`` bytes earlier, moved
    by at most ``slack`` to a boundary.
    """
    b = np.frombuffer(data, np.uint8)
    n, start, pieces = len(b), 0, []
    base, index = 0, None
    while n - start > limit:
        if index is None or start + limit >= base + index.n:
            base = max(0, start - 1)
            index = RangeMax(strengths(b[max(0, base - 3) : base + max(SEGMENT, 2 * limit)])[base - max(0, base - 3) :])
        end, strength = index.best(start + limit // 2 - base, min(start + limit, base + index.n - 1) - base)
        pieces.append((start, base + end, strength))
        again = end - overlap
        start = base + index.best(again - slack, again + slack)[0]
    pieces.append((start, n, BLANK_LINE))
    return pieces


SCHEMA = "chunk_id string, piece_index int, start_byte bigint, end_byte bigint, cut_strength int"


def split_oversized(chunks: DataFrame, limit: int = 4096, overlap: int = 256, slack: int = 64, with_text: bool = True) -> DataFrame:
    """Pieces of every chunk whose text is over ``limit`` bytes of UTF-8, with byte offsets in the file.

    Columns: chunk_id, piece_index, start_byte, end_byte, cut_strength, text.  A repeated chunk row gives its pieces
    once.  A null or short text gives no rows; a null chunk_id is kept as a key of its own; a null start_byte counts
    as 0.  Only chunk_id, start_byte and text are read, whatever else the table has.  Pieces never split a character
    and neighbours share ``overlap`` bytes give or take ``slack``.  ``with_text`` = False leaves the column text out, and no
    text is shuffled then.
    """
    if limit < 4 * (overlap + slack + 4):
        raise ValueError("limit must be at least four times overlap plus slack")
    big = chunks.select("chunk_id", F.coalesce("start_byte", F.lit(0)).cast("bigint").alias("at"), "text").where(F.octet_length("text") > limit)
    if with_text:
        big = big.dropDuplicates(["chunk_id", "at", "text"])
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *((pa.string(),) if with_text else ()))
    names = ["chunk_id", "piece_index", "start_byte", "end_byte", "cut_strength", *(("text",) if with_text else ())]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cid, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                out += [(cid, k, at + s, at + e, g, *((data[s:e].decode(),) if with_text else ())) for k, (s, e, g) in enumerate(cut(data, limit, overlap, slack))]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = big.mapInArrow(pieces, SCHEMA + (", text string" if with_text else ""))
    return rows if with_text else rows.distinct()
