"""Splitting oversized sections at natural boundaries (problem 2).

Every position of a section has a boundary strength (paragraph, line, sentence, clause, word, none). A
sparse table answers "the strongest boundary of this window, the right one of equals" in constant
time; the next piece starts an overlap or up to a quarter more before the last cut, at the strongest
boundary there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest piece, least overlap of neighbours and least piece, in characters.
LIMIT, OVERLAP, LEAST = 4000, 200, 2000
#: Most that neighbours overlap, as a multiple of the least.
STRETCH = 1.25

_HEADING = re.compile(r"^## .*$", re.M)
#: Boundaries, strongest first; a cut is at the end of the match.
_BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]*\n\s*")),
    (4, re.compile(r"\n\s*")),
    (3, re.compile(r"[.!?…。！？]+[\"'»”)\]]*\s+|[。！？]")),
    (2, re.compile(r"[;:,،、；，]\s+|\s[–—]\s+")),
    (1, re.compile(r"\s+")),
)


def sections(text: str) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each section without outer white space; 0 is what precedes the first
    heading. Sections without text have start = end."""
    start, number = 0, 0
    for m in _HEADING.finditer(text):
        yield number, *_stripped(text, start, m.start())
        start, number = m.end(), number + 1
    yield number, *_stripped(text, start, len(text))


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    lead = len(part) - len(part.lstrip())
    return (a + lead, a + lead + len(part.strip())) if part.strip() else (a, a)


@dataclass(frozen=True)
class BoundaryIndex:
    """Range maximum over boundary strengths; ``at`` holds the cut positions in order."""

    at: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, text: str, reach: int) -> BoundaryIndex:
        """Index of ``text`` for windows of up to ``reach`` characters."""
        strength = np.zeros(len(text) + 1, np.int8)
        for weight, pattern in _BOUNDARIES:
            ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
            strength[ends] = np.maximum(strength[ends], weight)
        at = np.flatnonzero(strength)
        # strength first, position second: the maximum is the strongest boundary, rightmost of equals
        level = strength[at].astype(np.int64) * (len(text) + 1) + at
        levels, width = [level], 1
        while 2 * width <= min(reach + 1, len(at)):
            level = np.maximum(level[:-width], level[width:])
            levels.append(level)
            width *= 2
        return cls(at, levels)

    def strongest(self, low: int, high: int, size: int) -> int | None:
        """Position of the strongest boundary in low..high; None if there is none."""
        i, j = np.searchsorted(self.at, (low, high + 1))
        if i >= j:
            return None
        k = int(j - i).bit_length() - 1
        table = self.levels[k]
        return int(max(table[i], table[j - (1 << k)]) % (size + 1))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``limit`` characters that cover ``text``.

    A piece ends at the strongest boundary from ``least`` to ``limit`` characters, the rightmost of
    equals; without one it is cut at the limit. The next piece starts at the strongest boundary from
    ``overlap`` to STRETCH times as many characters before that end, the rightmost of equals, or exactly
    ``overlap`` before it; so neighbours share ``overlap`` characters at least.
    """
    if not 0 <= overlap * STRETCH < least <= limit:
        raise ValueError("0 <= STRETCH * overlap < least <= limit is needed")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    index = BoundaryIndex.of(text, limit)
    out, start = [], 0
    while n - start > limit:
        end = index.strongest(start + least, start + limit, n) or start + limit
        out.append((start, end))
        start = index.strongest(end - int(STRETCH * overlap), end - overlap, n) or end - overlap
    return [*out, (start, n)]


PIECES = T.ArrayType(
    T.StructType([
        T.StructField("section_no", T.IntegerType()), T.StructField("section_chars", T.IntegerType()),
        T.StructField("piece_no", T.IntegerType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()),
        T.StructField("piece", T.StringType()),
    ])
)


def split_document(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple]:
    """Pieces of the sections over the limit. ``ordinal`` counts every piece of the document, so a
    section under the limit uses one number."""
    out, ordinal = [], 0
    for number, a, b in sections(text or ""):
        if b == a:
            continue
        if b - a <= limit:
            ordinal += 1
            continue
        for k, (x, y) in enumerate(split_text(text[a:b], limit, overlap, least), 1):
            ordinal += 1
            out.append((number, b - a, k, ordinal, a + x, a + y, text[a + x : a + y]))
    return out


def split_oversized(docs: DataFrame, text: str = "full_text", key: str = "doc_id", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """One row per piece of each section of more than ``limit`` characters: ``key``, section_no,
    section_chars, piece_no, chunk_id (``key#ordinal``), start_at, end_at (in ``text``), piece.

    Null, empty and short texts give no row; a row repeated with the same key and text gives its pieces
    once, one key with two texts gives both. Other columns are not read. Only texts longer than the
    limit reach Python; the one shuffle drops repeated pieces and carries no others.
    """
    return _pieces(docs, text, key, limit, overlap, least).dropDuplicates([key, "section_no", "piece_no", "start_at", "end_at", "piece"])


def _pieces(docs: DataFrame, text: str, key: str, limit: int, overlap: int, least: int) -> DataFrame:
    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_document(t, limit, overlap, least))

    long = docs.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > limit)
    return long.select(key, F.explode(pieces("_text")).alias("_p")).select(
        key, "_p.section_no", "_p.section_chars", "_p.piece_no",
        F.concat_ws("#", F.col(key).cast("string"), F.col("_p.ordinal").cast("string")).alias("chunk_id"),
        "_p.start_at", "_p.end_at", "_p.piece",
    )


def oversized_sections(docs: DataFrame, text: str = "full_text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, section_no) of the sections that come out in more than one piece. No text is shuffled."""
    pieces = _pieces(docs, text, key, limit, OVERLAP, LEAST)
    return pieces.where((F.col("section_chars") > limit) & (F.col("piece_no") == 2)).select(key, "section_no").distinct()


def brute_force(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """The same pieces without an index, for tests."""
    strength: dict[int, int] = {}
    for weight, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            strength[m.end()] = weight

    def best(a: int, b: int) -> int | None:
        found: Sequence[int] = [i for i in range(a, b + 1) if strength.get(i)]
        return max(found, key=lambda i: (strength[i], i)) if found else None

    out, start = [], 0
    if not text:
        return []
    while len(text) - start > limit:
        end = best(start + least, start + limit) or start + limit
        out.append((start, end))
        start = best(end - int(STRETCH * overlap), end - overlap) or end - overlap
    return [*out, (start, len(text))]
