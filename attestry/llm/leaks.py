"""Evaluation passages that occur in a corpus (problem 9).

Wu-Manber search for many patterns at once. The patterns are the stretches of ``PATTERN_CHARS``
characters at every ``STRIDE``-th place of each item, so a run of ``PATTERN_CHARS + STRIDE - 1`` common
characters holds at least one. A table of block shifts skips the places where no pattern can end, a
bucket of patterns by suffix selects those to test, and comparison confirms them and extends them to
the whole common run. Runs of one item that follow each other in both texts, but for single words,
form a stretch; a document leaks an item when its two largest stretches carry enough of the item.

Case, spacing, punctuation, accents and marks are taken out of both texts before the search.
"""

from __future__ import annotations

import functools
import os.path
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a pattern and distance of patterns in an item.
PATTERN_CHARS, STRIDE = 20, 4
#: Characters of a block of the shift table.
BLOCK = 6
#: Characters that one stretch may skip in either text (single changed or added words).
GAP_CHARS = 40
#: Least characters of a stretch, and least share of the item in its two largest stretches.
STRETCH_CHARS, SHARE = 40, 0.42
#: Characters of items that are searched for in one pass; more items take more passes. An item of n
#: characters has n / STRIDE patterns and at most n blocks in the shift table, which is about 200 bytes a
#: character, 200 MB a pass in each Python worker (measured: test_index_is_bounded).
ITEM_CHARS_PER_PASS = 1_000_000

_FOLD: dict[int, str | None] = {}


def squeezed(text: str) -> str:
    """Letters and digits only, in lower case, without accents."""
    text = text.casefold() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).casefold()
    return "".join(filter(str.isalnum, text))


class WuManber:
    """Search for many items; ``items`` are (id, squeezed text)."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        self.items = {i: t for i, t in items if t}
        longest = [(i, t) for i, t in self.items.items() if len(t) >= PATTERN_CHARS]
        self.tables = [_Table(PATTERN_CHARS, BLOCK, ((t[k : k + PATTERN_CHARS], i, k) for i, t in longest for k in range(0, len(t) - PATTERN_CHARS + 1, STRIDE)))]
        short: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
        for i, t in self.items.items():
            if len(t) < PATTERN_CHARS:
                short[len(t)].append((t, i, 0))
        self.tables += [_Table(m, min(BLOCK, m), found) for m, found in short.items()]

    def runs(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """Common runs by item: (place in text, place in item, characters)."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        done: dict[tuple[int, int], int] = {}
        for table in self.tables:
            for at, item, place in table.search(text):
                diagonal = (item, at - place)
                if done.get(diagonal, -1) > at:
                    continue  # inside a run that is known
                other = self.items[item]
                back = _common(text[max(0, at - place) : at][::-1], other[:place][::-1])
                ahead = _common(text[at : at + len(other) - place], other[place:])
                out[item].append((at - back, place - back, back + ahead))
                done[diagonal] = at + ahead
        return out

    def leaked(self, text: str) -> list[tuple[int, float, int]]:
        """(item, share of the item carried, stretches) for each item that leaks into a squeezed text."""
        out = []
        for item, runs in self.runs(text).items():
            size = len(self.items[item])
            parts = sorted(stretches(runs), reverse=True)[:2]
            share = min(1.0, sum(parts) / size)
            if share >= SHARE and (sum(parts) >= STRETCH_CHARS or share == 1.0):
                out.append((item, round(share, 4), len(parts)))
        return out


class _Table:
    """Shift and hash tables for patterns of one length ``m``."""

    def __init__(self, m: int, block: int, patterns: Iterable[tuple[str, int, int]]):
        self.m, self.block = m, block
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for text, item, place in patterns:
            for end in range(block, m + 1):
                key, s = text[end - block : end], m - end
                if self.shift.get(key, m) > s:
                    self.shift[key] = s
            self.bucket.setdefault(text[m - block :], {}).setdefault(text, []).append((item, place))

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(place in text, item, place in item) of each pattern that occurs."""
        m, block, shift, far = self.m, self.block, self.shift, self.m - self.block + 1
        end, n = m, len(text)
        while end <= n:
            suffix = text[end - block : end]
            s = shift.get(suffix, far)
            if s:
                end += s
                continue
            for item, place in self.bucket[suffix].get(text[end - m : end], ()):
                yield end - m, item, place
            end += 1


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def stretches(runs: list[tuple[int, int, int]]) -> list[int]:
    """Characters of the item carried by each stretch of runs, least ``STRETCH_CHARS`` unless alone.

    Runs join when both texts go on within ``GAP_CHARS``; a small gap counts as carried (a changed
    word), as far as the smaller of the two gaps goes. Of joined runs that overlap, each part counts once.
    """
    groups: list[list[int]] = []  # end in text, end in item, characters carried, first place in item
    for at, place, n in sorted(runs):
        best = None
        for g in groups:
            gap_text, gap_item = at - g[0], place - g[1]
            if -n < gap_text <= GAP_CHARS and -n < gap_item <= GAP_CHARS and (best is None or g[2] > best[2]):
                best = g
        if best is None:
            groups.append([at + n, place + n, n, place])
            continue
        gain = place + n - best[1]
        inside = max(0, min(at - best[0], place - best[1]))
        if gain > 0:
            best[2] += min(gain, n + inside)
            best[0], best[1] = at + n, place + n
    # of stretches over the same part of the item only the larger counts
    kept: list[tuple[int, int, int]] = []
    for _, stop, n, first in sorted(groups, key=lambda g: -g[2]):
        if all(stop <= a or b <= first or min(stop, b) - max(first, a) < 0.3 * n for a, b, _ in kept):
            kept.append((first, stop, n))
    return [n for _, _, n in kept if n >= STRETCH_CHARS] or [n for _, _, n in kept[:1]]


@functools.lru_cache(maxsize=2)
def _built(key: tuple[tuple[int, str], ...]) -> WuManber:
    return WuManber(key)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_key, item_key, share, stretches): documents that carry an item.

    Null, empty and blank texts and items give no row; a repeated row counts once; an item listed twice
    counts once; other columns are not read. Every document is read whole, once per pass; a pass holds
    items of up to ``ITEM_CHARS_PER_PASS`` characters, so what is broadcast has that bound however many
    items there are. The only shuffle drops repeated result rows.
    """
    wanted = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-int(total) // ITEM_CHARS_PER_PASS))
    schema = docs.select(doc_key).schema.add(items.schema[item_key]).add("share", "double").add("stretches", "integer")
    found = None
    for p in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p) if passes > 1 else wanted
        known = tuple(sorted({(r.i, s) for r in part.collect() if (s := squeezed(r.t))}))
        one = docs.select(doc_key, text).where(F.col(text).isNotNull()).mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(known), schema.names), schema)
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates([doc_key, item_key])


def _search(known, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(known.value)
        item_type = None
        for batch in batches:
            rows = [(k, *hit) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for hit in index.leaked(squeezed(t))]
            if rows:
                item_type = item_type or (pa.string() if isinstance(rows[0][1], str) else pa.int64())
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=names
                )

    return run
