"""Section-aware pieces of documents with identifiers that do not move when rules change."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import classify

#: Sizes in estimated tokens (four characters each) (fixed values).
TARGET, MOST, LEAST, CARRY = 800, 1000, 15, 0.15
CHARS_PER_TOKEN = 4
#: Words of a slice of a sentence without stops, and longest section name.
SLICE_WORDS, NAME_CHARS = TARGET * CHARS_PER_TOKEN // 7, 200
ABSTRACT_SECTION = "Resumen"

_SKIPPED = re.compile("(?i)" + classify.SKIPPED_SECTION)
_ADMIN = re.compile("(?i)" + classify.ADMIN_SECTION)
_FILLER = re.compile("(?i)" + classify.FILLER)
_LABEL = re.compile("(?i)" + classify.TABLE_LABEL)
_STOP = re.compile(r"(?<=[.;])\s+")


def size(text: str) -> int:
    return max(1, len(text) // CHARS_PER_TOKEN)


def is_table(line: str) -> bool:
    """As :func:`attestry.functions.classify.is_table_line`, for one line."""
    if _LABEL.match(line):
        return True
    n = len(line)
    return n >= 400 and sum(c.isdigit() or c in "±×−-/()[]%" for c in line) > 0.12 * n and len(re.findall(r"[.;]\s+[A-Z]", line)) < n / 600


def pack(parts: Iterable[str], glue: str, most: int, carried: Callable[[str, str], bool]) -> list[str]:
    """Parts joined up to a size; the last of a full piece also starts the next one if ``carried`` says so
    of it and of the part that comes."""
    out: list[list[str]] = []
    room = 0  # characters of the open piece
    for part in parts:
        if out and max(1, (room + len(glue) + len(part)) // CHARS_PER_TOKEN) <= most:
            out[-1].append(part)
            room += len(glue) + len(part)
            continue
        last = out[-1][-1] if out else None
        out.append([last, part] if last is not None and carried(last, part) else [part])
        room = len(glue.join(out[-1]))
    return [glue.join(p) for p in out]


def _slices(sentence: str) -> list[str]:
    """A sentence, or slices by words of one without stops that is too long."""
    if size(sentence) <= MOST:
        return [sentence]
    words = sentence.split()
    return [" ".join(words[i : i + SLICE_WORDS]) for i in range(0, len(words), SLICE_WORDS)]


def pieces_of(body: str) -> list[str]:
    """Pieces of a section: ordinary lines together up to MOST, tables alone and uncut at any size, a line
    that is too long by its sentences up to TARGET."""
    kind = lambda line: "table" if is_table(line.strip()) else "long" if size(line) > MOST else "line"
    short = 2 * CARRY * TARGET
    out: list[str] = []
    for what, run in itertools.groupby((x for x in body.split("\n") if x.strip()), kind):
        if what == "table":
            out += [line.strip() for line in run]
        elif what == "line":
            out += pack(run, "\n", MOST, lambda last, line: size(last) <= short and size(f"{last}\n{line}") <= MOST)
        else:
            for line in run:
                out += pack([p for s in _STOP.split(line) for p in _slices(s)], " ", TARGET, lambda last, _: size(last) < short)
    return [p for p in out if p.strip()]


def sections_of(title: str, abstract: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(name, what is cut, kind) of the parts of a document that are cut at all; a kind is ``abstract``,
    ``section`` or ``heading``, a section without anything under its name."""
    if len(abstract) >= classify.MIN_ABSTRACT:
        yield ABSTRACT_SECTION, f"{title}\n{abstract}".strip(), "abstract"
    if not text or _FILLER.search(text):
        return
    for part in re.split(r"(?m)^## ", text):
        head, _, body = part.partition("\n")
        name = head.strip() or "Texto"
        if part.strip() and not _SKIPPED.match(name):
            yield (name, body, "section") if body.strip() else (name, part, "heading")


def left_out(name: str, piece: str, kind: str) -> str | None:
    """Why a piece is left out, or None: the first of the rules that holds. The abstract always stays."""
    if kind == "abstract":
        return None
    rules = {"title_only": kind == "heading", "administrative": bool(_ADMIN.match(name)), "too_short": size(piece) < LEAST and not is_table(piece.strip())}
    return next((why for why, holds in rules.items() if holds), None)


def chunk_document(title: str | None, abstract: str | None, text: str | None) -> list[tuple[int, str, str, str | None]]:
    """(ordinal, section, piece, reason it is left out or None). Pieces that are left out keep their
    ordinal, so other identifiers never move; skipped sections use none."""
    found = [(name, piece, kind) for name, cut, kind in sections_of(title or "", abstract or "", text or "") for piece in pieces_of(cut)]
    return [(i, name[:NAME_CHARS], piece, left_out(name, piece, kind)) for i, (name, piece, kind) in enumerate(found, 1)]


_CHUNKS = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]))


@F.pandas_udf(_CHUNKS)
def chunks_of(title: pd.Series, abstract: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([chunk_document(t, a, x) for t, a, x in zip(title, abstract, text)])


def chunk(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "doc_type")) -> DataFrame:
    """One row per piece: the kept columns, chunk_id (``doc_id#ordinal``), ordinal, section, text, reason.

    Null and empty texts give no piece. No shuffle: every piece is made where its document is read.
    """
    rows = docs.withColumn("_c", F.explode(chunks_of("title", "abstract", "full_text")))
    return rows.select(*keep, F.concat_ws("#", F.col("doc_id"), F.col("_c.ordinal").cast("string")).alias("chunk_id"), "_c.ordinal", "_c.section", "_c.text", "_c.reason")


def label(chunks: DataFrame) -> DataFrame:
    """Pieces with topic, second topic, kind of evidence, language and quality marks, all in the JVM."""
    text, section = F.col("text"), F.col("section")
    # a generator of one row: what it makes is computed once, whatever reads it
    scored = chunks.select("*", F.explode(F.array(classify.top_topics(classify.topic_scores(text, section)))).alias("_t")).withColumn("is_table", classify.is_table_line(F.trim(text)))
    structural = F.col("doc_type").isin("structure", "prediction")
    return scored.select(
        *chunks.columns, "is_table", F.when(~structural, F.col("_t.subtopic")).alias("subtopic"), F.when(~structural, F.col("_t.subtopic_secondary")).alias("subtopic_secondary"),
        classify.evidence_type(section, F.col("doc_type"), F.col("is_table")).alias("evidence_type"),
        F.when(structural, "en").otherwise(classify.language(text)).alias("language"), classify.quality_marks(text, section).alias("marks"),
    )
