"""Duplicate records of one work: every document and the one that stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import classify
from attestry.functions.keys import UNGROUPED, doi_key, kind_key

#: Kinds that are published in versions, each with its own DOI, and least length of a title that tells.
VERSIONED, TITLE_CHARS = ("dataset", "software", "model"), 25


def has_text(text: Column) -> Column:
    return (F.coalesce(text, F.lit("")) != "") & ~F.coalesce(text, F.lit("")).rlike("(?i)" + classify.FILLER)


def membership(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """(doc_id, survivor) of every document: the survivor is the first of its group by ``order`` (larger
    first, then the smaller doc_id). A null key is a group of its own.

    The survivor is found by an aggregate, not by a window, and what it absorbs are rows, not a list, so no
    row grows with a group.
    """
    ranked = rows.select("doc_id", key.alias("_k"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o")).groupBy("doc_id").agg(F.min("_k").alias("_k"), F.max("_o").alias("_o"))
    grouped = ranked.where(F.col("_k").isNotNull())
    best = grouped.groupBy("_k").agg(F.max("_o").alias("_best"))
    first = grouped.join(best, "_k").where(F.col("_o").eqNullSafe(F.col("_best"))).groupBy("_k").agg(F.min("doc_id").alias("survivor"))
    alone = ranked.where(F.col("_k").isNull()).select("doc_id", F.col("doc_id").alias("survivor"))
    return alone.unionByName(grouped.join(first, "_k").select("doc_id", "survivor"))


def deduplicate(staging: DataFrame) -> DataFrame:
    """(doc_id, survivor): every document and the one that stands for it, which is itself if it survives.

    First by DOI or, lacking one, content hash, within a kind; a record with text comes first, then the
    primary source, then the longer text and abstract. Then datasets, software and models with one title
    of 25 characters or more; the repository of origin comes first, then the longer abstract. What a
    record absorbed in the first pass goes along in the second. Structures and predictions stay.
    """
    kind = kind_key(F.col("doc_type"))
    doi = doi_key(F.col("doi"))
    hashed = F.when(F.coalesce("content_hash", F.lit("")) != "", F.concat(F.lit("h:"), "content_hash"))
    key = F.when(~kind.isin(*UNGROUPED), F.concat(kind, F.lit("|"), F.coalesce(F.concat(F.lit("d:"), doi), hashed)))
    order = [has_text(F.col("full_text")).cast("int"), (F.col("source") == "europepmc").cast("int"), F.length(F.coalesce("full_text", F.lit(""))), F.length(F.coalesce("abstract", F.lit("")))]
    first = membership(staging, key, order)
    title = F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{Nd}]+", " "))
    versioned = F.when(F.col("doc_type").isin(*VERSIONED) & (F.length(title) >= TITLE_CHARS), title)
    kept = staging.select("doc_id", "source", "doc_type", "title", "abstract").join(first.where("doc_id = survivor").select("doc_id"), "doc_id", "left_semi")
    second = membership(kept, versioned, [(F.col("source") == "zenodo").cast("int"), F.length(F.coalesce("abstract", F.lit("")))])
    moved = second.select(F.col("doc_id").alias("survivor"), F.col("survivor").alias("_last"))
    return first.join(moved, "survivor").select("doc_id", F.col("_last").alias("survivor"))


def surviving_rows(staging: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``staging`` per surviving document: of its rows the one fetched last. Rows are told apart
    by their place in their file (``staging`` must be read from files), so what is compared is narrow and
    texts move once, to the join."""
    place = ("_metadata.file_path", "_metadata.row_index")
    rows = staging.select("*", F.col(place[0]).alias("_file"), F.col(place[1]).alias("_row"))
    last = rows.groupBy("doc_id").agg(F.max(F.struct("fetched_at", "_file", "_row")).alias("_w"))
    chosen = last.join(members.where("doc_id = survivor").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("_w._file").alias("_file"), F.col("_w._row").alias("_row"))
    return rows.join(chosen, ["doc_id", "_file", "_row"], "left_semi").drop("_file", "_row")
