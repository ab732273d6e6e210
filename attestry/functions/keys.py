"""Identity keys of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.missing import is_missing

#: Kinds of document that hold the same work in different states.
LITERATURE = ("article", "preprint", "thesis", "publication")
#: Kinds that are never copies of one another.
UNGROUPED = ("structure", "prediction")


def doi_key(doi: Column) -> Column:
    """The bare identifier of a DOI, however it is written; null where there is none.

    Letter case, blanks, a resolver address and a ``doi:`` label (in any order and number) go.
    """
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(\s*(https?://)?([a-z0-9.-]+/)?(doi:)?\s*)(?=10\.)", "")
    bare = F.regexp_replace(F.trim(bare), r"[\s.,;]+$", "")
    return F.when(~is_missing(doi) & bare.rlike(r"^10\.\S+/\S+$"), bare).when(~is_missing(doi), bare)


def doi_plain(doi: Column) -> Column:
    """The project's plain rule: trim, lower, then the three prefixes in sequence; '' for null."""
    return F.regexp_replace(
        F.lower(F.trim(F.coalesce(doi, F.lit("")))), r"^(https://doi\.org/)?(http://doi\.org/)?(doi:)?", ""
    )


def kind_key(doc_type: Column) -> Column:
    """``literature`` for the four kinds of one work, else the type itself."""
    kind = F.lower(F.trim(F.coalesce(doc_type, F.lit(""))))
    return F.when(kind.isin(*LITERATURE), F.lit("literature")).otherwise(kind)


def content_key(title: Column, abstract: Column, full_text: Column) -> Column:
    """SHA-256 of title, abstract and full text, one to a line."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title, abstract, full_text)]), 256)
