"""Queries pN_... of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.missing import EMPTY_WORDS
from attestry.llm import folding, fusion, leaks, markup, matching, pieces, splits, subjects, tokens
from attestry.tables import read, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The doc_id whose value survives, per duplicate group and field."""
    return fusion.fuse(spark.read.parquet(f"{d}/documents_staging.parquet"), spark.read.parquet(f"{d}/source_ranks.parquet")).select("group_id", "field_name", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections over the size limit."""
    return pieces.oversized_sections(spread(spark.read.parquet(f"{d}/documents_staging.parquet").select("doc_id", "full_text")))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of those sections."""
    return pieces.split_oversized(spread(spark.read.parquet(f"{d}/documents_staging.parquet").select("doc_id", "full_text")))


def _looking(spark: SparkSession, d: str, of: Callable[..., DataFrame]) -> DataFrame:
    out = None
    for table, key, value in (("documents_staging", "doc_id", "full_text"), ("documents_curated", "chunk_id", "chunk_id"), ("mutant_stability", "record_id", "evidence_span")):
        rows = spark.read.parquet(f"{d}/{table}.parquet").select(key, *{value} - {key})
        one = of(spread(rows) if value != key else rows, key, value, f"{table}.{value}")
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that look the same but differ in their characters."""
    return _looking(spark, d, folding.same_looking_pairs)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Forms held in more than one spelling, with the number of records that hold them."""
    return _looking(spark, d, folding.form_classes)


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every curated piece's id in the one form, so that equal-looking ids join."""
    curated = read(spark, d, "documents_curated").select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct()
    return curated.withColumn("chunk_form", folding.canonical_text("chunk_id"))


def _enzymes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/pet_activity_ml.parquet"), spark.read.parquet(f"{d}/enzyme_features.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Enzymes of the related groups that today's cv_split tears apart."""
    return splits.straddling_groups(*_enzymes(spark, d))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Train, validation and test split of every enzyme."""
    return splits.split_enzymes(*_enzymes(spark, d))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with the documents of its work and the confidence of the match."""
    return matching.match_references(spark.read.parquet(f"{d}/bibliography_refs.parquet"), spark.read.parquet(f"{d}/documents_staging.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with the documents of its work."""
    return p6_matches(spark, d).select("ref_id", "doc_id")


MARKED_FIELDS = ("title", "abstract", "full_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup residue per document and field."""
    return markup.residue(spread(spark.read.parquet(f"{d}/documents_staging.parquet").select("doc_id", *MARKED_FIELDS)), "doc_id", MARKED_FIELDS)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Title, abstract and full text of every row as clean text."""
    return markup.clean_fields(spread(spark.read.parquet(f"{d}/documents_staging.parquet").select("doc_id", *MARKED_FIELDS)), "doc_id", MARKED_FIELDS).select("doc_id", "field_name", "clean")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry evaluation items."""
    return leaks.leaked_items(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{d}/eval_items.parquet")).select("doc_id", "item_id")


def p10_areas(spark: SparkSession, d: str) -> DataFrame:
    """Subject areas of every document with their probabilities."""
    return subjects.subject_areas(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels", "subjects")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Subject areas of every document."""
    return p10_areas(spark, d).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_classes": p3_classes, "p3_forms": p3_forms,
    "p4_found": p4_found, "p4_splits": p4_splits, "p6_found": p6_found, "p6_matches": p6_matches, "p7_found": p7_found, "p7_clean": p7_clean,
    "p8_ids": p8_ids, "p9_found": p9_found,
    "p10_found": p10_found, "p10_areas": p10_areas,
}

#: Whole values that stand in for a text in the test tables.
_STANDINS = (
    "PDF only", "N/A", "n/a", "-", "null", "No abstract available.", "Resumen no disponible", "[Abstract missing]", "Full text is held by the publisher and cannot be shown here.",
    "[full text not available]", "Texto completo no disponible.",
)
_BAD = ", ".join(f"'{x}'" for x in _STANDINS)

SQL: dict[str, str] = {
    "p1_found": f"""WITH d AS (SELECT doc_id, any_value(source) AS source, any_value(doc_type) AS dt, any_value(nullif(lower(regexp_replace(trim(doi), '^(https?://[^/]*/|doi:)', '')), '')) AS doi, any_value(content_hash) AS h,
          any_value(full_text) AS ft, any_value(abstract) AS ab, any_value(metadata) AS md, max(fetched_at) AS fa FROM documents_staging GROUP BY 1),
        k AS (SELECT *, CASE WHEN dt IN ('article','preprint','thesis','publication') THEN 'literature' ELSE dt END || coalesce('|d' || doi, '|h' || h) AS k FROM d WHERE dt NOT IN ('structure','prediction')),
        g AS (SELECT k, min(doc_id) AS group_id FROM k GROUP BY 1 HAVING count(*) > 1), m AS (SELECT k.*, group_id, coalesce(trust_rank, 999) AS tr FROM k JOIN g USING (k) LEFT JOIN source_ranks USING (source)),
        c AS (SELECT group_id, doc_id, tr, fa, 'source' AS f, -tr AS v FROM m UNION ALL SELECT group_id, doc_id, tr, fa, 'full_text', length(ft) FROM m WHERE trim(ft) <> '' AND ft NOT IN ({_BAD})
          UNION ALL SELECT group_id, doc_id, tr, fa, 'abstract', length(ab) FROM m WHERE trim(ab) <> '' AND ab NOT IN ({_BAD}) UNION ALL SELECT group_id, doc_id, tr, fa, 'metadata', v FROM (SELECT *, (SELECT count(*) FROM
          (SELECT unnest(json_keys(md)) AS kk) WHERE trim(coalesce(json_extract_string(md, '$."' || kk || '"'), '')) NOT IN ('', 'n/a', '[]')) AS v FROM m WHERE json_valid(md) AND md LIKE '{{%') WHERE v > 0)
        SELECT group_id, f AS field_name, doc_id FROM c QUALIFY row_number() OVER (PARTITION BY group_id, f ORDER BY v DESC, tr, fa DESC, doc_id) = 1""",
    "p4_found": r"""WITH RECURSIVE m AS (SELECT enzyme_id, lower(trim(source_doc_id, ' ')) AS k, cv_split FROM pet_activity_ml WHERE enzyme_id IS NOT NULL),
        q AS (SELECT enzyme_id, regexp_replace(regexp_replace(upper(sequence), '\s+', '', 'g'), '\*+$', '') AS s FROM enzyme_features WHERE enzyme_id IS NOT NULL),
        k AS (SELECT DISTINCT enzyme_id, 'd:' || k AS k FROM m WHERE regexp_replace(k, '^[\s\[\](){}<>]+|[\s\[\](){}<>]+$', '', 'g') NOT IN (""" + ", ".join(f"'{w}'" for w in EMPTY_WORDS) + r""")
          UNION SELECT DISTINCT enzyme_id, 's:' || s FROM q WHERE lower(s) NOT IN (""" + ", ".join(f"'{w}'" for w in EMPTY_WORDS) + r""")),
        hub AS (SELECT k, min(enzyme_id) AS h FROM k GROUP BY 1), e AS (SELECT DISTINCT enzyme_id AS a, h AS b FROM k JOIN hub USING (k) UNION SELECT DISTINCT h, enzyme_id FROM k JOIN hub USING (k)),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT enzyme_id, coalesce(min(b), enzyme_id) AS group_id FROM (SELECT enzyme_id FROM m UNION SELECT enzyme_id FROM q) LEFT JOIN r ON a = enzyme_id GROUP BY enzyme_id),
        bad AS (SELECT group_id FROM m JOIN g USING (enzyme_id) WHERE cv_split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cv_split) > 1) SELECT group_id, enzyme_id FROM g JOIN bad USING (group_id)""",
    "p2_found": r"""WITH s AS (SELECT DISTINCT doc_id, string_split_regex(full_text, '(?m)^## [^\n]*$') AS s FROM documents_staging WHERE length(full_text) > 4000),
        u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS n FROM s) SELECT DISTINCT doc_id, n::INT AS section_no FROM u WHERE length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 4000""",
}
