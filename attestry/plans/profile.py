"""Profile of the staging table: counts, duplicates, usable text, licences and topical signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.tables import read


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _size(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit("")))


def profile_total(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"))


def profile_by_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").groupBy("source", "doc_type").agg(
        F.count("*").alias("docs"), F.count_if(_size("full_text") > 0).alias("with_text"),
        F.count_if(_given("doi")).alias("with_doi"), F.count_if("is_open_access").alias("open_access"),
    )


def profile_by_year(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").where("year >= 2015").groupBy("year").agg(F.count("*").alias("docs")).orderBy("year")


def profile_no_year(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").where("year IS NULL").agg(F.count("*").alias("docs"))


def profile_dois(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").agg(F.count_distinct(F.when(_given("doi"), F.col("doi"))).alias("dois"), F.count_if(~_given("doi")).alias("without_doi"))


def profile_doi_repeats(spark: SparkSession, d: str) -> DataFrame:
    groups = read(spark, d, "documents_staging").where(_given("doi")).groupBy("doi").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("repeated"), F.sum("n").alias("rows_involved"), (F.sum("n") - F.count("*")).alias("surplus"))


def profile_doi_sources(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "documents_staging").where(_given("doi")).groupBy("doi").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    return sets.groupBy(F.array_join("s", "+").alias("sources")).agg(F.count("*").alias("dois"))


def profile_hash_repeats(spark: SparkSession, d: str) -> DataFrame:
    groups = read(spark, d, "documents_staging").where(~_given("doi") & _given("content_hash")).groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("repeated"), (F.sum("n") - F.count("*")).alias("surplus"))


def profile_usable_text(spark: SparkSession, d: str) -> DataFrame:
    short, none = _size("abstract") < 50, _size("full_text") == 0
    return read(spark, d, "documents_staging").agg(F.count_if(short & none).alias("nothing"), F.count_if(~none).alias("with_text"), F.count_if(~short & none).alias("abstract_only"))


def profile_licenses(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.nullif("license", F.lit("")), F.lit("(sin declarar)")).alias("license")
    return read(spark, d, "documents_staging").groupBy(name).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "license").limit(15)


def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").agg(F.count_if(F.col("full_text").contains("## ")).alias("with_sections"), F.round(F.avg(F.when(_size("full_text") > 0, F.length("full_text")))).alias("mean_length"))


#: Topical signals (fixed values).
SIGNALS = {
    "explicit": r"petase|pet hydrolase|poly\(ethylene terephthalate\) hydrolase",
    "related": "cutinase|mhetase|lipase|esterase",
    "recycling": "recycl|circular economy|waste management",
}


def profile_signals(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    return read(spark, d, "documents_staging").agg(*[F.count_if(text.rlike(p)).alias(k) for k, p in SIGNALS.items()])


def profile_fetched_by(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").groupBy("fetched_by").agg(F.count("*").alias("docs"))


def staging_stats(spark: SparkSession, d: str) -> DataFrame:
    """Staging by source and type, with the documents of each that are curated."""
    curated = read(spark, d, "documents_curated").select("doc_id").distinct().withColumn("is_curated", F.lit(True))
    return read(spark, d, "documents_staging").join(curated, "doc_id", "left").groupBy("source", "doc_type").agg(
        F.count("*").alias("docs"), F.count_distinct(F.when(_given("doi"), F.col("doi"))).alias("dois"), F.count_distinct(F.when(F.col("is_curated"), F.col("doc_id"))).alias("curated_docs"),
    )


def search_staging(spark: SparkSession, d: str) -> DataFrame:
    """Title or abstract holds a word, newest first; the report's limit is part of the query (1 to 50)."""
    found = read(spark, d, "documents_staging").where(F.col("title").ilike("%hydrolase%") | F.col("abstract").ilike("%hydrolase%"))
    return found.select("doc_id", "source", "year").distinct().orderBy(F.desc_nulls_last("year"), "doc_id").limit(50)


QUERIES = {f.__name__: f for f in (
    profile_total, profile_by_source, profile_by_year, profile_no_year, profile_dois, profile_doi_repeats, profile_doi_sources,
    profile_hash_repeats, profile_usable_text, profile_licenses, profile_sections, profile_signals, profile_fetched_by, staging_stats, search_staging,
)}

SQL = {
    "profile_total": "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents_staging",
    "profile_by_source": """SELECT source, doc_type, count(*) AS docs, count(*) FILTER (length(coalesce(full_text,'')) > 0) AS with_text,
        count(*) FILTER (coalesce(doi,'') <> '') AS with_doi, count(*) FILTER (is_open_access) AS open_access FROM documents_staging GROUP BY ALL""",
    "profile_by_year": "SELECT year, count(*) AS docs FROM documents_staging WHERE year >= 2015 GROUP BY year ORDER BY year",
    "profile_no_year": "SELECT count(*) AS docs FROM documents_staging WHERE year IS NULL",
    "profile_dois": "SELECT count(DISTINCT nullif(doi,'')) AS dois, count(*) FILTER (coalesce(doi,'') = '') AS without_doi FROM documents_staging",
    "profile_doi_repeats": """WITH g AS (SELECT doi, count(*) AS n FROM documents_staging WHERE coalesce(doi,'') <> '' GROUP BY doi HAVING count(*) > 1)
        SELECT count(*) AS repeated, sum(n)::BIGINT AS rows_involved, (sum(n) - count(*))::BIGINT AS surplus FROM g""",
    "profile_doi_sources": """WITH g AS (SELECT string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM documents_staging WHERE coalesce(doi,'') <> ''
        GROUP BY doi HAVING count(DISTINCT source) > 1) SELECT sources, count(*) AS dois FROM g GROUP BY sources""",
    "profile_hash_repeats": """WITH g AS (SELECT count(*) AS n FROM documents_staging WHERE coalesce(doi,'') = '' AND coalesce(content_hash,'') <> ''
        GROUP BY content_hash HAVING count(*) > 1) SELECT count(*) AS repeated, (sum(n) - count(*))::BIGINT AS surplus FROM g""",
    "profile_usable_text": """SELECT count(*) FILTER (length(coalesce(abstract,'')) < 50 AND length(coalesce(full_text,'')) = 0) AS nothing,
        count(*) FILTER (length(coalesce(full_text,'')) > 0) AS with_text,
        count(*) FILTER (length(coalesce(abstract,'')) >= 50 AND length(coalesce(full_text,'')) = 0) AS abstract_only FROM documents_staging""",
    "profile_licenses": "SELECT coalesce(nullif(license,''),'(sin declarar)') AS license, count(*) AS docs FROM documents_staging GROUP BY 1 ORDER BY docs DESC, license LIMIT 15",
    "profile_sections": """SELECT count(*) FILTER (contains(full_text, '## ')) AS with_sections,
        round(avg(length(full_text)) FILTER (length(coalesce(full_text,'')) > 0)) AS mean_length FROM documents_staging""",
    "profile_signals": "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(lower(concat_ws(' ', title, abstract)), '{p}')) AS {k}" for k, p in SIGNALS.items()) + " FROM documents_staging",
    "profile_fetched_by": "SELECT fetched_by, count(*) AS docs FROM documents_staging GROUP BY 1",
    "staging_stats": """SELECT source, doc_type, count(*) AS docs, count(DISTINCT nullif(doi,'')) AS dois,
        count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM documents_curated WHERE doc_id IS NOT NULL)) AS curated_docs FROM documents_staging GROUP BY ALL""",
    "search_staging": """SELECT DISTINCT doc_id, source, year FROM documents_staging WHERE title ILIKE '%hydrolase%' OR abstract ILIKE '%hydrolase%'
        ORDER BY year DESC NULLS LAST, doc_id LIMIT 50""",
}
