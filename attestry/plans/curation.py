"""Queries of the curation path: cleaning, duplicates, classes, pieces, labels and merges."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import lineage
from attestry.functions import classify
from attestry.functions.keys import content_key, doi_plain
from attestry.operators import chunking, dedup, facts, merge
from attestry.tables import read, spread

# What an address looks like and its mask, markup that goes, documents left out by title, and
# the scopes in which topics are told.
EMAIL, EMAIL_MASK = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]+", "[correo omitido]"
RAISED, TAG = r"</?(?:sub|sup)>", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"
LEFT_OUT = r"(?i)zimmerman framework"
TOPIC_SCOPES = ("nucleo_pet_enzima", "enzima_plasticos_sin_pet")
#: Members of the metadata that a piece keeps.
KEPT_METADATA = ("pmid", "pmcid", "journal", "mutations", "uniprot")


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore").astype(object)


def unescaped(c: Column) -> Column:
    """Entities as their signs, also those that were escaped twice; only texts with an ampersand reach Python."""
    return F.coalesce(_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)


def clean_text(c: Column) -> Column:
    """Signs for entities, masked addresses, no sub and sup tags, no other tags, single blanks."""
    return plain_tags(unescaped(c))


def plain_tags(c: Column) -> Column:
    """As :func:`clean_text` but for entities; a text without the sign that a pattern needs is passed by."""
    def where(sign: str, text: Column, *patterns: tuple[str, str]) -> Column:
        out = text
        for pattern, by in patterns:
            out = F.regexp_replace(out, pattern, by)
        return F.when(F.contains(text, F.lit(sign)), out).otherwise(text)

    c = where("@", c, (EMAIL, EMAIL_MASK))
    return classify.let(c, lambda t: F.regexp_replace(where("<", t, (RAISED, ""), (TAG, "")), r"[ \t]{2,}", " "))


def corpus_slice(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents per language after removal of exact copies, and the pieces they yield."""
    docs = read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("lang"), clean_text(F.col("text")).alias("full_text"))
    first = docs.groupBy(F.sha2("full_text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    pieces = spread(kept).withColumn("_c", chunking.chunks_of(F.lit(""), F.lit(""), F.col("full_text")))
    return pieces.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("docs"), F.sum(F.size(F.filter("_c", lambda c: c["reason"].isNull()))).alias("pieces"))


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents per language after removal of exact copies."""
    docs = read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "lang", plain_tags(F.col("text")).alias("t"))
    first = docs.groupBy(F.sha2("t", 256).alias("h")).agg(F.min_by("lang", "doc_id").alias("lang"), F.count("*").alias("n"))
    return first.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("copies"))


def doi_normalized(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").select("doc_id", doi_plain(F.col("doi")).alias("doi_key")).distinct()


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of every row, and whether it is the one stored."""
    return read(spark, d, "documents_staging").select("doc_id", content_key(F.col("title"), F.col("abstract"), F.col("full_text")).alias("content_sha")).distinct()


def mask_emails(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.regexp_replace("text", EMAIL, EMAIL_MASK).alias("masked"))


def sparse_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata objects without null and empty members."""
    meta = F.from_json("metadata", "map<string,string>")
    rows = read(spark, d, "documents_staging").where(F.try_parse_json("metadata").isNotNull()).select("doc_id", F.map_filter(meta, lambda k, v: v.isNotNull() & ~v.isin("", "[]")).alias("m"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("filled_keys"), F.size("m").alias("n_filled")).distinct()


def license_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_staging").groupBy(classify.license_name(F.col("license")).alias("license_name")).agg(F.count("*").alias("docs"))


def languages(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", classify.language(F.col("text")).alias("language"))


def relevance(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents_staging").select("doc_id", "doc_type", "title", "abstract", "full_text")).select("doc_id", classify.relevance(F.col("title"), F.col("abstract"), F.col("full_text")).alias("relevance")).distinct()


def document_relevance(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return spread(read(spark, d, "documents_staging").select("doc_id", "doc_type", "title", "abstract", "full_text")).select("doc_id", classify.document_relevance(c("doc_type"), c("title"), c("abstract"), c("full_text")).alias("relevance")).distinct()


def suspicious_years(spark: SparkSession, d: str) -> DataFrame:
    """Years after the row was fetched."""
    return read(spark, d, "documents_staging").where(F.col("year") > F.year("fetched_at")).select("doc_id", "year").distinct()


def evidence_types(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents_curated")
    return rows.select("chunk_id", classify.evidence_type(F.col("section"), F.col("doc_type"), F.lit(False)).alias("kind")).distinct()


def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read(spark, d, "documents_curated").select("chunk_id", "section", "text"))
    return rows.select("chunk_id", *[s.alias(k) for k, s in classify.topic_scores(F.coalesce("text", F.lit("")), F.col("section")).items()]).distinct()


def topics(spark: SparkSession, d: str) -> DataFrame:
    """First and second topic of every curated piece."""
    rows = spread(read(spark, d, "documents_curated").select("chunk_id", "section", "text")).where(F.col("text").isNotNull())
    return rows.select("chunk_id", classify.top_topics(classify.topic_scores(F.col("text"), F.col("section"))).alias("t")).select("chunk_id", "t.*").distinct()


def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Every document and the one that stands for it."""
    return dedup.deduplicate(read(spark, d, "documents_staging"))


def left_out_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Documents left out by hand, for the report; no title of these tables is known to be one."""
    return read(spark, d, "documents_staging").where(F.col("title").rlike(LEFT_OUT)).select("doc_id", "title").distinct()


def usable(staging: DataFrame) -> Column:
    """Whether there is something to cut: an abstract of 50 characters, or a text that is no stand-in."""
    return (F.length(F.coalesce("abstract", F.lit(""))) >= classify.MIN_ABSTRACT) | dedup.has_text(F.col("full_text"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """The row of every surviving document that is not left out, with the document's own attributes."""
    staging = read(spark, d, "documents_staging").where(~F.coalesce(F.col("title").rlike(LEFT_OUT), F.lit(False)))
    c = F.col
    rows = dedup.surviving_rows(staging, dedup.deduplicate(staging)).where(usable(staging))
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.when(F.coalesce("abstract", F.lit("")) != "", c("abstract")).otherwise(F.substring(F.coalesce("full_text", F.lit("")), 1, 1500)))
    origin = F.from_json("metadata", "map<string,string>")
    kept = F.map_filter(F.coalesce(F.when(F.try_parse_json("metadata").isNotNull(), origin), F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*KEPT_METADATA) & v.isNotNull() & (v != ""))
    return spread(rows).select(
        "doc_id", "doc_type", "source", "title", "abstract", "full_text", "year", "raw_path", "content_hash", classify.license_name(c("license")).alias("license"), c("license").alias("license_declared"),
        classify.document_relevance(c("doc_type"), c("title"), c("abstract"), c("full_text")).alias("relevance"), classify.relevance(c("title"), c("abstract"), c("full_text")).alias("text_relevance"),
        F.when(c("doc_type").isin("structure", "prediction"), "en").otherwise(classify.language(said)).alias("language"), (c("year") > F.year(F.current_date())).alias("suspicious_year"), kept.alias("origin"),
    )


KEPT_COLUMNS = ("doc_id", "doc_type", "source", "license", "relevance", "language")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every surviving staging document; the text of those that are kept is clean."""
    out = chunking.chunk(_kept(spark, d), keep=("doc_id", "doc_type"))
    return out.withColumn("text", F.when(F.col("reason").isNull(), clean_text(F.col("text"))).otherwise(F.col("text")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _enzymes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: facts.enzymes_in(t) if t else [])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Kept pieces as curated rows: labels, the document's attributes, enzymes and metadata. Topics are told
    only of documents in scope, others would get labels that mislead."""
    c = F.col
    attributes = ("title", "year", "license_declared", "text_relevance", "suspicious_year", "raw_path", "content_hash", "origin")
    pieces = chunking.chunk(_kept(spark, d), keep=(*KEPT_COLUMNS, *attributes)).where(c("reason").isNull())
    pieces = pieces.withColumns({"text": clean_text(c("text")), "title": clean_text(c("title"))})
    rows = chunking.label(pieces.withColumnRenamed("language", "_language")).withColumnRenamed("language", "piece_language").withColumnRenamed("_language", "language")
    scope = c("relevance").isin(*TOPIC_SCOPES)
    meta = F.to_json(F.struct(
        c("relevance").alias("relevancia"), c("text_relevance").alias("relevancia_texto"), c("language").alias("idioma"), c("license_declared").alias("licencia_declarada"), classify.tokens(c("text")).alias("tokens_estimados"),
        c("is_table").alias("es_tabla"), "raw_path", "content_hash", F.when(c("suspicious_year"), c("year")).alias("ano_sospechoso"), *[F.try_element_at("origin", F.lit(k)).alias(k) for k in KEPT_METADATA],
    ))
    return rows.withColumns({k: F.when(scope, c(k)) for k in ("subtopic", "subtopic_secondary")} | {"enzyme": _enzymes("text"), "metadata": meta, "tokens": classify.tokens(c("text"))}).drop("origin")


def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every piece that is kept."""
    return _labelled(spark, d).select(*KEPT_COLUMNS, "chunk_id", "ordinal", "section", "title", "is_table", "subtopic", "subtopic_secondary", "evidence_type", "marks", "enzyme", "metadata")


def curated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Kept pieces in the columns of the curated table, but for who approves them."""
    rows = _labelled(spark, d)
    extra = dedup.surviving_rows(read(spark, d, "documents_staging"), dedup.deduplicate(read(spark, d, "documents_staging"))).select("doc_id", "authors", "doi", "url")
    return rows.join(extra, "doc_id").select("chunk_id", "doc_id", "source", "doc_type", "title", "authors", "year", "doi", "url", "license", "section", "text", "metadata", "relevance", "language", "subtopic", "subtopic_secondary", "evidence_type", "enzyme")


def curation_report(spark: SparkSession, d: str) -> DataFrame:
    """(what, value, n): documents and pieces by every label, what was left out and why, sources of what was
    absorbed, and pieces over the maximum, each side of the path read once."""
    c, none = F.col, F.lit("(none)")
    pair = lambda what, value: F.struct(F.lit(what).alias("what"), F.coalesce(value.cast("string"), none).alias("value"))
    count = lambda rows, *pairs: rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))
    staging = read(spark, d, "documents_staging")
    members = dedup.deduplicate(staging.where(~F.coalesce(F.col("title").rlike(LEFT_OUT), F.lit(False))))
    docs = _kept(spark, d)
    # documents are cut once; what is kept of the pieces is why they are left out
    told = lineage.cut(docs.select(*KEPT_COLUMNS, "suspicious_year", chunking.chunks_of("title", "abstract", "full_text")["reason"].alias("_r")))
    per_doc = count(told, F.when(F.size("_r") == 0, pair("document_left_out", F.lit("no_pieces"))), *[F.when(F.size("_r") > 0, pair(k, c(k))) for k in ("language", "relevance", "license")], F.when(c("suspicious_year"), pair("suspicious_year", F.lit("true"))))
    reasons = count(told.select(F.explode("_r").alias("r")).where("r IS NOT NULL"), pair("piece_left_out", c("r")))
    over = (c("tokens") > chunking.MOST)
    pieces = count(_labelled(spark, d), pair("subtopic", c("subtopic")), pair("evidence_type", c("evidence_type")), F.when(over, pair("over_maximum", F.when(c("is_table"), "table").otherwise("text"))))
    absorbed = count(members.where("doc_id <> survivor"), pair("absorbed_by_source", F.substring_index("doc_id", ":", 1)))
    return per_doc.unionByName(reasons).unionByName(pieces).unionByName(absorbed)


def token_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Upper median, 90th percentile and maximum of piece sizes by rank, not interpolated.

    Sizes are counted first, so the ranks come from a table of distinct sizes, however many pieces.
    """
    sizes = read(spark, d, "documents_curated").where(F.col("text").isNotNull()).groupBy(classify.tokens(F.col("text")).alias("s")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("s", "n")))
    table = sizes.agg(ordered.alias("a"), F.sum("n").alias("total"))
    at = lambda rank: F.aggregate(
        "a", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("v")),
        lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["v"].isNull() & (acc["seen"] + x["n"] > rank), x["s"]).otherwise(acc["v"]).alias("v")), lambda acc: acc["v"],
    )
    return table.select(at(F.floor(F.col("total") / 2)).alias("median_tokens"), at(F.floor(F.col("total") * 0.9)).alias("p90_tokens"), F.array_max(F.transform("a", lambda x: x["s"])).alias("max_tokens"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    keep = ("record_id", "metric", "value", "verified", "created_at")
    return read(spark, d, "mutant_stability").select(*keep).distinct().groupBy("record_id").agg(*[F.max_by(c, F.struct("created_at", "value", "metric")).alias(c) for c in keep[1:4]], F.max("created_at").alias("created_at"))


SPLIT_DAY = "2024-01-01"


def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the turn of the year on replace the older ones of their document and metric, others are added."""
    keep = ("record_id", "doc_id", "metric", "value", "created_at")
    rows = read(spark, d, "mutant_stability").where(F.col("metric").isNotNull()).select(F.concat_ws("|", "doc_id", "metric").alias("fact"), *keep).distinct()
    last = lambda df: df.groupBy("fact").agg(F.max_by(F.struct("record_id", "value"), F.struct("created_at", "record_id")).alias("r")).select("fact", "r.*")
    day = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return merge.merge_snapshot(last(rows.where(F.col("created_at") < day)), last(rows.where(F.col("created_at") >= day)), "fact")


def conditional_merge(spark: SparkSession, d: str) -> DataFrame:
    """A later reading of every fact (value doubled, nothing verified) does not replace verified ones."""
    stored = _facts(spark, d).drop("created_at")
    fresh = stored.select("record_id", "metric", (F.col("value") * 2).alias("value"), F.lit(False).alias("verified"))
    return merge.merge_where(stored, fresh, "record_id", merge.keep_verified())


def chunk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Curated pieces whose number is over what their document has now, if every document had lost its last."""
    pieces = read(spark, d, "documents_curated").where(F.col("chunk_id").rlike(r"^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$")).select("chunk_id", "doc_id").distinct()
    number = F.substring_index("chunk_id", "#", -1).cast("int")
    last = pieces.groupBy("doc_id").agg(F.max(number).alias("last"))
    now = pieces.join(last, "doc_id").where(number < F.col("last")).select("chunk_id", "doc_id")
    return merge.orphans(pieces, now, "chunk_id", "doc_id")


def document_text(spark: SparkSession, d: str) -> DataFrame:
    """Curated documents put together again, pieces in the order of their ordinals."""
    rows = read(spark, d, "documents_curated").where(F.col("text").isNotNull() & F.col("chunk_id").rlike(r"^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$"))
    pieces = rows.groupBy("doc_id", F.substring_index("chunk_id", "#", -1).cast("int").alias("n")).agg(F.max("text").alias("text"), F.max("approved_by").alias("approved_by"))
    parts = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"), F.max("approved_by").alias("approved_by"))
    return parts.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text_md5"), F.size("p").alias("pieces"), "approved_by")


QUERIES = {f.__name__: f for f in (
    corpus_slice, distinct_texts, doi_normalized, content_hashes, mask_emails, sparse_metadata, license_names, languages, relevance, document_relevance, suspicious_years,
    evidence_types, topic_scores, topics, dedup_survivors, left_out_by_title, chunks, chunk_labels, curation_report, token_ranks, snapshot_merge, conditional_merge, chunk_orphans, document_text,
)}

_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '" + EMAIL + "', '" + EMAIL_MASK + "', 'g'), '</?(?:sub|sup)>', '', 'g'), "
    "'</?[A-Za-z][A-Za-z0-9]*(?:\\s[^<>]*)?/?>', '', 'g'), '[ \\t]{2,}', ' ', 'g')"
)
_ONE = """one AS (SELECT record_id, max_by(metric, (created_at, value, metric)) AS metric, max_by(value, (created_at, value, metric)) AS value,
    max_by(struct_pack(v := verified), (created_at, value, metric)).v AS verified, max(created_at) AS at FROM (SELECT DISTINCT record_id, metric, value, verified, created_at FROM mutant_stability) GROUP BY 1)"""


def _case(pairs: list[tuple[str, str]], text: str, other: str) -> str:
    quote = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){quote(p)}') THEN '{k}'" for k, p in pairs) + f" ELSE '{other}' END"


def _topic_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    cols = []
    for k, rules in classify.TOPICS.items():
        parts = [f"least(len(regexp_extract_all(coalesce(text,''), '(?i){quote(p)}')), 3) * {w} + CASE WHEN regexp_matches(coalesce(section,''), '(?i){quote(p)}') THEN {2 * w} ELSE 0 END" for p, w in rules]
        cols.append(f"({' + '.join(parts)})::INT AS {k}")
    return f"SELECT DISTINCT chunk_id, {', '.join(cols)} FROM documents_curated"


_LANGUAGE_SQL = (
    "WITH t AS (SELECT doc_id, substr(coalesce(text,''), 1, 1500) AS t FROM documents), c AS (SELECT doc_id, t, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS n, "
    "length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]', '', 'g')) AS cjk, length(regexp_replace(regexp_replace(t, '[^\\p{L}]', '', 'g'), '[^\\x{0400}-\\x{04ff}]', '', 'g')) AS cy, "
    "list_slice(regexp_extract_all(lower(t), '[a-zà-ÿ]+'), 1, 300) AS w FROM t), h AS (SELECT *, "
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))) AS {k}_n" for k, v in classify.LANGUAGE_WORDS.items())
    + " FROM c), b AS (SELECT *, greatest(" + ", ".join(f"{k}_n" for k in classify.LANGUAGE_WORDS) + ") AS best FROM h) SELECT doc_id, CASE WHEN n >= 12 AND cjk / n > 0.3 THEN 'cjk' WHEN n < 40 THEN 'desconocido' "
    "WHEN cy / n > 0.2 THEN 'cirilico' WHEN len(w) > 0 AND best >= 0.12 * len(w) THEN CASE " + " ".join(f"WHEN {k}_n = best THEN '{k}'" for k in classify.LANGUAGE_WORDS) + " END ELSE 'desconocido' END AS language FROM b"
)

_TOPIC_NAMES = list(classify.TOPICS)


def _relevance_sql() -> str:
    # RE2 has no lookahead: the scans that PET is not are taken out first
    quote = lambda p: p.replace("'", "''")
    pet = classify.PET.replace(r"(?!\s*[/-]\s*(?:CT|MRI|scan|imaging))", "")
    said = "regexp_replace(b, '(?i)\\bPET\\b\\s*[/-]\\s*(?:CT|MRI|scan|imaging)', ' ', 'g')"
    is_ = {"p": f"regexp_matches({said}, '(?i){quote(pet)}')", "e": f"regexp_matches(b, '(?i){quote(classify.ENZYME)}')", "k": f"regexp_matches(b, '(?i){quote(classify.PLASTIC)}')"}
    return (
        f"WITH b AS (SELECT doc_id, doc_type, concat_ws(' ', coalesce(title,''), CASE WHEN length(coalesce(abstract,'')) >= 50 THEN abstract ELSE substr(coalesce(full_text,''), 1, 1500) END) AS b FROM documents_staging), "
        f"t AS (SELECT doc_id, doc_type, {is_['p']} AS p, {is_['e']} AS e, {is_['k']} AS k FROM b) SELECT DISTINCT doc_id, CASE WHEN doc_type IN ('structure','prediction') THEN 'estructura' "
        "WHEN p AND e THEN 'nucleo_pet_enzima' WHEN e AND k THEN 'enzima_plasticos_sin_pet' WHEN p OR k THEN 'plasticos_sin_enzima' ELSE 'fuera_de_alcance' END AS relevance FROM t"
    )


SQL = {
    "distinct_texts": f"WITH f AS (SELECT arg_min(struct_pack(l := lang), doc_id).l AS lang, count(*) AS n FROM (SELECT doc_id, lang, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL) GROUP BY t) SELECT lang, count(*) AS docs, sum(n)::BIGINT AS copies FROM f GROUP BY lang",
    "doi_normalized": "SELECT DISTINCT doc_id, regexp_replace(lower(trim(coalesce(doi,''))), '^(https://doi\\.org/)?(http://doi\\.org/)?(doi:)?', '') AS doi_key FROM documents_staging",
    "content_hashes": "SELECT DISTINCT doc_id, sha256(coalesce(title,'') || chr(10) || coalesce(abstract,'') || chr(10) || coalesce(full_text,'')) AS content_sha FROM documents_staging",
    "mask_emails": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '{EMAIL_MASK}', 'g') AS masked FROM documents WHERE contains(text, '@')",
    "license_names": "WITH p AS (SELECT regexp_replace(lower(trim(coalesce(license,''))), '[\\s_]+', '-', 'g') AS p FROM documents_staging) SELECT CASE WHEN p = '' THEN '(sin declarar)' ELSE regexp_replace(p, '-(\\d+(\\.\\d+)?)$', '') END AS license_name, count(*) AS docs FROM p GROUP BY 1",
    "languages": _LANGUAGE_SQL,
    "relevance": f"WITH b AS (SELECT doc_id, concat_ws(' ', coalesce(title,''), coalesce(abstract,''), substr(coalesce(full_text,''), 1, 4000)) AS b FROM documents_staging) SELECT DISTINCT doc_id, {_case(list(classify.TEXT_SIGNALS), 'b', 'sin_senal')} AS relevance FROM b",
    "suspicious_years": "SELECT DISTINCT doc_id, year FROM documents_staging WHERE year > year(fetched_at)",
    "evidence_types": f"SELECT DISTINCT chunk_id, CASE WHEN doc_type = 'structure' THEN 'estructura' WHEN doc_type = 'prediction' THEN 'prediccion' WHEN section = 'Resumen' THEN 'resumen' ELSE {_case(list(classify.EVIDENCE), chr(99) + 'oalesce(section, chr(0))', 'otro')} END AS kind FROM documents_curated",
    "topic_scores": _topic_sql(), "document_relevance": _relevance_sql(),
    "topics": f"WITH s AS ({_topic_sql().replace('SELECT DISTINCT chunk_id', 'SELECT chunk_id')} WHERE text IS NOT NULL), r AS (SELECT chunk_id, list_sort([" + ", ".join(f"struct_pack(s := -{k}, i := {i}, k := '{k}')" for i, k in enumerate(_TOPIC_NAMES)) + """]) AS r FROM s)
        SELECT DISTINCT chunk_id, CASE WHEN -r[1].s >= 4 THEN r[1].k END AS subtopic, CASE WHEN -r[1].s >= 4 AND -r[2].s >= 4 AND -r[2].s >= 0.6 * -r[1].s THEN r[2].k END AS subtopic_secondary FROM r""",
    "sparse_metadata": """WITH m AS (SELECT doc_id, CASE WHEN json_type(metadata) = 'OBJECT' THEN list_filter(json_keys(metadata), lambda k: coalesce(json_extract_string(metadata, '$."' || k || '"'), '') NOT IN ('', '[]')) END AS k
        FROM documents_staging WHERE json_valid(metadata)) SELECT DISTINCT doc_id, array_to_string(list_sort(k), ',') AS filled_keys, len(k)::INT AS n_filled FROM m""",
    "token_ranks": """WITH s AS (SELECT greatest(1, length(text) // 4)::INT AS s, row_number() OVER (ORDER BY length(text) // 4) - 1 AS r, count(*) OVER () AS n FROM documents_curated WHERE text IS NOT NULL)
        SELECT max(s) FILTER (r = n // 2) AS median_tokens, max(s) FILTER (r = floor(n * 0.9)) AS p90_tokens, max(s) AS max_tokens FROM s""",
    "snapshot_merge": """WITH r AS (SELECT DISTINCT doc_id || '|' || metric AS fact, record_id, value, created_at, created_at >= TIMESTAMP '2024-01-01' AS fresh FROM mutant_stability WHERE metric IS NOT NULL)
        SELECT fact, record_id, value FROM r QUALIFY row_number() OVER (PARTITION BY fact ORDER BY fresh DESC, created_at DESC, record_id DESC) = 1""",
    "conditional_merge": f"WITH {_ONE} SELECT record_id, metric, CASE WHEN coalesce(verified, false) THEN value ELSE value * 2 END AS value, CASE WHEN coalesce(verified, false) THEN verified ELSE false END AS verified FROM one",
    "chunk_orphans": """WITH p AS (SELECT DISTINCT chunk_id, doc_id, split_part(chunk_id, '#', 2)::INT AS n FROM documents_curated WHERE regexp_matches(chunk_id, '^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$')),
        m AS (SELECT doc_id, max(n) AS last FROM p GROUP BY 1) SELECT chunk_id, doc_id FROM p JOIN m USING (doc_id) WHERE n = last AND last > (SELECT min(n) FROM p q WHERE q.doc_id = p.doc_id)""",
    "left_out_by_title": "SELECT DISTINCT doc_id, title FROM documents_staging WHERE regexp_matches(title, '(?i)zimmerman framework')",
    "document_text": """WITH p AS (SELECT doc_id, split_part(chunk_id, '#', 2)::INT AS n, max(text) AS text, max(approved_by) AS approved_by FROM documents_curated
        WHERE text IS NOT NULL AND regexp_matches(chunk_id, '^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$') GROUP BY ALL)
        SELECT doc_id, md5(string_agg(text, ' ' ORDER BY n)) AS text_md5, count(*)::INT AS pieces, max(approved_by) AS approved_by FROM p GROUP BY doc_id""",
    "dedup_survivors": """WITH d AS (SELECT doc_id, any_value(source) AS source, any_value(doc_type) AS doc_type, any_value(title) AS title, any_value(coalesce(full_text,'')) AS ft, any_value(coalesce(abstract,'')) AS ab,
          any_value(nullif(lower(regexp_replace(trim(doi), '^(https?://[^/]*/|doi:)', '')), '')) AS doi, any_value(nullif(content_hash,'')) AS h FROM documents_staging GROUP BY 1),
        k AS (SELECT *, CASE WHEN doc_type IN ('article','preprint','thesis','publication') THEN 'literature' ELSE doc_type END AS kind,
          (ft <> '' AND NOT regexp_matches(ft, '(?i)full text of this (preprint|article) is available as a pdf'))::INT AS has FROM d),
        g AS (SELECT *, CASE WHEN kind IN ('structure','prediction') OR coalesce(doi, h) IS NULL THEN 'own:' || doc_id ELSE kind || coalesce('|d:' || doi, '|h:' || h) END AS gk FROM k),
        r AS (SELECT *, first_value(doc_id) OVER w AS w1 FROM g WINDOW w AS (PARTITION BY gk ORDER BY has DESC, (source = 'europepmc')::INT DESC, length(ft) DESC, length(ab) DESC, doc_id)),
        s AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS t FROM r WHERE doc_id = w1),
        q AS (SELECT *, CASE WHEN doc_type IN ('dataset','software','model') AND length(t) >= 25 THEN t ELSE 'own:' || doc_id END AS tk FROM s),
        z AS (SELECT doc_id AS w1, first_value(doc_id) OVER (PARTITION BY tk ORDER BY (source = 'zenodo')::INT DESC, length(ab) DESC, doc_id) AS w2 FROM q)
        SELECT r.doc_id, w2 AS survivor FROM r JOIN z ON r.w1 = z.w1""",
}
