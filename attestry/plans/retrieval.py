"""Queries of search, passages and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.keys import doi_plain
from attestry.operators import provenance, retrieval
from attestry.tables import read

EVERY, K = 100, 10


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    table = read(spark, d, "embeddings")
    return table, table.where(F.col("vec_id") % EVERY == 0)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every query vector (ids divisible by 100), against all rows."""
    table, asked = _vectors(spark, d)
    return retrieval.cosine_top_k(table, asked, K).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The same, one hit per label, approved labels only (those of a vector id divisible by 3)."""
    table, asked = _vectors(spark, d)
    approved = table.where("vec_id % 3 = 0")
    hits = retrieval.search(table, asked, 3, F.col("label"), approved, keep=("label",))
    return hits.select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"), "has_evidence")


def first_citations(spark: SparkSession, d: str) -> DataFrame:
    """The passages of every query as citations c1, c2, ...: one per DOI, structures and documents without
    one by passage."""
    curated = read(spark, d, "documents_curated")
    hits = retrieval.passages(curated, _asked(spark, d), results=2**31 - 1)
    docs = curated.groupBy("doc_id").agg(F.max(doi_plain(F.col("doi"))).alias("doi"), F.max("doc_type").alias("doc_type"))
    wide = hits.join(docs, "doc_id")
    identity = F.when((F.col("doc_type") == "structure") | (F.col("doi") == ""), F.col("chunk_id")).otherwise(F.col("doi"))
    return retrieval.collapse(wide, identity).select("query_id", F.concat(F.lit("c"), "rank").alias("label"), "chunk_id", "doc_id", "doi")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def passages_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Approved passages that share terms with the evaluation items (ids divisible by 100), three per document."""
    return retrieval.passages(read(spark, d, "documents_curated"), _asked(spark, d))


def passages_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same within each query's documents: those of publications, in their results sections."""
    curated = read(spark, d, "documents_curated")
    inside = _asked(spark, d).select("query_id").crossJoin(curated.where("doc_type = 'article'").select("doc_id").distinct())  # two queries
    return retrieval.passages(curated, _asked(spark, d), documents=inside, section="Result")


def span_literal(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item to the letter."""
    return retrieval.containing(read(spark, d, "documents"), read(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with each kind of flaw, by the passage's number: quotations of every curated passage that are
    right (0, 5 to 8), altered (1), ascribed to another document (2), too short (3), with a number that is not
    in them (4), with no such record (5), with a record of the document and its value (0, 6) or another
    value (6), of a document that is not there (9). A hypothesis per passage."""
    curated = read(spark, d, "documents_curated").where((F.length("text") >= 80) & F.col("chunk_id").rlike(r"^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$"))
    rows = curated.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).withColumn("n", F.substring_index("chunk_id", "#", -1).cast("int"))
    facts = read(spark, d, "mutant_stability").groupBy("doc_id").agg(F.min_by(F.struct("record_id", "value"), F.struct("record_id", "value")).alias("f"))
    k, quote = F.col("n") % 10, F.substring("text", 1, 100)
    other = read(spark, d, "documents_curated").agg(F.min("doc_id").alias("other"))
    number = F.nullif(F.regexp_extract(quote, "([0-9]{1,4})", 1), F.lit("")).cast("double")
    wide = rows.join(facts, "doc_id", "left").crossJoin(other)  # one row
    return wide.select(
        F.col("chunk_id").alias("hypothesis_id"), F.col("n").alias("evidence_no"), F.when(k == 2, F.col("other")).when(k == 9, F.lit("gone:1")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(k == 1, F.concat(F.lit("never "), quote)).when(k == 3, F.substring("text", 1, 20)).otherwise(quote).alias("evidence_span"),
        F.when(k.isin(0, 6), F.when(~F.isnan("f.value"), F.col("f.value") + k)).when(k == 4, number + 10_000).otherwise(number).alias("value"),
        F.when(k.isin(0, 6), F.col("f.record_id")).when(k == 5, F.lit("none:1")).alias("record_id"),
    )


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """A hypothesis per curated passage; its statement is the title and its prediction the text's start."""
    rows = read(spark, d, "documents_curated").groupBy("chunk_id").agg(F.max("title").alias("statement"), F.max(F.substring("text", 1, 60)).alias("prediction"), F.max("doc_type").alias("v"))
    return rows.select(F.col("chunk_id").alias("hypothesis_id"), "statement", "prediction", F.array(F.lit("activity"), F.when(F.col("v") == "article", "ph").otherwise(F.col("v"))).alias("variables"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    columns = spark.createDataFrame([(c,) for c in ("activity", "ph", "temperature_c", "substrate")], "name string")
    return provenance.gate(_hypotheses(spark, d), _evidence(spark, d), read(spark, d, "documents_curated"), read(spark, d, "mutant_stability"), columns)


def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every hypothesis and of every piece of its evidence."""
    return _checks(spark, d).drop("detail")


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return provenance.verdicts(_checks(spark, d)).drop("receipt")


def gate_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The receipt of every hypothesis as text."""
    return provenance.receipt_lines(_checks(spark, d))


def spoken_answers(spark: SparkSession, d: str) -> DataFrame:
    """First sentence of every document, 40 words at most."""
    return read(spark, d, "documents").where(F.trim("text") != "").select("doc_id", retrieval.first_sentence(F.col("text")).alias("spoken"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_search, passages_overlap, first_citations, passages_in_documents, span_literal, gate_checks, gate_verdicts, gate_receipts, spoken_answers)}

_SCORES = """s AS (SELECT q.vec_id AS query_id, t.vec_id, t.label, list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings t JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id)"""
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+'), lambda w: length(w) > 3))"



def _passages(rows: str, documents: str, most: str = "rank <= 8") -> str:
    return f"""WITH q AS (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM eval_items WHERE item_id % 100 = 0),
        p AS (SELECT chunk_id, doc_id, max(text) AS text FROM documents_curated WHERE trim(coalesce(approved_by, '')) <> '' AND length(text) >= 40 AND {rows} GROUP BY ALL), c AS (SELECT chunk_id, doc_id, unnest({_TERMS}) AS term FROM p),
        n AS (SELECT query_id, chunk_id, doc_id, count(*) AS overlap FROM c JOIN q USING (term) WHERE {documents} GROUP BY ALL),
        f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY overlap DESC, chunk_id) <= 3),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id, chunk_id) AS rank FROM f QUALIFY {most})
        SELECT query_id, k.chunk_id, k.doc_id, overlap, trim(p.text) AS evidence_span, rank FROM k JOIN p ON k.chunk_id = p.chunk_id AND k.doc_id = p.doc_id"""


_GATE = """c AS (SELECT * FROM documents_curated), b AS (SELECT chunk_id, min(doc_id) AS doc_id, min(text) AS text, split_part(chunk_id, '#', 2)::INT AS n FROM c
          WHERE length(text) >= 80 AND regexp_matches(chunk_id, '^[a-z_]+:[A-Za-z0-9-]+#[0-9]+$') GROUP BY chunk_id),
        mf AS (SELECT doc_id, arg_min(struct_pack(r := record_id, v := value), (record_id, value)) AS f FROM mutant_stability GROUP BY 1),
        e AS (SELECT b.chunk_id AS hypothesis_id, n AS evidence_no, CASE n % 10 WHEN 2 THEN (SELECT min(doc_id) FROM c) WHEN 9 THEN 'gone:1' ELSE b.doc_id END AS doc_id,
          CASE n % 10 WHEN 1 THEN 'never ' || substr(text, 1, 100) WHEN 3 THEN substr(text, 1, 20) ELSE substr(text, 1, 100) END AS span,
          CASE WHEN n % 10 IN (0, 6) THEN CASE WHEN NOT isnan(f.v) THEN f.v + n % 10 END WHEN n % 10 = 4 THEN nullif(regexp_extract(substr(text, 1, 100), '([0-9]{1,4})', 1), '')::DOUBLE + 10000
            ELSE nullif(regexp_extract(substr(text, 1, 100), '([0-9]{1,4})', 1), '')::DOUBLE END AS value, CASE WHEN n % 10 IN (0, 6) THEN f.r WHEN n % 10 = 5 THEN 'none:1' END AS record_id FROM b LEFT JOIN mf USING (doc_id)),
        dd AS (SELECT doc_id, bool_or(trim(coalesce(approved_by, '')) <> '') AS approved, max(source) AS source FROM c GROUP BY 1),
        rr AS (SELECT record_id, max_by(struct_pack(v := value, ok := coalesce(verified, false)), (value, verified)) AS r FROM mutant_stability GROUP BY 1),
        w AS (SELECT e.*, dd.doc_id IS NOT NULL AS found, coalesce(approved, false) AS approved, source, r, EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND contains(c.text, e.span)) AS literal,
          coalesce(regexp_matches(span, '(^|[^0-9.,])(' || replace(format('{:.2f}', value), '.', '[.,]') || '|' || replace(format('{:.1f}', value), '.', '[.,]') || '|' || replace(regexp_replace(format('{:.6f}', value), '[.]?0+$', ''), '.', '[.,]') || ')($|[^0-9.,]|[.,]($|[^0-9]))'), false) AS told
          FROM e LEFT JOIN dd USING (doc_id) LEFT JOIN rr USING (record_id)),
        items AS (SELECT hypothesis_id, evidence_no, 'doc_existe' AS name, found AS passed, found::INT::DOUBLE AS value, 1.0::DOUBLE AS threshold FROM w
          UNION ALL SELECT hypothesis_id, evidence_no, 'doc_aprobado', approved, approved::INT, 1 FROM w WHERE found UNION ALL SELECT hypothesis_id, evidence_no, 'span_suficiente', length(trim(span)) >= 40, length(trim(span)), 40 FROM w WHERE found
          UNION ALL SELECT hypothesis_id, evidence_no, 'span_literal', literal, literal::INT, 1 FROM w WHERE found UNION ALL SELECT hypothesis_id, evidence_no, 'valor_en_span', told, told::INT, 1 FROM w WHERE found AND value IS NOT NULL
          UNION ALL SELECT hypothesis_id, evidence_no, 'registro_existe', r IS NOT NULL, (r IS NOT NULL)::INT, 1 FROM w WHERE found AND record_id IS NOT NULL
          UNION ALL SELECT hypothesis_id, evidence_no, 'registro_verificado', r.ok, r.ok::INT, 1 FROM w WHERE found AND r IS NOT NULL
          UNION ALL SELECT hypothesis_id, evidence_no, 'valor_coincide_registro', abs(r.v - value) < 1e-6, r.v, value FROM w WHERE found AND r IS NOT NULL AND value IS NOT NULL AND r.v IS NOT NULL),
        h AS (SELECT chunk_id AS hypothesis_id, length(trim(coalesce(max(title), ''))) AS s, length(trim(coalesce(max(substr(text, 1, 60)), ''))) AS p, ['activity', CASE WHEN max(doc_type) = 'article' THEN 'ph' ELSE max(doc_type) END] AS vars FROM c GROUP BY 1),
        hc AS (SELECT h.*, (SELECT count(*) FROM w WHERE w.hypothesis_id = h.hypothesis_id) AS n, (SELECT count(DISTINCT source) FROM w WHERE w.hypothesis_id = h.hypothesis_id AND found AND trim(coalesce(source, '')) <> '') AS k,
          len(list_filter(vars, lambda v: v IN ('activity', 'ph', 'temperature_c', 'substrate'))) AS have FROM h),
        checks AS (SELECT *, true AS fatal FROM items UNION ALL SELECT hypothesis_id, 0, 'respaldo_presente', n >= 1, n, 1, true FROM hc UNION ALL SELECT hypothesis_id, 0, 'enunciado_presente', s >= 20, s, 20, true FROM hc
          UNION ALL SELECT hypothesis_id, 0, 'prediccion_presente', p >= 20, p, 20, true FROM hc UNION ALL SELECT hypothesis_id, 0, 'variables_existen', have = 2, have, 2, true FROM hc UNION ALL SELECT hypothesis_id, 0, 'fuentes_distintas', k >= 2, k, 2, false FROM hc)"""

SQL = {
    "vector_topk": f"WITH {_SCORES} SELECT query_id, vec_id, row_number() OVER w AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= {K}",
    "vector_search": f"""WITH {_SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE vec_id % 3 = 0 QUALIFY r <= 12),
        c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY r) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM c QUALIFY rank <= 3)
        SELECT query_id, vec_id, label, rank, round(score, 6) AS score, max(score) OVER (PARTITION BY query_id) >= 0.7 AS has_evidence FROM k""",
    "passages_overlap": _passages("true", "true"), "passages_in_documents": _passages("contains(lower(section), 'result')", "doc_id IN (SELECT doc_id FROM documents_curated WHERE doc_type = 'article')"),
    "first_citations": f"""WITH h AS ({_passages('true', 'true', 'true')}), d AS (SELECT doc_id, max(regexp_replace(lower(trim(coalesce(doi,''))), '^(https://doi\\.org/)?(http://doi\\.org/)?(doi:)?', '')) AS doi, max(doc_type) AS doc_type FROM documents_curated GROUP BY 1),
        w AS (SELECT h.*, doi, CASE WHEN doc_type = 'structure' OR doi = '' THEN chunk_id ELSE doi END AS i FROM h JOIN d USING (doc_id)), o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, i ORDER BY rank) = 1)
        SELECT query_id, 'c' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS label, chunk_id, doc_id, doi FROM o""",
    "span_literal": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN eval_items i ON i.text <> '' AND contains(d.text, i.text)",
    "gate_checks": f"WITH {_GATE} SELECT * FROM checks",
    "gate_verdicts": f"""WITH {_GATE}, v AS (SELECT hypothesis_id, count(*) FILTER (NOT passed AND fatal) AS failed, count(*) FILTER (NOT passed AND NOT fatal) AS warnings FROM checks GROUP BY 1)
        SELECT hypothesis_id, CASE WHEN failed > 0 THEN 'RECHAZADA' WHEN warnings > 0 THEN 'ADMITIDA_CON_AVISOS' ELSE 'ADMITIDA' END AS verdict, failed, warnings FROM v""",
    "spoken_answers": r"""WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents WHERE trim(text, ' ') <> ''), f AS (SELECT doc_id, t, regexp_extract(t, '^([^\n\r\x{85}\x{2028}\x{2029}]*?[.!?])(?:[ \t\n\x0B\f\r]|$)', 1) AS s FROM t)
        SELECT doc_id, array_to_string(list_slice(string_split_regex(CASE WHEN s = '' THEN t ELSE s END, '[ \t\n\x0B\f\r]+'), 1, 40), ' ') AS spoken FROM f""",
}
