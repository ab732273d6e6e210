"""Exact vector search, passages by shared terms, and literal containment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least similarity that counts as evidence, passages per document, least characters of a passage (fixed values).
THRESHOLD, PER_DOCUMENT, PASSAGE_CHARS = 0.70, 3, 40
#: What is said where nothing is found.
NO_EVIDENCE = "No evidence was found in the approved corpus."
#: Queries that are compared in one pass; more take more passes over the table.
QUERIES_PER_PASS = 4096
#: Characters of literals that are searched for in one pass.
LITERAL_CHARS_PER_PASS = 16_000_000


def cosine_top_k(table: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, key, score, keep...): the k nearest rows of the whole table for each query.

    Scores are exact: every row is compared with every query as one matrix product per batch; a
    partition hands on its k best per query, so the shuffle is queries times k times partitions.
    A query does not find itself. Null, empty and zero vectors, and other lengths, are found by nothing.
    Ties go to the smaller key. Queries go in blocks of QUERIES_PER_PASS, which bounds the broadcast.
    """
    spark = table.sparkSession
    asked = queries.select(key, vector).where(F.col(vector).isNotNull())
    blocks = max(1, -(-asked.count() // QUERIES_PER_PASS))
    fields = [table.schema[key], *[table.schema[c] for c in keep]]
    schema = T.StructType([T.StructField("query_id", table.schema[key].dataType), *fields, T.StructField("score", T.DoubleType())])
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = [(r[0], r[1]) for r in mine.collect() if r[1] and any(r[1])]
        one = table.select(key, *keep, vector).where(F.col(vector).isNotNull()).mapInArrow(_nearest(spark.sparkContext.broadcast(rows), k, key, schema.names), schema)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(queries, k: int, key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not queries.value:
            return
        sizes = {len(v) for _, v in queries.value}
        groups = {}
        for n in sizes:
            ids = [i for i, v in queries.value if len(v) == n]
            q = np.array([v for _, v in queries.value if len(v) == n], np.float64)
            groups[n] = ids, q / np.linalg.norm(q, axis=1, keepdims=True)
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = vectors.offsets.to_numpy()[:-1]
            keys = batch.column(0)
            for n, (ids, q) in groups.items():
                at = np.flatnonzero(lengths == n)
                if not len(at):
                    continue
                m = flat[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
                norm = np.linalg.norm(m, axis=1)
                at, m, norm = at[norm > 0], m[norm > 0], norm[norm > 0]
                if not len(at):
                    continue
                score = (m @ q.T) / norm[:, None]
                rows_key = keys.take(pa.array(at)).to_pylist()
                place = {x: i for i, x in enumerate(rows_key)}
                picked, asked, values = [], [], []
                for j, qid in enumerate(ids):
                    s = score[:, j].copy()
                    if qid in place:
                        s[[i for i, x in enumerate(rows_key) if x == qid]] = -np.inf
                    take = min(k, len(s))
                    edge = np.partition(s, len(s) - take)[len(s) - take]
                    # all rows that tie with the last place are handed on, so that ties are settled by key
                    best = np.flatnonzero((s >= edge) & (s > -np.inf))
                    picked += list(at[best])
                    asked += [qid] * len(best)
                    values += list(s[best])
                if picked:
                    idx = pa.array(picked)
                    yield pa.RecordBatch.from_arrays([pa.array(asked, keys.type), *[batch.column(i).take(idx) for i in range(batch.num_columns - 1)], pa.array(values, pa.float64())], names=names)

    return run


def collapse(hits: DataFrame, identity: Column, query: str = "query_id") -> DataFrame:
    """First hit of each identity in rank order, ranked anew."""
    first = hits.withColumn("_id", identity).withColumn("_n", F.row_number().over(Window.partitionBy(query, "_id").orderBy("rank"))).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).drop("_id", "_n")


def only_approved(hits: DataFrame, approved: DataFrame | None, key: str) -> DataFrame:
    """Hits whose key is approved. ``None`` is "not known", which filters nothing; an empty table does."""
    return hits if approved is None else hits.join(approved.select(key).distinct(), key, "left_semi")


def search(table: DataFrame, queries: DataFrame, k: int, identity: Column, approved: DataFrame | None, key: str = "vec_id", keep: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Top k per query after collapse and approval, with ``has_evidence`` (its best score reaches the
    threshold). Rows that are not approved are left out before the search, so approval takes none of the k.
    Collapse may: only the 4 * k nearest rows are collapsed, so a query gets fewer than k hits where these
    hold fewer identities."""
    allowed = only_approved(table, approved, key)
    hits = cosine_top_k(allowed, queries, 4 * k, key=key, keep=keep)
    cut = collapse(hits, identity).where(F.col("rank") <= k)
    return cut.withColumn("has_evidence", F.max("score").over(Window.partitionBy("query_id")) >= threshold)


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than three characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)), lambda w: F.length(w) > 3))


def signed(chunks: DataFrame) -> DataFrame:
    """Passages that somebody approved and that are long enough to be one."""
    return chunks.where((F.trim(F.coalesce("approved_by", F.lit(""))) != "") & (F.length("text") >= PASSAGE_CHARS))


def passages(chunks: DataFrame, queries: DataFrame, per_document: int = PER_DOCUMENT, results: int = 8, documents: DataFrame | None = None, section: str = "") -> DataFrame:
    """(query_id, chunk_id, doc_id, overlap, evidence_span, rank): approved passages that share terms with a
    query, at most ``per_document`` of each document and ``results`` of all, by overlap and then by id.

    ``queries``: query_id, text. ``documents`` (query_id, doc_id) confines a query to its documents, such as
    the hits of a vector search or the one document that is read; a query without documents finds none.
    ``section`` is a part of the section's name. ``evidence_span`` is the passage to the letter.

    The join is on terms, with those of the queries on one side; counts are combined before the shuffle and
    texts join last, to the passages that are returned.
    """
    rows = signed(chunks)
    if section:
        rows = rows.where(F.lower("section").contains(section.lower()))
    rows = rows.groupBy("chunk_id", "doc_id").agg(F.max("text").alias("text"))
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    told = rows.select("chunk_id", "doc_id", F.explode(terms(F.col("text"))).alias("term"))
    counted = told.join(asked, "term").groupBy("query_id", "chunk_id", "doc_id").agg(F.count("*").alias("overlap"))
    if documents is not None:
        counted = counted.join(documents.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("overlap"), "chunk_id")
    few = counted.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_document).drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id", "chunk_id")
    kept = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= results)
    return kept.join(rows.select("chunk_id", "doc_id", F.trim("text").alias("evidence_span")), ["chunk_id", "doc_id"]).select("query_id", "chunk_id", "doc_id", "overlap", "evidence_span", "rank")


def snippets(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits (query_id, doc_id, ...) with ``snippet``: the passage of the document that shares most terms
    with the query, of equals the first by id; '' where none shares any."""
    found = passages(chunks, queries, per_document=1, results=2**31 - 1, documents=hits)
    return hits.join(found.select("query_id", "doc_id", F.col("evidence_span").alias("snippet")), ["query_id", "doc_id"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answered, citations, spoken): hits with ``has_evidence`` and ``snippet`` become citations in
    the order of rank and the first sentence of the first snippet; a query without evidence has no citations
    and the fixed message."""
    good = hits.where("has_evidence").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "snippet"))).alias("h"))  # k hits a query
    first = F.element_at(F.filter("h", lambda x: x["snippet"] != "")["snippet"], 1)
    rows = queries.select("query_id").distinct().join(good, "query_id", "left")
    cited = F.coalesce(F.col("h.doc_id"), F.array().cast("array<string>"))
    said = F.when(F.size(F.coalesce(F.filter("h", lambda x: x["snippet"] != ""), F.array().cast("array<struct<rank:int,doc_id:string,snippet:string>>"))) > 0, first_sentence(first)).otherwise(F.lit(NO_EVIDENCE))
    return rows.select("query_id", (F.size(cited) > 0).alias("answered"), cited.alias("citations"), said.alias("spoken"))


def containing(texts: DataFrame, literals: DataFrame, text_key: str, text: str, literal_key: str, literal: str) -> DataFrame:
    """(text_key, literal_key): texts that hold a literal, to the letter.

    One automaton over all literals reads every text once (blocks of LITERAL_CHARS_PER_PASS characters),
    instead of comparing each text with each literal. Empty and null literals are in no text.
    """
    wanted = literals.where(F.col(literal_key).isNotNull() & (F.coalesce(literal, F.lit("")) != "")).select(F.col(literal_key).alias("i"), F.col(literal).alias("t")).distinct()
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // LITERAL_CHARS_PER_PASS))
    schema = T.StructType([texts.schema[text_key], T.StructField(literal_key, literals.schema[literal_key].dataType)])
    found = None
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else wanted
        rows = [(r.i, r.t) for r in mine.collect()]
        one = texts.select(text_key, text).where(F.col(text).isNotNull()).mapInArrow(_contained(texts.sparkSession.sparkContext.broadcast(rows), schema), schema)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _contained(rows, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for i, t in rows.value:
            by_text.setdefault(t, []).append(i)
        for t, ids in by_text.items():
            automaton.add_word(t, ids)
        if not by_text:
            return
        automaton.make_automaton()
        for batch in batches:
            out = [(k, i) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for ids in [set().union(*[v for _, v in automaton.iter(t)])] for i in ids]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b)], names=schema.names)

    return run


def first_sentence(text: Column, words: int = 40) -> Column:
    """The first sentence, cut to a number of words (for speech)."""
    one = F.regexp_extract(F.trim(text), r"^(.*?[.!?])(?:\s|$)", 1)
    return F.array_join(F.slice(F.split(F.when(one == "", F.trim(text)).otherwise(one), r"\s+"), 1, words), " ")


