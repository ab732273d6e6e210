"""Queries of events, facts in text and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.classify import text_of
from attestry.operators import facts, topics
from attestry.streaming import events as ev
from attestry.tables import read, spread, with_timestamps

KINDS = {"arrival": "view", "completion": "purchase", "failure": "error"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_timestamps(read(spark, d, "events"))


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    out = ev.windowed_counts(_events(spark, d))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def daily_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream in update mode; the last version of a window counts."""
    rows = ev.run_once(ev.windowed_counts(ev.event_stream(spark, f"{d}/events.parquet")), "update")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


def distinct_events_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.run_once(ev.deduplicated(ev.event_stream(spark, f"{d}/events.parquet")).select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user's events, parted by half an hour."""
    return ev.sessions(_events(spark, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def query_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == KINDS[k]
    return ev.lifecycle(_events(spark, d), "user_id", kind("arrival"), kind("completion"), kind("failure")).select("user_id", "answered")


def query_lifecycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from stateful streaming."""
    rows = ev.run_once(ev.lifecycle_stream(ev.event_stream(spark, f"{d}/events.parquet"), KINDS), "update")
    return rows.groupBy("user_id").agg(F.max_by("answered", F.struct("_batch", "version")).alias("answered"))


def approval_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as requests, purchases of the user within two hours as answers."""
    rows = _events(spark, d)
    asked = rows.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    told = rows.where("event_type = 'purchase'").select("user_id", "ts", F.lit("approve").alias("decision"))
    return ev.approvals(asked, told, "user_id", 7200).select("request_id", "decision")


def approval_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The same with purchases as yes and errors as no; the first answer counts, none is no yes."""
    rows = _events(spark, d)
    asked, told = _asked_and_told(rows)
    return ev.approvals(asked, told, "user_id", 7200).groupBy("decision").agg(F.count("*").alias("requests"))


def _asked_and_told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = rows.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    told = rows.where("event_type IN ('purchase', 'error')").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", "approve").otherwise("reject").alias("decision"))
    return asked, told


def unknown_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that no request was waiting for."""
    asked, told = _asked_and_told(_events(spark, d))
    return ev.unknown_answers(asked, told, "user_id", 7200).select("event_id", "decision")


def approvals_stream(spark: SparkSession, d: str) -> DataFrame:
    """Approvals as a stream: requests and answers joined within the time limit."""
    stream = ev.event_stream(spark, f"{d}/events.parquet")
    asked = stream.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    told = ev.event_stream(spark, f"{d}/events.parquet").where("event_type = 'purchase'").select("user_id", "ts", F.lit("approve").alias("decision"))
    rows = ev.run_once(ev.approvals_stream(asked, told, "user_id", 7200))
    return rows.where("answered_at IS NOT NULL").groupBy("request_id").agg(F.min_by("decision", "answered_at").alias("decision"))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """Views as arrivals of a query per user, purchases as completions, errors as completions with one."""
    rows = _events(spark, d).where("event_type IN ('view', 'purchase', 'error')")
    error = F.when(F.col("event_type") == "error", "failed")
    told = rows.select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") == "view", "arrival").otherwise("completion").alias("kind"), "ts", F.col("event_type").alias("query"), F.lit("x").alias("asked_by"), F.col("event_type").alias("verdict"), error.alias("error"))
    return ev.query_log(told).select("query_id", "answered", "latency_ms", "verdict", "error")


def session_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events folded into one row."""
    out = ev.fold_session(_events(spark, d), "user_id", F.col("event_id"), F.col("event_type"))
    return out.select(F.col("session").alias("user_id"), "n", F.col("last").alias("last_type"))


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Melting temperatures and shifts quoted from the evidence of every record."""
    pieces = read(spark, d, "mutant_stability").select(F.concat_ws("#", "record_id", F.lit("1")).alias("chunk_id"), "doc_id", F.col("evidence_span").alias("text")).distinct()
    return facts.extract_facts(pieces).select("doc_id", "enzyme", "mutations", "metric", "value", "confidence", "evidence_span")


def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    return facts.extraction_stats(extracted_facts(spark, d))


SIGNALS = {"stability": "stabil", "recycling": "recycl", "ecology": "microplast", "production": "plasmid|ferment", "simulation": "dynamics|simulation", "products": "terephthal"}


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(text_of(F.col("text"))[0])
    return read(spark, d, "documents").select("doc_id", F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SIGNALS.items()])).alias("topics"))


def keyword_topics(spark: SparkSession, d: str) -> DataFrame:
    return _keywords(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("docs"))


def topics_per_document(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have how many topics."""
    return _keywords(spark, d).groupBy(F.size("topics").alias("topics")).agg(F.count("*").alias("docs"))


def topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return topics.co_occurring(_keywords(spark, d), "topics")


def tf_idf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term weights of every document."""
    return topics.tf_idf(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def factor_topics(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative factors, as many as are most stable over seeds: their terms and exemplary documents."""
    weights = topics.tf_idf(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    rows, h, terms, _ = topics.stable_factors(weights, "doc_id")
    names = spark.createDataFrame(topics.top_terms(h, terms) or [], "topic int, place int, term string")
    best = topics.exemplars(rows, "doc_id")
    return names.join(best, ["topic", "place"], "left").select("topic", "place", "term", "doc_id")


def topic_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mean adjusted Rand index over four seeds for each number of topics, and the number that is chosen."""
    weights = topics.tf_idf(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    _, h, _, tried = topics.stable_factors(weights, "doc_id")
    return spark.createDataFrame([(k, round(ari, 6), k == len(h)) for k, ari in tried], "k int, ari double, chosen boolean")


def labelling_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of source and language."""
    return topics.rand_index(read(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL"), "lang", "source").select(F.round("ari", 6).alias("ari"))


QUERIES = {f.__name__: f for f in (
    daily_counts, daily_counts_stream, distinct_events_stream, user_sessions, query_lifecycle, query_lifecycle_stream, approval_timeouts, approval_decisions, unknown_answers, approvals_stream, query_log, session_fold,
    extracted_facts, extraction_stats, keyword_topics, topics_per_document, topic_pairs, tf_idf_terms, factor_topics, topic_stability, labelling_agreement,
)}

_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_LIFE = """WITH p AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, max(ts) FILTER (event_type = 'purchase') AS c, max(ts) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
    SELECT user_id, coalesce(c >= a, false) AND NOT coalesce(f > c, false) AS answered FROM p WHERE a IS NOT NULL"""
_TOPICS = "t AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text,'')), '{p}') THEN '{k}' END" for k, p in SIGNALS.items()) + "], lambda x: x IS NOT NULL) AS topics FROM documents)"

_ANSWERS = """q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
    t AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'approve' ELSE 'reject' END AS decision FROM events WHERE event_type IN ('purchase', 'error'))"""
_IN_TIME = "t.user_id = q.user_id AND t.ts >= q.ts AND t.ts <= q.ts + INTERVAL 2 HOUR"

SQL = {
    "daily_counts": _DAILY, "daily_counts_stream": _DAILY,
    "distinct_events_stream": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "user_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "query_lifecycle": _LIFE, "query_lifecycle_stream": _LIFE,
    "approval_timeouts": """SELECT event_id AS request_id, CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 2 HOUR)
        THEN 'approve' ELSE 'timeout' END AS decision FROM events c WHERE event_type = 'click'""",
    "approval_decisions": f"""WITH {_ANSWERS}, a AS (SELECT q.event_id, arg_min(t.decision, (t.ts, t.decision)) AS decision FROM q LEFT JOIN t ON {_IN_TIME} GROUP BY 1)
        SELECT coalesce(decision, 'timeout') AS decision, count(*) AS requests FROM a GROUP BY 1""",
    "unknown_answers": f"WITH {_ANSWERS} SELECT event_id, decision FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE {_IN_TIME})",
    "approvals_stream": f"WITH {_ANSWERS} SELECT q.event_id AS request_id, 'approve' AS decision FROM q JOIN t ON {_IN_TIME} AND t.decision = 'approve' GROUP BY 1",
    "query_log": """WITH a AS (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS verdict, max(ts) AS c FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
        SELECT a.user_id AS query_id, coalesce(verdict = 'purchase', false) AS answered, trunc((epoch_us(c) - epoch_us(a)) / 1000)::BIGINT AS latency_ms, verdict, CASE WHEN verdict = 'error' THEN 'failed' END AS error FROM a LEFT JOIN c USING (user_id)""",
    "topics_per_document": f"WITH {_TOPICS} SELECT len(topics)::INT AS topics, count(*) AS docs FROM t GROUP BY 1",
    "session_fold": "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1",
    "keyword_topics": f"WITH {_TOPICS}, u AS (SELECT unnest(topics) AS topic FROM t) SELECT topic, count(*) AS docs FROM u GROUP BY 1",
    "topic_pairs": f"WITH {_TOPICS}, u AS (SELECT doc_id, unnest(topics) AS x FROM t) SELECT a.x AS a, b.x AS b, count(*) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x < b.x GROUP BY ALL ORDER BY n DESC, a, b LIMIT 8",
    "tf_idf_terms": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}{3,}') AS w FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM d), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
        f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 6 AND count(*) <= 0.35 * (SELECT n FROM n)), r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
    "labelling_agreement": """WITH d AS (SELECT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), c AS (SELECT lang, source, count(*) AS n FROM d GROUP BY ALL),
        s AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) AS total FROM c), l AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), r AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY source))
        SELECT round((same - l.v * r.v / (total * (total - 1) / 2)) / ((l.v + r.v) / 2 - l.v * r.v / (total * (total - 1) / 2)), 6) AS ari FROM s, l, r""",
}
