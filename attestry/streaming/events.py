"""Event streams: windows, lifecycles, approvals and session folds, as streams and as batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.lineage import ensure_checkpoint_dir
from attestry.tables import with_timestamps

#: Seconds until an approval that nobody answered counts as not given; days until a late event is dropped.
APPROVAL_SECONDS, LATE = 120, "2 days"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file source over a table that is a file or a folder; its time stamps are plain ones."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return with_timestamps(reader.parquet(path))
    folder, name = path.rsplit("/", 1)
    return with_timestamps(reader.option("pathGlobFilter", name).parquet(folder))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Take all that is there into files and read them; state and offsets are kept in the shared folder.

    Update mode is written batch by batch, with the batch's number, and the latest row of a key wins
    (the keys are all columns but the last ones that an aggregate adds).
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events and summed values per window and type; on a stream with a watermark, so state is bounded."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Events of a user in bursts that a gap parts."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once; on a stream, repetitions within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def lifecycle(events: DataFrame, key: str, arrival: Column, completion: Column, failure: Column) -> DataFrame:
    """(key, arrived_at, completed_at, failed_at, answered): state of each query from its events. A
    completion counts only after its arrival; failures leave it unanswered. One aggregate per key."""
    first = F.min(F.when(arrival, F.col("ts")))
    per = events.groupBy(key).agg(first.alias("arrived_at"), F.max(F.when(completion, F.col("ts"))).alias("completed_at"), F.max(F.when(failure, F.col("ts"))).alias("failed_at"))
    done = F.coalesce(F.col("completed_at") >= F.col("arrived_at"), F.lit(False))
    failed_after = F.coalesce(F.col("failed_at") > F.col("completed_at"), F.lit(False))
    return per.where(F.col("arrived_at").isNotNull()).withColumn("answered", done & ~failed_after)


_STATE = T.StructType([T.StructField("arrived", T.LongType()), T.StructField("completed", T.LongType()), T.StructField("failed", T.LongType())])
_LIFECYCLE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("answered", T.BooleanType()), T.StructField("version", T.LongType())])


def lifecycle_stream(events: DataFrame, kinds: dict[str, str], late: str = LATE, idle: str = "30 days") -> DataFrame:
    """The same as a stateful stream keyed by user_id: arrival, completion and failure times are the
    state; every batch emits the keys it touched, the last version of a key is its state. The state of a
    key without an event for ``idle`` is dropped once the watermark has passed it, so it does not grow for ever."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = {v: k for k, v in kinds.items()}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrived, completed, failed = state.get if state.exists else (None, None, None)
        version = 0
        for p in batches:
            for kind, ts in zip(p["event_type"], p["micros"]):
                what = names.get(kind)
                version = max(version, ts)
                if what == "arrival":
                    arrived = ts if arrived is None else min(arrived, ts)
                elif what == "completion":
                    completed = ts if completed is None else max(completed, ts)
                elif what == "failure":
                    failed = ts if failed is None else max(failed, ts)
        state.update((arrived, completed, failed))
        state.setTimeoutTimestamp(max(version // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        if arrived is not None:
            done = completed is not None and completed >= arrived and not (failed is not None and failed > completed)
            yield pd.DataFrame({"user_id": [key[0]], "answered": [done], "version": [version]})

    rows = events.withWatermark("ts", late).select("user_id", "event_type", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").applyInPandasWithState(step, _LIFECYCLE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def approvals(requests: DataFrame, answers: DataFrame, key: str, seconds: int = APPROVAL_SECONDS) -> DataFrame:
    """(request_id, key, asked_at, answered_at, decision): the first answer of the key within the time
    counts, ``timeout`` otherwise, which is not a yes.

    A range join by time slots as wide as the limit: a request meets the answers of its slot and the
    next, so it is an equi-join whatever the number of answers.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    asked = requests.select("request_id", F.col(key).alias("_k"), F.col("ts").alias("asked_at"), F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("_s"))
    told = answers.select(F.col(key).alias("_k"), F.col("ts").alias("answered_at"), slot("ts").alias("_s"), "decision")
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.unix_micros("answered_at") - F.unix_micros("asked_at") <= seconds * 1_000_000)
    hits = asked.join(told, ["_k", "_s"]).where(in_time).groupBy("request_id").agg(F.min(F.struct("answered_at", "decision")).alias("a"))
    return requests.select("request_id", key, F.col("ts").alias("asked_at")).join(hits, "request_id", "left").select("request_id", key, "asked_at", "a.answered_at", F.coalesce("a.decision", F.lit("timeout")).alias("decision"))


def unknown_answers(requests: DataFrame, answers: DataFrame, key: str, seconds: int = APPROVAL_SECONDS) -> DataFrame:
    """Answers that no request of their key was waiting for; they are reported and decide nothing."""
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    asked = requests.select(F.col(key).alias("_k"), F.col("ts").alias("_at"), F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("_s"))
    told = answers.withColumns({"_k": F.col(key), "_s": slot("ts")})
    waiting = (told["_k"] == asked["_k"]) & (told["_s"] == asked["_s"]) & (F.col("ts") >= F.col("_at")) & (F.unix_micros("ts") - F.unix_micros("_at") <= seconds * 1_000_000)
    return told.join(asked, waiting, "left_anti").drop("_k", "_s")


def approvals_stream(requests: DataFrame, answers: DataFrame, key: str, seconds: int = APPROVAL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same as a stream-stream outer join: a request comes out with each answer in time, or with
    ``timeout`` once the watermark has passed its limit; of several answers the first counts
    (``min_by(decision, answered_at)`` of what was written). State is bounded by limit and watermark."""
    asked = requests.withWatermark("ts", late).select("request_id", F.col(key).alias("_k"), F.col("ts").alias("asked_at"))
    told = answers.withWatermark("ts", late).select(F.col(key).alias("_ak"), F.col("ts").alias("answered_at"), "decision")
    in_time = F.expr(f"_k = _ak AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {seconds} SECONDS")
    return asked.join(told, in_time, "leftOuter").select("request_id", F.col("_k").alias(key), "asked_at", "answered_at", F.coalesce("decision", F.lit("timeout")).alias("decision"))


def query_log(events: DataFrame) -> DataFrame:
    """(query_id, query, asked_by, asked_at, completed_at, answered, latency_ms, verdict, error): one row per
    query from its arrival and completion events (query_id, kind, ts, query, asked_by, verdict, error). A
    query is answered if it was completed without error; it stands unanswered until then. The first arrival
    and the last completion count."""
    arrival, done = F.col("kind") == "arrival", F.col("kind") == "completion"
    pick = lambda cond, cols: F.struct("ts", *cols)  # noqa: E731, ARG005
    per = events.groupBy("query_id").agg(F.min(F.when(arrival, pick(arrival, ("query", "asked_by")))).alias("a"), F.max(F.when(done, pick(done, ("verdict", "error")))).alias("c")).where("a IS NOT NULL")
    c = F.col
    fine = c("c").isNotNull() & (F.coalesce("c.error", F.lit("")) == "")
    return per.select("query_id", "a.query", "a.asked_by", c("a.ts").alias("asked_at"), c("c.ts").alias("completed_at"), fine.alias("answered"), ((F.unix_micros("c.ts") - F.unix_micros("a.ts")) / 1000).cast("long").alias("latency_ms"), "c.verdict", "c.error")


def log_page(log: DataFrame, since=None, asked_by: str | None = None, unanswered: bool = False, limit: int = 100) -> DataFrame:
    """The latest rows of a query log that pass the filters, 500 at most (a page, not the log)."""
    rows = log if since is None else log.where(F.col("asked_at") >= F.lit(since))
    rows = rows if asked_by is None else rows.where(F.col("asked_by") == asked_by)
    rows = rows.where(~F.col("answered")) if unanswered else rows
    return rows.orderBy(F.desc("asked_at"), "query_id").limit(max(1, min(limit, 500)))


class Audit:
    """Audit events beside the work: they are written by a thread of their own, a failure is counted and
    never stops the work, and ``enabled=False`` turns them off."""

    def __init__(self, write: Callable[[dict], None], enabled: bool = True):
        import concurrent.futures

        self.write, self.enabled, self.failed, self.pool = write, enabled, 0, concurrent.futures.ThreadPoolExecutor(1)

    def tell(self, **event) -> None:
        if self.enabled:
            self.pool.submit(self._try, event)

    def _try(self, event: dict) -> None:
        try:
            self.write(event)
        except Exception:  # noqa: BLE001 - the audit must not stop what it watches
            self.failed += 1

    def close(self) -> None:
        """Wait for what was told."""
        self.pool.shutdown(wait=True)


def with_fallback(live: Callable[[], Iterator[dict]], simulated: Callable[[], Iterator[dict]]) -> Iterator[dict]:
    """Events of the live run; if it fails, a notice and then those of the simulator, each marked so that
    simulated values are never taken for measured ones."""
    n = 0
    try:
        for e in live():
            n += 1
            yield {**e, "simulated": False}
    except Exception as e:  # noqa: BLE001 - any failure is announced
        yield {"event": "fallback", "reason": type(e).__name__, "after": n, "simulated": True}
        for s in simulated():
            yield {**s, "simulated": True}


def fold_session(events: DataFrame, session: str, order: Column, payload: Column) -> DataFrame:
    """(session, n, digest, last): the events of a session in order, as one row. What grows with a
    session is a hash of each event, not its payload."""
    rows = events.select(F.col(session).alias("session"), F.struct(order.alias("o"), F.xxhash64(payload).alias("h")).alias("e"), payload.alias("p"), order.alias("o"))
    per = rows.groupBy("session").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("e")).alias("all"), F.max_by("p", "o").alias("last"))
    return per.select("session", "n", F.md5(F.array_join(F.transform("all", lambda e: e["h"].cast("string")), ",")).alias("digest"), "last")


def ingest_files(spark: SparkSession, source: str, target: str, state: str, project: Callable[[DataFrame], DataFrame], schema: T.StructType) -> int:
    """Idempotent ingest: files of ``source`` that were not taken before are projected and appended.
    Returns the rows of the target."""
    stream = spark.readStream.schema(schema).json(source)
    project(stream).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", target).start().awaitTermination()
    return spark.read.parquet(target).count()


def upsert_stream(changes: DataFrame, root: str, key: str, state: str) -> None:
    """Changes of a table as versions of a snapshot: each batch is merged into the current version. A batch
    that comes again after a failure is merged again, with the same result."""
    from attestry.operators import merge

    def apply(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(key).agg(F.max(F.struct("version", *[c for c in batch.columns if c not in (key, "version")])).alias("r")).select(key, "r.*")
        if merge.published(batch.sparkSession, root):
            newest = merge.merge_snapshot(merge.current(batch.sparkSession, root), newest, key)
        merge.publish(newest, root)

    changes.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
