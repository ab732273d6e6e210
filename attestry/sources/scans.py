"""Reading what is there: statements with parameters, files of any format, columns of tables, rows by id."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.sources.records import with_retries

#: What an identifier of a document or record looks like (fixed value); others are never looked up.
IDENTIFIER = r"^[A-Za-z0-9_.:#/\-]{1,200}$"


class Client:
    """Requests to one service: tried again while it is busy, and never closer together than ``interval``
    seconds. ``send`` (method, url, arguments) gives a status and a body; clock and sleep can be replaced."""

    def __init__(self, send: Callable[..., tuple[int, bytes]], interval: float = 0.0, attempts: int = 4, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.send, self.interval, self.attempts, self.clock, self.sleep = send, interval, attempts, clock, sleep
        self.last: float | None = None

    def request(self, method: str, url: str, **arguments) -> bytes:
        def once() -> tuple[int, bytes]:
            if self.last is not None and (rest := self.last + self.interval - self.clock()) > 0:
                self.sleep(rest)
            self.last = self.clock()
            return self.send(method, url, **arguments)

        return with_retries(once, self.attempts, self.sleep)


def in_batches(ids: Iterable[str], fetch: Callable[[list[str]], list[dict]], size: int = 50) -> Iterator[dict]:
    """Records of a service that takes ``size`` ids at a time; ids repeated count once, in first order."""
    todo = list(dict.fromkeys(ids))
    for i in range(0, len(todo), size):
        yield from fetch(todo[i : i + size])


def statement(spark: SparkSession, sql: str, parameters: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A statement with named parameters (``:name``, bound as values and never pasted in) over the catalog
    and the given tables (``{name}``)."""
    return spark.sql(sql, args=dict(parameters or {}), **tables)


def files(spark: SparkSession, path: str, kind: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Files of a format: csv (with a header line), json (JSON lines), parquet, text or binary (path,
    content, ...), such as structures as they were downloaded."""
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}), **options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.format("binaryFile" if kind == "binary" else kind).load(path)


def column_names(spark: SparkSession, table: str) -> DataFrame:
    """(name, type) of the columns of a catalog table or view; no data is read."""
    rows = [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "name string, type string")


def valid_ids(ids: DataFrame, key: str) -> DataFrame:
    """Ids that look like one, each once and without outer blanks."""
    return ids.select(F.trim(key).alias(key)).where(F.col(key).rlike(IDENTIFIER)).distinct()


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a table by id; ids that do not look like one find nothing. A semi join, so a key is neither
    pasted into a statement nor is anything collected; the planner broadcasts the ids if they are few."""
    return table.join(valid_ids(ids, key), key, "left_semi")


def page(df: DataFrame, order: Sequence[str], size: int, number: int = 0) -> DataFrame:
    """One page of a table in a stated order (a feature; to read all pages, read the table)."""
    return df.orderBy(*order).offset(number * size).limit(size)


def approved_ids(read: Callable[[], DataFrame], seconds: float = 600.0, clock: Callable[[], float] = time.monotonic) -> Callable[[], DataFrame | None]:
    """A reader of the approved set that keeps it for some time. A set that cannot be read is None, "not
    known", which is not the empty set; the old one goes on while a new one cannot be had."""
    kept: dict = {"at": None, "rows": None}

    def get() -> DataFrame | None:
        if kept["at"] is None or clock() - kept["at"] >= seconds:
            try:
                fresh = read().persist()
                fresh.count()
            except Exception:  # noqa: BLE001 - whatever fails, the answer is "not known" or the last known set
                return kept["rows"]
            if kept["rows"] is not None:
                kept["rows"].unpersist()
            kept.update(at=clock(), rows=fresh)
        return kept["rows"]

    return get


class Unreadable(RuntimeError):
    """A table that a decision needs cannot be read; nothing is admitted without it."""


def required(read: Callable[[], DataFrame], what: str) -> DataFrame:
    """The table, or :class:`Unreadable` (fail closed): a gate never takes "no table" for "no objection"."""
    try:
        rows = read()
        rows.schema  # noqa: B018 - resolves the source
        rows.limit(1).count()
        return rows
    except Exception as e:
        raise Unreadable(f"{what} cannot be read") from e


def is_passage_index(columns: Sequence[str]) -> bool:
    """Whether an index is one of passages (it has their id) or of documents."""
    return "chunk_id" in columns
