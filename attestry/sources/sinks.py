"""Writing: runs with counters, approved merges, files of statements, tables for people, fitted models."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.merge import exists, merge_snapshot, repeated_keys


def write_run(payloads: DataFrame, staging: DataFrame, root: str, run_id: str) -> DataFrame:
    """A run of an ingest: payloads as they came and staging rows, both as JSON lines by source under
    ``root/raw`` and ``root/staging``, and (run_id, source, payloads, rows) as the counters, which are
    written last under ``root/runs``: a run without counters did not end. A run that is written again
    replaces itself. Returns the counters."""
    spark = staging.sparkSession
    for df, name in ((payloads, "raw"), (staging, "staging")):
        df.withColumn("_source", F.col("source")).write.mode("overwrite").partitionBy("_source").json(f"{root}/{name}/run_id={run_id}")
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    both = count(payloads, "payloads").join(count(staging, "rows"), "source", "full_outer")
    out = both.select(F.lit(run_id).alias("run_id"), "source", F.coalesce("payloads", F.lit(0)).alias("payloads"), F.coalesce("rows", F.lit(0)).alias("rows"))
    out.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run={run_id}")
    return spark.read.schema("run_id string, source string, payloads long, rows long").parquet(f"{root}/runs/run={run_id}")


def merge_approved(target: DataFrame, proposal: DataFrame, key: str, approver: str, at: Column | None = None) -> DataFrame:
    """The target with every row of the proposal, stamped with who approved it and when. A proposal that
    holds a key twice, or an approver without a name, is refused."""
    if not approver.strip():
        raise ValueError("an approval needs a name")
    if twice := repeated_keys(proposal, key).first():
        raise ValueError(f"{twice[0]} is proposed {twice.n} times")
    stamped = proposal.withColumns({"approved_by": F.lit(approver.strip()), "approved_at": F.current_timestamp() if at is None else at})
    return merge_snapshot(target, stamped, key)


def statements(text: str) -> Iterator[str]:
    """The statements of an SQL file: parted by semicolons outside quotes and comments."""
    part = ""
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|[-/]|.", text, re.S):
        if m[0] == ";":
            if part.strip():
                yield part.strip()
            part = ""
        elif not m[0].startswith(("--", "/*")):
            part += m[0]
    if part.strip():
        yield part.strip()


def apply_sql_file(spark: SparkSession, path: str) -> int:
    """Run the statements of a file in order; returns how many. The first that fails stops the rest."""
    n = 0
    for sql in statements("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())):
        spark.sql(sql)
        n += 1
    return n


def write_sheet(df: DataFrame, path: str) -> None:
    """A table for people, as CSV that spreadsheets open with the right letters: each file starts with a
    byte-order mark and the header. Written by the executors."""
    df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_sheet` wrote, or a spreadsheet saved; every column as text, empty cells as ''."""
    rows = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_fitted(model, path: str, columns: Mapping[str, str] | None = None) -> None:
    """A fitted pipeline with the columns that it reads (name to type), which are checked when it is loaded."""
    from pyspark.sql import SparkSession as Session

    model.write().overwrite().save(f"{path}/model")
    spark = Session.getActiveSession()
    spark.createDataFrame(list((columns or {}).items()), "name string, type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_fitted(spark: SparkSession, path: str, df: DataFrame | None = None):
    """The pipeline; raises if ``df`` lacks a column that it reads."""
    from pyspark.ml import PipelineModel

    if not exists(spark, f"{path}/model"):
        raise FileNotFoundError(path)
    wanted = {r.name: r.type for r in spark.read.parquet(f"{path}/columns").collect()}
    if df is not None and (missing := sorted(c for c, t in wanted.items() if dict(df.dtypes).get(c) != t)):
        raise ValueError(f"columns missing or of another type: {missing}")
    return PipelineModel.load(f"{path}/model")
