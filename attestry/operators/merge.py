"""Keyed changes of tables that are files: merges, conditional merges, orphans and added columns."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_snapshot(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with the same key, others are added.

    Two rows of the source with one key are refused by the caller's check (:func:`repeated_keys`); a
    null key matches nothing. Columns that only one side has are null on the other.
    """
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def merge_where(target: DataFrame, source: DataFrame, key: str, replace: Column) -> DataFrame:
    """As :func:`merge_snapshot`, but a matched row is replaced only where ``replace`` holds; it sees
    the two rows as ``t`` and ``s``. One shuffle per side, on the key."""
    t, s = F.struct(*[target[c] for c in target.columns]), F.struct(*[source[c] for c in source.columns])
    both = target.select(F.col(key).alias("_k"), t.alias("t")).join(source.select(F.col(key).alias("_k"), s.alias("s")), "_k", "full_outer")
    wins = F.col("s").isNotNull() & (F.col("t").isNull() | F.coalesce(replace, F.lit(False)))
    return both.select(*[F.when(wins, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns])


def keep_verified() -> Column:
    """Replace unless the stored row is verified and the new one is not."""
    return ~F.coalesce(F.col("t.verified"), F.lit(False)) | F.coalesce(F.col("s.verified"), F.lit(False))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(target: DataFrame, source: DataFrame, key: str, scope: str) -> DataFrame:
    """Rows of ``target`` whose key is no longer in ``source`` though their ``scope`` still is. Null keys
    of the source drop nothing, unlike NOT IN."""
    return target.join(source.select(scope).distinct(), scope, "left_semi").join(source.select(key), key, "left_anti")


def add_columns(df: DataFrame, wanted: T.StructType) -> tuple[DataFrame, list[str]]:
    """The table with the columns of ``wanted`` it lacks, as nulls, and their names; nothing if none."""
    missing = [f for f in wanted.fields if f.name.lower() not in {c.lower() for c in df.columns}]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df, [f.name for f in missing]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names; other errors are raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a version of a table beside the others and then append a pointer to it under
    ``root/_versions``; the pointer with the highest number is the current one. Nothing is overwritten, so
    readers of the old version are not disturbed and a writer that dies before the last step changes nothing."""
    spark = df.sparkSession
    version, pointers = f"{root}/v-{uuid.uuid4().hex}", f"{root}/_versions"
    df.write.partitionBy(*partition_by).parquet(version)
    number = 1 + (spark.read.parquet(pointers).agg(F.max("number")).first()[0] if exists(spark, pointers) else 0)
    spark.createDataFrame([(number, version)], "number long, path string").coalesce(1).write.mode("append").parquet(pointers)
    return version


def published(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root}/_versions")


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{root}/_versions").agg(F.max_by("path", "number")).first()[0])


def audit_row(spark: SparkSession, values: Mapping[str, str], refs: list[str]) -> DataFrame:
    """One audit event: a fresh id, the server's time, sorted distinct references."""
    base = spark.createDataFrame([(*values.values(), sorted(set(refs)))], T.StructType([*[T.StructField(k, T.StringType()) for k in values], T.StructField("refs", T.ArrayType(T.StringType()))]))
    return base.select(F.expr("uuid()").alias("event_id"), F.current_timestamp().alias("ts"), "*")
