"""Queries over the project's own measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import units


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/mutant_stability.parquet"), spark.read.parquet(f"{d}/metric_units.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of one quantity that agree in the common unit."""
    return units.agreeing_facts(*_tables(spark, d))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every measured value in the common unit of its metric."""
    return units.to_common_units(*_tables(spark, d))


QUERIES = {"p5_found": p5_found, "p5_values": p5_values}
SQL: dict[str, str] = {}
