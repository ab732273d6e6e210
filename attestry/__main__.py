"""Command line: ``python -m attestry curate|extract|query ...``. Nothing is published without ``--approve``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestry.functions import classify
from attestry.operators import facts, merge
from attestry.plans import curation, registry
from attestry.sources import sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="attestry", description=__doc__)
    todo = out.add_subparsers(dest="command", required=True)
    for name, text in (("curate", "cut and label the surviving documents"), ("extract", "read facts from the curated pieces")):
        one = todo.add_parser(name, help=text)
        one.add_argument("--tables", required=True, help="folder of the tables")
        one.add_argument("--out", required=True, help="root of the published table")
        one.add_argument("--approve", metavar="NAME", help="publish in this person's name; without it only counts are shown")
    ask = todo.add_parser("query", help="show a registered query")
    ask.add_argument("--tables", required=True)
    ask.add_argument("name", choices=sorted(registry.QUERIES))
    ask.add_argument("--rows", type=int, default=20)
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("attestry").getOrCreate()
    if asked.command == "query":
        registry.QUERIES[asked.name](spark, asked.tables).show(asked.rows, truncate=80)
        return 0
    if asked.command == "curate":
        key, proposal = "chunk_id", curation.curated_rows(spark, asked.tables)
        curation.curation_report(spark, asked.tables).orderBy("what", F.desc("n"), "value").show(500, truncate=60)
    else:
        pieces = spark.read.parquet(f"{asked.tables}/documents_curated.parquet").select("chunk_id", "doc_id", "text").distinct()
        key, proposal = "record_id", facts.extract_facts(pieces, is_table=classify.is_table_line)
        facts.extraction_stats(proposal).show(100, truncate=60)
    if not asked.approve:
        print("nothing was published; --approve NAME publishes")
        return 0
    stored = merge.current(spark, asked.out) if merge.published(spark, asked.out) else spark.createDataFrame([], proposal.withColumns({"approved_by": F.lit(""), "approved_at": F.current_timestamp()}).schema)
    print(merge.publish(sinks.merge_approved(stored, proposal, key, asked.approve), asked.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
