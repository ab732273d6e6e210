"""Readers of publication, structure and dataset payloads into one staging schema.

Payloads are files here (JSON lines as the services answer); the projections are declarative, so Spark
prunes and pushes down as for any other source. Network access is a reader's only difference.
"""

from __future__ import annotations

import io
import re
import tarfile
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STAGING_COLUMNS = ("doc_id", "source", "source_id", "doc_type", "title", "authors", "year", "doi", "url", "license", "is_open_access", "abstract", "full_text", "raw_path", "metadata", "content_hash", "query", "fetched_by", "fetched_at")
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})


def with_retries(call: Callable[[], tuple[int, bytes]], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a request, tried again on busy and failing answers, twice as late each time."""
    for attempt in range(attempts):
        status, body = call()
        if status < 400:
            return body
        if status not in RETRY_STATUS or attempt + 1 == attempts:
            raise OSError(f"status {status}")
        wait(2.0**attempt)
    raise OSError("no attempt")


def cursor_pages(fetch: Callable[[str], tuple[list[dict], str | None]], start: str = "*", limit: int | None = None) -> Iterator[dict]:
    """Records of a paged service, until a cursor comes again or nothing comes."""
    seen, cursor, n = set(), start, 0
    while cursor and cursor not in seen:
        seen.add(cursor)
        rows, cursor = fetch(cursor)
        for r in rows:
            if limit is not None and n >= limit:
                return
            n += 1
            yield r
        if not rows:
            return


def text_of_inverted(index: Column) -> Column:
    """Text of an inverted index (word to positions), words by position. Null for null."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def sections_of_xml(xml: str | None) -> str:
    """Full text of an article's XML: ``## title`` lines, paragraphs and tables as one line each, in the
    order of the document. Broken XML, and an article without a body, give ''."""
    if not xml:
        return ""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return ""
    out: list[str] = []

    def line(node: ET.Element) -> str:
        return re.sub(r"\s+", " ", " ".join(node.itertext())).strip()

    def walk(node: ET.Element) -> None:
        for child in node:
            name = child.tag.rpartition("}")[2]
            if name == "title" and node.tag.rpartition("}")[2] in ("sec", "app", "abstract"):
                out.append("## " + line(child))
            elif name in ("p", "table-wrap"):
                out.append(line(child))
            else:
                walk(child)

    body = next((x for x in root.iter() if x.tag.rpartition("}")[2] == "body"), None)
    if body is not None:
        walk(body)
    return "\n".join(x for x in out if x)


@F.pandas_udf(T.StringType())
def xml_text(xml: pd.Series) -> pd.Series:
    return xml.map(sections_of_xml)


def sparse_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that are neither null nor empty."""
    kept = [F.when((c.isNotNull()) & (c.cast("string") != "") & (c.cast("string") != "[]"), c).alias(k) for k, c in fields.items()]
    return F.to_json(F.struct(*kept))


def staging_row(rows: DataFrame, source: str, fields: dict[str, Column], metadata: dict[str, Column]) -> DataFrame:
    """Rows in the staging schema from the fields that a source has; others are ''."""
    text = lambda k: F.coalesce(fields[k].cast("string"), F.lit("")) if k in fields else F.lit("")
    title, abstract, body = text("title"), text("abstract"), text("full_text")
    return rows.select(
        F.concat_ws(":", F.lit(source), text("source_id")).alias("doc_id"), F.lit(source).alias("source"), text("source_id").alias("source_id"), text("doc_type").alias("doc_type"), title.alias("title"),
        fields.get("authors", F.array().cast("array<string>")).alias("authors"), fields.get("year", F.lit(None)).cast("int").alias("year"),
        F.regexp_replace(F.lower(F.trim(text("doi"))), r"^(https://doi\.org/)?(http://doi\.org/)?(doi:)?", "").alias("doi"), text("url").alias("url"), text("license").alias("license"),
        fields.get("is_open_access", F.lit(None)).cast("boolean").alias("is_open_access"), abstract.alias("abstract"), body.alias("full_text"), text("raw_path").alias("raw_path"), sparse_json(metadata).alias("metadata"),
        F.sha2(F.concat_ws("\n", title, abstract, body), 256).alias("content_hash"), text("query").alias("query"), text("fetched_by").alias("fetched_by"), fields.get("fetched_at", F.current_timestamp()).cast("timestamp").alias("fetched_at"),
    )


def articles(payloads: DataFrame) -> DataFrame:
    """Search answers of an article service: one record per row, full text as XML where open. The id is the
    first of pmid, pmcid and the service's own; a preprint is one by its source or its publication types."""
    c = F.col
    types = F.transform(F.coalesce("pubTypeList.pubType", F.array().cast("array<string>")), F.lower)
    kind = F.when((c("source") == "PPR") | F.exists(types, lambda t: t.contains("preprint")), "preprint").otherwise("article")
    listed = F.filter(F.transform("authorList.author", lambda a: F.trim(a["fullName"])), lambda a: a != "")
    written = F.filter(F.split(F.regexp_replace("authorString", r"\.$", ""), r",\s*"), lambda a: a != "")
    return staging_row(payloads, "europepmc", {
        "source_id": F.coalesce(*[F.nullif(c(k), F.lit("")) for k in ("pmid", "pmcid", "id")]), "doc_type": kind, "title": F.regexp_replace("title", r"\.$", ""), "authors": F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).otherwise(written),
        "year": c("pubYear"), "doi": c("doi"), "license": c("license"), "is_open_access": c("isOpenAccess") == "Y", "abstract": F.regexp_replace("abstractText", "<[^>]+>", " "), "full_text": xml_text("fullTextXml"),
    }, {"journal": c("journalTitle"), "pmid": c("pmid"), "cited_by": c("citedByCount")})


def works(payloads: DataFrame) -> DataFrame:
    """Works of an index with inverted abstracts; dissertations are theses."""
    c = F.col
    return staging_row(payloads, "openalex", {
        "source_id": F.regexp_extract("id", r"([A-Z]\d+)$", 1), "doc_type": F.when(c("type") == "dissertation", "thesis").otherwise(c("type")), "title": c("title"), "authors": F.transform("authorships", lambda a: a["author"]["display_name"]),
        "year": c("publication_year"), "doi": c("doi"), "license": c("best_oa_location.license"), "is_open_access": c("open_access.is_oa"), "abstract": text_of_inverted(c("abstract_inverted_index")),
    }, {"cited_by": c("cited_by_count")})


def structures(payloads: DataFrame) -> DataFrame:
    """Entries of a structure bank: entities, mutations and accessions flattened."""
    c = F.col
    entities = c("polymer_entities")
    accessions = F.array_distinct(F.flatten(F.transform(entities, lambda e: F.coalesce(e["uniprots"], F.array().cast("array<string>")))))
    lines = F.concat_ws("\n", F.transform(entities, lambda e: F.concat_ws(" | ", e["description"], F.array_join(F.coalesce(e["mutations"], F.array().cast("array<string>")), ","))))
    return staging_row(payloads, "pdb", {"source_id": c("rcsb_id"), "doc_type": F.lit("structure"), "title": c("title"), "year": F.year(F.to_date("deposited")), "doi": c("doi"), "abstract": lines}, {"resolution": c("resolution"), "uniprot": F.array_join(accessions, ",")})


def accessions(structure_rows: DataFrame) -> DataFrame:
    """Accessions of structures, each once, with the first structure that has it."""
    split = structure_rows.select("doc_id", F.explode(F.split(F.get_json_object("metadata", "$.uniprot"), ",")).alias("accession")).where("accession <> ''")
    return split.groupBy("accession").agg(F.min("doc_id").alias("first_seen"))


def predictions(payloads: DataFrame) -> DataFrame:
    """Predicted structures by accession; an accession without an answer has no row."""
    c = F.col
    told = payloads.where(c("uniprotAccession").isNotNull())
    # of several models of an accession the latest, of equals the first by address
    rows = told.groupBy("uniprotAccession").agg(F.max_by(F.struct(*[x for x in told.columns if x != "uniprotAccession"]), F.struct("modelCreatedDate", "cifUrl")).alias("r")).select("uniprotAccession", "r.*")
    return staging_row(rows, "alphafold", {"source_id": c("uniprotAccession"), "doc_type": F.lit("prediction"), "title": c("uniprotDescription"), "url": c("cifUrl"), "year": F.year(F.to_date("modelCreatedDate"))}, {"organism": c("organismScientificName"), "plddt": c("globalMetricValue")})


def deposits(payloads: DataFrame) -> DataFrame:
    """Records of a repository; the description loses its tags."""
    c = F.col
    return staging_row(payloads, "zenodo", {
        "source_id": c("id").cast("string"), "doc_type": c("metadata.resource_type.type"), "title": c("metadata.title"), "authors": F.transform("metadata.creators", lambda a: a["name"]), "year": F.substring("metadata.publication_date", 1, 4),
        "doi": c("doi"), "license": c("metadata.license.id"), "is_open_access": c("metadata.access_right") == "open", "abstract": F.trim(F.regexp_replace(F.regexp_replace("metadata.description", "<[^>]+>", " "), r"\s+", " ")),
    }, {"files": F.to_json("files")})


def json_pages(spark: SparkSession, path: str, records: str = "results") -> DataFrame:
    """(page, place, payload): the records of page files of a service's answers, in any file system."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.from_json("value", f"`{records}` array<string>")[records].alias("r"))
    return pages.select("page", F.posexplode("r").alias("place", "payload"))


class JsonPages(DataSource):
    """``spark.read.format("json_pages").option("path", folder)``: one partition per page file of a
    service's answers, each record as (page, place, payload). Stands where an HTTP reader would."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page string, place int, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options["path"], self.options.get("records", "results"))


class _PageReader(DataSourceReader):
    def __init__(self, path: str, records: str):
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        with open(partition.value, encoding="utf-8") as f:
            rows = json.load(f)
        for i, r in enumerate(rows[self.records] if isinstance(rows, dict) else rows):
            yield partition.value, i, json.dumps(r, sort_keys=True, ensure_ascii=False)


def csv_in_tar(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """A CSV inside tar.gz files: archives are read as binary files, one task each."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for content in p["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    for m in t.getmembers():
                        if m.isfile() and m.name.endswith(member):
                            yield pd.DataFrame({"line": t.extractfile(m).read().decode().splitlines()[1:]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "line string")
    return raw.select(F.from_csv("line", schema).alias("r")).select("r.*")


def load_csv(spark: SparkSession, path: str, target: str, exclude: tuple[str, ...] = (), sep: str = ",", schema: str | None = None) -> DataFrame:
    """A table for modelling: columns left out, rows without a target dropped."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(*exclude).dropna(subset=[target])


def table_or_path(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A catalog table, or the files that stand in for it."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def typed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Text columns as booleans or numbers where every value is one; decided in one pass over the data."""
    checks = df.agg(*[F.bool_and(F.col(c).isNull() | F.lower(c).isin("true", "false")).alias(f"b_{c}") for c in columns], *[F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(f"n_{c}") for c in columns]).first()
    kind = {c: "boolean" if checks[f"b_{c}"] else "double" if checks[f"n_{c}"] else None for c in columns}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kind.items() if k})
