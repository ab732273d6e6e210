"""A gate for hypotheses: what they cite is there, was approved, and says what is claimed of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.folding import folded_literal
from attestry.lineage import cut
from attestry.operators.retrieval import containing

#: Least characters of a quotation and of a statement, least sources, tolerance of a value; verdicts and
#: names of checks (fixed values).
SPAN_CHARS, STATEMENT_CHARS, SOURCES, TOLERANCE = 40, 20, 2, 1e-6
REJECTED, ADMITTED, WITH_WARNINGS = "RECHAZADA", "ADMITIDA", "ADMITIDA_CON_AVISOS"
GLOBAL_CHECKS = ("respaldo_presente", "enunciado_presente", "prediccion_presente", "variables_existen")
EVIDENCE_CHECKS = (
    "doc_existe", "doc_aprobado", "span_suficiente", "span_literal", "valor_en_span", "registro_existe", "registro_verificado", "valor_coincide_registro",
)
WARNING = "fuentes_distintas"


def number_forms(value: Column) -> Column:
    """Ways in which a value is written: as it is, with one and two decimals, whole, with a comma."""
    plain = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    forms = [plain, F.format_string("%.1f", value), F.format_string("%.2f", value), F.when(value == F.round(value), F.format_string("%d", value.cast("long")))]
    both = F.array_compact(F.array(*forms))
    return F.array_distinct(F.concat(both, F.transform(both, lambda s: F.replace(s, F.lit("."), F.lit(",")))))


def holds_number(text: Column, value: Column) -> Column:
    """Whether a text has the value in one of its forms, not as a part of a longer number."""
    escaped = F.transform(number_forms(value), lambda s: F.regexp_replace(s, r"([.+-])", r"\\$1"))
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.,])("), F.array_join(escaped, "|"), F.lit(r")(?!\d)(?![.,]\d)")))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def literal_spans(evidence: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, span) of the quotations that their document holds, after folding of both. An equi-join on
    the document: only the texts of documents that are cited are folded and moved."""
    spans = evidence.where(~_blank(F.col("evidence_span"))).select("doc_id", F.col("evidence_span").alias("span")).distinct()
    cited = corpus.where(F.col("text").isNotNull()).join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", folded_literal("text").alias("_text"))
    return cited.join(spans.withColumn("_span", folded_literal("span")), "doc_id").where(F.contains("_text", "_span")).select("doc_id", "span").distinct()


def misattributed(missing: DataFrame, corpus: DataFrame) -> DataFrame:
    """(span, found_in) for every other document that holds a quotation which its own does not:
    ``missing`` has (doc_id, span). One automaton over these quotations reads the corpus."""
    spans = missing.select("span").distinct().select("span", folded_literal("span").alias("_span"))
    folded = corpus.where(F.col("text").isNotNull()).select("doc_id", folded_literal("text").alias("_text"))
    return containing(folded, spans, "doc_id", "_text", "span", "_span").select("span", F.col("doc_id").alias("found_in"))


def gate(hypotheses: DataFrame, evidence: DataFrame, corpus: DataFrame, records: DataFrame, columns: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per check: hypothesis_id, evidence_no, name, passed, value, threshold, detail, fatal.

    ``hypotheses``: hypothesis_id, statement, prediction, variables. ``evidence``: hypothesis_id,
    evidence_no (from 1), doc_id, evidence_span, and where a number is claimed value and record_id.
    ``corpus``: doc_id, text, approved_by, source, any number of rows a document. ``records``: record_id,
    value, verified, extracted_by. ``columns``: name of the columns that variables may name (None: not
    asked). Checks of the hypothesis itself have evidence_no 0. A document that is not found has no further
    checks, a number or record that is not claimed none of its own; nothing is dropped. All checks are
    fatal but ``fuentes_distintas``. A doc_id or record_id is compared without outer blanks.
    """
    claims = evidence.select("hypothesis_id", "evidence_no", F.trim(F.coalesce("doc_id", F.lit(""))).alias("doc_id"), "evidence_span", F.col("value").cast("double").alias("value"), F.trim(F.coalesce("record_id", F.lit(""))).alias("record_id"))
    docs = corpus.groupBy("doc_id").agg(F.bool_or(~_blank(F.col("approved_by"))).alias("approved"), F.max("source").alias("source"), F.lit(True).alias("found"))
    facts = records.groupBy("record_id").agg(F.max_by(F.struct(F.col("value").alias("v"), F.coalesce("verified", F.lit(False)).alias("ok"), F.coalesce("extracted_by", F.lit("an agent")).alias("by")), F.struct("value", "verified")).alias("r"))
    literal = literal_spans(claims, corpus).withColumn("literal", F.lit(True))
    wide = cut(claims.join(docs, "doc_id", "left").join(facts, "record_id", "left").join(literal.withColumnRenamed("span", "evidence_span"), ["doc_id", "evidence_span"], "left"))
    lost = wide.where(F.col("found") & F.col("literal").isNull() & ~_blank(F.col("evidence_span"))).select("doc_id", F.col("evidence_span").alias("span"))
    elsewhere = misattributed(lost, corpus).groupBy("span").agg(F.min("found_in").alias("first"), F.count("*").alias("others"))
    wide = wide.join(elsewhere.withColumnRenamed("span", "evidence_span"), "evidence_span", "left")

    c = F.col
    found, size = F.coalesce("found", F.lit(False)), F.length(F.trim(F.coalesce("evidence_span", F.lit(""))))
    one = lambda ok: ok.cast("double")

    def check(name: str, ok: Column, value: Column, threshold: Column, detail: Column | None = None, when: Column | None = None) -> Column:
        ok = F.coalesce(ok, F.lit(False))
        row = F.struct(F.lit(name).alias("name"), ok.alias("passed"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), F.when(~ok, F.coalesce(detail, F.lit("")) if detail is not None else F.lit("")).otherwise(F.lit("")).alias("detail"))
        return row if when is None else F.when(when, row)

    spelt, literal_ok, number = F.lit(1), F.coalesce("literal", F.lit(False)), c("value").isNotNull()
    has_record, known = c("record_id") != "", c("r").isNotNull()
    in_span = F.coalesce(holds_number(F.coalesce("evidence_span", F.lit("")), c("value")), F.lit(False))
    hint = F.when(c("first").isNotNull(), F.concat(F.lit("not in "), "doc_id", F.lit("; found in "), c("others").cast("string"), F.lit(" other, first "), "first")).otherwise(F.concat(F.lit("in no document to the letter: "), "doc_id"))
    own = F.array_compact(F.array(
        check("doc_existe", found, one(found), spelt, F.concat(F.when(c("doc_id") == "", "(none)").otherwise(c("doc_id")), F.lit(" is not in the corpus"))),
        check("doc_aprobado", c("approved"), one(F.coalesce("approved", F.lit(False))), spelt, F.lit("nobody approved it"), found),
        check("span_suficiente", size >= SPAN_CHARS, size, F.lit(SPAN_CHARS), F.lit("a short quotation fits too many sentences"), found),
        check("span_literal", literal_ok, one(literal_ok), spelt, hint, found),
        check("valor_en_span", in_span, one(in_span), spelt, F.lit("the number is not written in the quotation"), found & number),
        check("registro_existe", known, one(known), spelt, F.concat("record_id", F.lit(" is no record")), found & has_record),
        check("registro_verificado", c("r.ok"), one(F.coalesce("r.ok", F.lit(False))), spelt, F.concat(F.lit("extracted by "), "r.by", F.lit(" and not verified")), found & has_record & known),
        check("valor_coincide_registro", F.abs(c("r.v") - c("value")) < tolerance, c("r.v"), c("value"), F.lit("the claimed value is not the record's"), found & has_record & known & number & c("r.v").isNotNull()),
    ))
    items = wide.select("hypothesis_id", "evidence_no", F.inline(own)).withColumn("fatal", F.lit(True))

    cited = wide.groupBy("hypothesis_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(found & ~_blank(c("source")), c("source"))).alias("sources"))
    listed = hypotheses.select("hypothesis_id", F.length(F.trim(F.coalesce("statement", F.lit("")))).alias("s"), F.length(F.trim(F.coalesce("prediction", F.lit("")))).alias("p"), F.coalesce("variables", F.array().cast("array<string>")).alias("vars"))
    if columns is not None:
        named = listed.select("hypothesis_id", F.explode(F.array_distinct("vars")).alias("name")).join(columns.select("name").distinct(), "name", "left_anti")
        listed = listed.join(named.groupBy("hypothesis_id").agg(F.array_sort(F.collect_set("name")).alias("gone")), "hypothesis_id", "left")
    heads = listed.join(cited, "hypothesis_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sources": F.coalesce("sources", F.lit(0))})
    whole = [
        check("respaldo_presente", c("n") >= 1, c("n"), F.lit(1), F.lit("a hypothesis without evidence is a question")),
        check("enunciado_presente", c("s") >= STATEMENT_CHARS, c("s"), F.lit(STATEMENT_CHARS)),
        check("prediccion_presente", c("p") >= STATEMENT_CHARS, c("p"), F.lit(STATEMENT_CHARS), F.lit("no experiment could contradict it")),
    ]
    if columns is not None:
        kept = F.size("vars") - F.size(F.filter("vars", lambda v: F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), v)))
        whole.append(check("variables_existen", c("gone").isNull(), kept, F.size("vars"), F.concat(F.lit("no such column: "), F.array_join("gone", ", "))))
    whole.append(check(WARNING, c("sources") >= SOURCES, c("sources"), F.lit(SOURCES), F.lit("all evidence comes from fewer sources")))
    top = heads.select("hypothesis_id", F.lit(0).alias("evidence_no"), F.inline(F.array(*whole))).withColumn("fatal", c("name") != WARNING)
    return top.unionByName(items.select(*top.columns))


def verdicts(checks: DataFrame) -> DataFrame:
    """(hypothesis_id, verdict, failed, warnings, receipt): rejected if a fatal check fails, with warnings
    if another does. The receipt is a hash over the outcome of every check, the same for any order of rows
    or partitions; what is gathered per hypothesis is 20 bytes a check."""
    line = F.sha1(F.concat_ws("|", F.col("evidence_no").cast("string"), "name", F.col("passed").cast("string"), F.col("value").cast("string"), F.col("threshold").cast("string"), "detail"))
    per = checks.groupBy("hypothesis_id").agg(F.count_if(~F.col("passed") & F.col("fatal")).alias("failed"), F.count_if(~F.col("passed") & ~F.col("fatal")).alias("warnings"), F.array_sort(F.collect_list(line)).alias("lines"))
    verdict = F.when(F.col("failed") > 0, REJECTED).when(F.col("warnings") > 0, WITH_WARNINGS).otherwise(ADMITTED)
    return per.select("hypothesis_id", verdict.alias("verdict"), "failed", "warnings", F.substring(F.sha2(F.array_join("lines", "\n"), 256), 1, 16).alias("receipt"))


def receipt_lines(checks: DataFrame) -> DataFrame:
    """(hypothesis_id, evidence_no, place, line): the receipt as text, a line per check, in the order of
    the checks."""
    order = F.array_position(F.array(*map(F.lit, (*GLOBAL_CHECKS, *EVIDENCE_CHECKS, WARNING))), F.col("name")).cast("int")
    mark = F.when(F.col("passed"), "ok").when(F.col("fatal"), "FAILS").otherwise("warning")
    number = lambda x: F.regexp_replace(F.format_string("%.4f", F.col(x)), r"\.?0+$", "")
    tail = F.when(F.col("passed") | (F.col("detail") == ""), F.lit("")).otherwise(F.concat(F.lit(" - "), "detail"))
    where = F.when(F.col("evidence_no") > 0, F.format_string("respaldo[%d].%s", F.col("evidence_no") - 1, F.col("name"))).otherwise(F.col("name"))
    return checks.select("hypothesis_id", "evidence_no", order.alias("place"), F.concat(F.lit("["), mark, F.lit("] "), where, F.lit(": "), number("value"), F.lit(" / "), number("threshold"), tail).alias("line"))
