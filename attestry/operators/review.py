"""Contrast of facts across documents, eligibility, decisions of reviewers, samples and measured precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.lineage import cut

#: Differences over this are a discrepancy; z of a 95 % interval; names that stand for many enzymes; the
#: way in which a work is cited; questions and what a "no" to each means (fixed values).
DISCREPANCY, Z = 5.0, 1.96
GENERIC = ("petase", "cutinase", "esterase", "lipase")
CITES = r"\[\s*\d+(?:\s*[,–\-]\s*\d+)*\s*\]|\bet\s+al\.?[\s,]*\(?\s*\d{4}|\(\s*[A-Z][A-Za-z\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z\-]+)?\s*,?\s*\d{4}\s*\)"
QUESTIONS = {
    "q1_valor_en_frase": "valor_no_respaldado", "q2_enzima_en_frase": "enzima_equivocada", "q3_metrica_correcta": "metrica_equivocada", "q4_condiciones": "condiciones_no_precisables",
}
OK, CORRECT, DISCARD = "ok", "corregir", "descartar"
#: Bins of a variant's values by which they are ranked.
BINS = 64


def cites_another(span: Column) -> Column:
    """Whether a sentence cites another work, so that its value may not be its own."""
    return F.coalesce(span.rlike(CITES), F.lit(False))


def not_eligible(conditions: Column, enzyme: Column) -> Column:
    """Why a fact cannot be reviewed; null if it can."""
    return F.when(F.contains(F.coalesce(conditions, F.lit("")), F.lit("order of the names")), "values in the order of the names").when(F.trim(F.coalesce(enzyme, F.lit(""))) == "", "no enzyme")


def contrast(facts: DataFrame, limit: float = DISCREPANCY) -> DataFrame:
    """(record_id, doc_id, value, others, citing, median, contrast): each fact against the facts of the same
    enzyme and mutations in other documents: how many documents they are, how many of them cite another
    work, their exact median, and whether the fact differs from it by more than ``limit``.

    ``facts``: record_id, doc_id, enzyme, mutations, value, and if there are such columns ``special``
    (measured under conditions of its own or approximate: compared, but nothing is compared with it) and
    ``cites``. A fact without enzyme or with a generic name is ``generic``: it stands for many enzymes.

    "All documents but mine" needs no self join. Values of a variant are ranked (by bins, so no task sorts a
    variant); of the others' median only the ranks within the own count of the middle can be meant, so a
    document asks for as many ranked values as it has itself, and two. Work and rows are linear.
    """
    keys = ["enzyme", "mutations"]
    special = F.coalesce("special", F.lit(False)) if "special" in facts.columns else F.lit(False)
    cites = F.coalesce("cites", F.lit(False)) if "cites" in facts.columns else F.lit(False)
    named = ~F.lower(F.trim(F.coalesce("enzyme", F.lit("")))).isin("", *GENERIC)
    rows = cut(facts.where(F.col("value").isNotNull()).select("record_id", "doc_id", "enzyme", F.coalesce("mutations", F.lit("")).alias("mutations"), "value", special.alias("special"), cites.alias("cites"), named.alias("named")).distinct())
    pool = rows.where(F.col("named") & ~F.col("special")).select("record_id", "doc_id", *keys, "value", "cites")
    edges = pool.groupBy(*keys).agg(F.percentile_approx("value", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 1000).alias("edges"), F.count("*").alias("total"))
    binned = pool.join(edges, keys).withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    sizes = binned.groupBy(*keys, "b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy(*keys, "b").orderBy("value", "record_id")
    placed = cut(binned.withColumn("r", F.row_number().over(order) - 1).join(before, [*keys, "b"]).select(*keys, "doc_id", "value", (F.col("before") + F.col("r")).alias("at")))

    # documents that compare: those of the pool and those that only have special facts
    own = pool.groupBy(*keys, "doc_id").agg(F.count("*").alias("own"), F.count_if("cites").alias("own_cites"))
    per = pool.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("cites").alias("all_cites")).join(own.groupBy(*keys).agg(F.count("*").alias("docs")), keys)
    asking = rows.where("named").select(*keys, "doc_id").distinct().join(own, [*keys, "doc_id"], "left").fillna(0, ["own", "own_cites"]).join(per, keys).withColumn("m", F.col("total") - F.col("own")).where("m > 0")
    asking = cut(asking.withColumns({"r1": F.floor((F.col("m") - 1) / 2), "r2": F.floor(F.col("m") / 2), "others": F.col("docs") - (F.col("own") > 0).cast("int"), "citing": F.col("all_cites") - F.col("own_cites")}))
    lower = placed.join(asking.select(*keys, "doc_id", "r1"), [*keys, "doc_id"]).groupBy(*keys, "doc_id").agg(F.count_if(F.col("at") < F.col("r1")).alias("skip"))
    wanted = asking.join(lower, [*keys, "doc_id"], "left").fillna(0, ["skip"]).select(*keys, "doc_id", "r1", "r2", "skip", F.explode(F.sequence("r1", F.col("r2") + F.col("own"))).alias("at"))
    got = wanted.join(placed.select(*keys, "at", "value", F.col("doc_id").alias("_d")), [*keys, "at"]).where(~F.col("_d").eqNullSafe(F.col("doc_id")))
    middle = got.groupBy(*keys, "doc_id", "r1", "r2", "skip").agg(F.array_sort(F.collect_list("value")).alias("v")).select(*keys, "doc_id", ((F.get("v", F.col("skip").cast("int")) + F.get("v", (F.col("skip") + F.col("r2") - F.col("r1")).cast("int"))) / 2).alias("median"))
    told = asking.select(*keys, "doc_id", "others", "citing").join(middle, [*keys, "doc_id"])
    out = rows.join(told, [*keys, "doc_id"], "left")
    verdict = F.when(~F.col("named"), "generic").when(F.col("median").isNull(), "alone").when(F.abs(F.col("value") - F.col("median")) > limit, "differs").otherwise("agrees")
    zero = lambda c: F.when(F.col("named"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return out.select("record_id", "doc_id", "value", zero("others"), zero("citing"), F.when(F.col("named"), F.col("median")).alias("median"), verdict.alias("contrast"))


def decide(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per answered fact: record_id, decision, reasons, error, and the corrected enzyme, mutations,
    metric, value and conditions (null where nothing changes).

    ``answers``: id, the four QUESTIONS (s or n; the last also a, which adds a condition), enzima_corr,
    mutaciones_corr, metrica_corr, valor_corr, condiciones_corr. Unanswered rows and unknown ids have no
    row. Without a "no" a fact is ``ok``, or ``corregir`` if something but the conditions changes. Each "no"
    needs its own correction, else the fact is discarded; conditions that cannot be told discard it always.
    A corrected value must stand in the sentence. ``error`` is null or what must be mended first.
    """
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    q = {k: F.lower(plain(k)) for k in QUESTIONS}
    q1, q2, q3, q4 = q.values()
    new = {k: F.nullif(plain(f"{c}_corr"), F.lit("")) for k, c in (("enzyme", "enzima"), ("mutations", "mutaciones"), ("metric", "metrica"), ("raw", "valor"), ("noted", "condiciones"))}
    wide = answers.withColumnRenamed("id", "record_id").select("record_id", *[v.alias(k) for k, v in q.items()], *[v.alias(f"new_{k}") for k, v in new.items()])
    both = wide.join(facts.select("record_id", F.coalesce("conditions", F.lit("")).alias("_c"), F.coalesce("evidence_span", F.lit("")).alias("_span")), "record_id")
    c = F.col
    value = F.replace("new_raw", F.lit(","), F.lit(".")).try_cast("double")
    written = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")
    given = [c(k) != "" for k in QUESTIONS]
    error = (
        F.when(~(given[0] & given[1] & given[2] & given[3]), "answer all four or none")
        .when(~c("q1_valor_en_frase").isin("s", "n") | ~c("q2_enzima_en_frase").isin("s", "n") | ~c("q3_metrica_correcta").isin("s", "n") | ~c("q4_condiciones").isin("s", "a", "n"), "an answer is not one of those allowed")
        .when(c("new_raw").isNotNull() & value.isNull(), "the corrected value is no number").when(value.isNotNull() & ~F.contains("_span", written), "the corrected value is not in the sentence")
        .when(c("new_metric").isNotNull() & ~c("new_metric").isin("Tm", "dTm"), "the corrected metric is not known").when((c("q4_condiciones") == "a") & c("new_noted").isNull(), "the added condition is missing")
    )
    conditions = F.when(c("q4_condiciones") == "a", F.concat_ws("; ", F.nullif("_c", F.lit("")), "new_noted")).otherwise(c("new_noted"))
    no = {k: c(k) == "n" for k in QUESTIONS}
    k1, k2, k3, k4 = QUESTIONS
    lost = no[k4] | (no[k1] & value.isNull()) | (no[k2] & c("new_enzyme").isNull()) | (no[k3] & c("new_metric").isNull())
    failed = no[k1] | no[k2] | no[k3] | no[k4]
    changed = value.isNotNull() | c("new_enzyme").isNotNull() | c("new_mutations").isNotNull() | c("new_metric").isNotNull()
    decision = F.when(lost, DISCARD).when(failed | changed, CORRECT).otherwise(OK)
    reasons = F.when(failed, F.array_compact(F.array(*[F.when(no[k], why) for k, why in QUESTIONS.items()]))).when(changed, F.array(F.lit("ajuste_menor"))).otherwise(F.array().cast("array<string>"))
    keep = lambda x: F.when(error.isNull() & (decision != DISCARD), x)
    return both.where(given[0] | given[1] | given[2] | given[3]).select(
        "record_id", F.when(error.isNull(), decision).alias("decision"), F.when(error.isNull(), reasons).alias("reasons"), error.alias("error"),
        keep(c("new_enzyme")).alias("enzyme"), keep(c("new_mutations")).alias("mutations"), keep(c("new_metric")).alias("metric"), keep(value).alias("value"), keep(conditions).alias("conditions"),
    )


def apply_decisions(facts: DataFrame, decided: DataFrame, reviewer: str) -> DataFrame:
    """The facts after review: discarded ones are gone, reviewed ones are verified, corrected ones say by
    whom. All or nothing: any row with an error raises before anything is changed."""
    bad = decided.where(F.col("error").isNotNull()).agg(F.count("*").alias("n"), F.min(F.struct("record_id", "error")).alias("first")).first()
    if bad.n:
        raise ValueError(f"{bad.n} rows need mending, first {bad.first.record_id}: {bad.first.error}")
    new = ("enzyme", "mutations", "metric", "value", "conditions")
    changes = decided.select("record_id", "decision", *[F.col(c).alias(f"_{c}") for c in new])
    wide = facts.join(changes, "record_id", "left").where(F.coalesce(F.col("decision") != DISCARD, F.lit(True)))
    seen = F.col("decision").isNotNull()
    by = F.when(F.col("decision") == CORRECT, F.lit(f"human:{reviewer}")).otherwise(F.col("extracted_by"))
    return wide.withColumns({**{c: F.coalesce(f"_{c}", c) for c in new}, "verified": F.when(seen, True).otherwise(F.col("verified")), "extracted_by": by}).select(*facts.columns)


def decision_counts(facts: DataFrame, decided: DataFrame, level: str = "confidence") -> DataFrame:
    """(level, ok, corregir, descartar, sin_revisar, precision, lower): decisions per level, the share that
    needed no correction, and the lower bound of its 95 % interval."""
    rows = facts.select("record_id", level).join(decided.select("record_id", "decision"), "record_id", "left")
    per = rows.groupBy(level).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in (OK, CORRECT, DISCARD)], F.count_if(F.col("decision").isNull()).alias("sin_revisar"))
    n = F.col(OK) + F.col(CORRECT) + F.col(DISCARD)
    return per.withColumns({"precision": F.when(n > 0, F.col(OK) / n), "lower": wilson_lower(F.col(OK), n)})


def contrast_by_decision(decided: DataFrame, contrasts: DataFrame) -> DataFrame:
    """(contrast, ok, corregir, descartar): what reviewers decided by what the contrast said."""
    rows = decided.where(F.col("decision").isNotNull()).join(contrasts.select("record_id", "contrast"), "record_id", "left")
    seen = F.when(F.col("contrast").isin("differs", "agrees"), F.col("contrast")).otherwise("none")
    return rows.groupBy(seen.alias("contrast")).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in (OK, CORRECT, DISCARD)])


def reason_counts(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("facts"))


def seconds_per_fact(decided: DataFrame, minutes: float) -> DataFrame:
    """(reviewed, seconds): how long a fact took; null for none."""
    return decided.agg(F.count_if(F.col("decision").isNotNull()).alias("reviewed")).select("reviewed", F.round(minutes * 60 / F.nullif("reviewed", F.lit(0)), 1).alias("seconds"))


def allocation(size: Column, total: Column, n: int, least: int = 3) -> Column:
    """Rows drawn from a stratum: its rounded share (half to even), at least ``least``, at most its size."""
    return F.least(size, F.greatest(F.lit(least), F.bround(F.lit(n) * size / total).cast("long")))


def stratified_sample(df: DataFrame, key: str, stratum: Column, n: int, seed: int = 0, least: int = 3) -> DataFrame:
    """A seeded sample with every stratum in it. Rows are ordered by the MD5 of key and seed; those over
    a stratum's allocation are dropped in two steps (per salt, then per stratum), so that no task sorts a
    stratum with a third of all rows."""
    rows = df.withColumn("_s", stratum).withColumn("_h", _draw(key, seed))
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    wanted = sizes.crossJoin(total).select(F.col("_s").alias("_w"), allocation(F.col("_n"), F.col("_t"), n, least).alias("_k"))  # a row per stratum, times one
    salted = rows.join(wanted, F.col("_s").eqNullSafe(F.col("_w"))).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))).where("_r <= _k")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))).where("_r <= _k").drop("_s", "_h", "_w", "_k", "_b", "_r")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, every one as likely: the first in the order of the MD5 of key and seed, which any engine gives."""
    return df.orderBy(_draw(key, seed), key).limit(n)


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def wilson_lower(good: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of the 95 % Wilson interval of a share; null for no trials."""
    p = good / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def reidentify(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(old_key, new_key): records by id, and those whose id changed by content, if only one new record
    has that content and only one old one lost it."""
    same = old.join(new.select(key), key, "left_semi").select(F.col(key).alias("old_key"), F.col(key).alias("new_key"))
    lost, fresh = old.join(new.select(key), key, "left_anti"), new.join(old.select(key), key, "left_anti")
    one = lambda df, name: df.groupBy(*content).agg(F.min(key).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return same.unionByName(one(lost, "old_key").join(one(fresh, "new_key"), content).select("old_key", "new_key"))
