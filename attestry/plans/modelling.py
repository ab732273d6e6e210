"""Queries of review samples, measurement tables and models."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import modelling, review, search, units
from attestry.tables import read

CONDITIONS = ("ph", "temperature_c", "seq_length", "gravy", "aromaticity")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """One row per record of the recorded facts, with its number and what a review asks for."""
    keep = ("doc_id", "enzyme", "mutations", "metric", "value", "unit", "conditions", "evidence_span", "extracted_by", "verified")
    one = read(spark, d, "mutant_stability").groupBy("record_id").agg(F.min(F.struct(*keep)).alias("r")).select("record_id", "r.*")
    return one.withColumn("n", F.nullif(F.regexp_extract("record_id", "([0-9]+)$", 1), F.lit("")).cast("long"))


def _melting(spark: SparkSession, d: str) -> DataFrame:
    """Melting temperatures in their common unit, with what their sentence tells."""
    facts = read(spark, d, "mutant_stability")
    common = units.to_common_units(facts, read(spark, d, "metric_units")).where("metric_name = 'Tm' AND common_value IS NOT NULL")
    cites = facts.groupBy("record_id").agg(F.bool_or(review.cites_another(F.col("evidence_span"))).alias("cites"))
    return common.select("record_id", "doc_id", "enzyme", "mutations", F.col("common_value").alias("value")).distinct().join(cites, "record_id")


def loo_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Every melting temperature, in its common unit, against the other documents' of the variant."""
    return review.contrast(_melting(spark, d)).select("record_id", "others", "citing", F.round("median", 6).alias("median"), "contrast")


def contrast_as_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Every fact against those of its variant in other documents that have the same metric and unit as written."""
    rows = _reviewed(spark, d).where(~F.isnan("value"))
    named = rows.withColumns({"enzyme": F.when(F.trim("enzyme") != "", F.concat_ws("|", "enzyme", F.coalesce("metric", F.lit("")), F.coalesce("unit", F.lit("")))), "cites": review.cites_another(F.col("evidence_span"))})
    return review.contrast(named).select("record_id", "others", "citing", F.round("median", 6).alias("median"), "contrast")


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts and the decisions on them; the answers follow from the record's number, a third are not given."""
    facts, n = _reviewed(spark, d), F.col("n")
    told = lambda k, x, y="": F.when(n % k == 0, x).otherwise(y)
    answered = lambda c: F.when((n % 3 != 2), c).otherwise("")
    answers = facts.where(n.isNotNull()).select(
        F.col("record_id").alias("id"), answered(told(5, "n", "S")).alias("q1_valor_en_frase"), answered(told(7, " n", "s")).alias("q2_enzima_en_frase"), answered(F.lit("s")).alias("q3_metrica_correcta"),
        answered(F.when(n % 11 == 0, "a").when(n % 13 == 0, "n").otherwise("s")).alias("q4_condiciones"), told(14, "NewPETase").alias("enzima_corr"), told(17, "A1C").alias("mutaciones_corr"), F.lit("").alias("metrica_corr"),
        F.when(n % 10 == 0, F.regexp_extract("evidence_span", "([0-9]+[.][0-9]{1,3})", 1)).alias("valor_corr"), told(11, "pH 8").alias("condiciones_corr"),
    )
    return facts, review.decide(answers, facts)


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What follows from the answers to each fact."""
    return _decided(spark, d)[1].withColumn("reasons", F.array_join("reasons", ","))


def review_applied(spark: SparkSession, d: str) -> DataFrame:
    """The facts after the review."""
    facts, decided = _decided(spark, d)
    return review.apply_decisions(facts, decided.where("error IS NULL"), "reviewer").select("record_id", "enzyme", "mutations", "value", "verified", "extracted_by")


def review_counts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions per metric, their precision and its lower bound."""
    facts, decided = _decided(spark, d)
    out = review.decision_counts(facts, decided, "metric")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "lower")})


def review_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by what the contrast had said."""
    return review.contrast_by_decision(_decided(spark, d)[1], contrast_as_recorded(spark, d))


def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    return review.reason_counts(_decided(spark, d)[1])


def review_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Why facts cannot be reviewed, with how many of the sentences cite another work."""
    rows = _reviewed(spark, d)
    why = F.coalesce(review.not_eligible(F.col("conditions"), F.col("enzyme")), F.lit("eligible"))
    return rows.groupBy(why.alias("why")).agg(F.count("*").alias("facts"), F.count_if(review.cites_another(F.col("evidence_span"))).alias("citing"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 60 curated pieces with every section in it."""
    rows = read(spark, d, "documents_curated").select("chunk_id", "section").distinct()
    return review.stratified_sample(rows, "chunk_id", F.col("section"), 60)


def sample_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of that sample per section."""
    return stratified_sample(spark, d).groupBy("section").agg(F.count("*").alias("drawn"))


def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return review.uniform_sample(read(spark, d, "documents_curated").select("chunk_id").distinct(), "chunk_id", 50)


def wilson_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents with hand labels of two areas or more by language, with its lower bound."""
    labels = read(spark, d, "subject_labels").groupBy("doc_id").agg(F.count_distinct("subject").alias("areas"))
    per = labels.join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.col("areas") > 1).alias("good"), F.count("*").alias("n"))
    return per.select("lang", "good", "n", F.round(review.wilson_lower(F.col("good"), F.col("n")), 6).alias("lower"))


def reidentified(spark: SparkSession, d: str) -> DataFrame:
    """Records of this year's table by content, with ids that were written anew."""
    old = read(spark, d, "mutant_stability").groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("doc_id", "enzyme", "mutations", "metric", "value")])
    new = old.withColumn("record_id", F.when(F.col("metric") == "Tm", F.concat(F.lit("new:"), "record_id")).otherwise(F.col("record_id")))
    return review.reidentify(old, new, "record_id", ["doc_id", "enzyme", "mutations", "metric", "value"])


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of every sequence."""
    out = modelling.descriptors(read(spark, d, "enzyme_features"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Length, composition and hydropathy of every sequence (the part of the descriptors that SQL has)."""
    out = modelling.descriptors(read(spark, d, "enzyme_features"))
    return out.select("enzyme_id", "seq_length", "nonstandard_residues", *[F.round(c, 5).alias(c) for c in ("aromaticity", "gravy", "aa_l")])


def composition_long(spark: SparkSession, d: str) -> DataFrame:
    """Residue shares in long form, blanks left out."""
    cols = [f"aa_{a.lower()}" for a in modelling.RESIDUES]
    return modelling.to_long(read(spark, d, "enzyme_features").select("enzyme_id", *cols), ["enzyme_id"], cols, "residue", "share")


def conditions_long(spark: SparkSession, d: str) -> DataFrame:
    """Highest activity per enzyme and condition as condition columns, then in long form again."""
    rows = read(spark, d, "pet_activity_ml").where(F.col("activity").isNotNull() & ~F.isnan("activity"))
    name = F.concat_ws("_", F.lit("activity_at"), F.format_string("%.1f", "ph"), F.col("temperature_c").cast("string"), "substrate")
    seen = sorted(r[0] for r in rows.select(name.alias("n")).distinct().collect())  # columns of a table, so their names are few
    wide = rows.withColumn("n", name).groupBy("enzyme_id").pivot("n", seen).agg(F.max("activity"))
    long = modelling.to_long(wide, ["enzyme_id"], [c for c in wide.columns if c != "enzyme_id"])
    return modelling.measured_conditions(long)


def ml_view(spark: SparkSession, d: str) -> DataFrame:
    """Measurements with the features of their enzyme, each column once; NaN is no measurement."""
    measured, features = read(spark, d, "pet_activity_ml"), read(spark, d, "enzyme_features")
    both = [c for c in features.columns if c in measured.columns and c != "enzyme_id"]
    wide = measured.join(features.drop(*both, "sequence"), "enzyme_id")
    kept = ("enzyme_id", "ph", "temperature_c", "substrate", "activity", "is_active", "instability_index", "helix_fraction", "aa_l")
    return wide.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if dict(wide.dtypes)[c] == "double" else F.col(c) for c in kept])


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pet_activity_ml").where("is_active IS NOT NULL")
    return rows.groupBy("substrate", "temperature_c").agg(F.count_if("is_active").alias("active"), F.count("*").alias("n"))


def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 of the majority label of the other folds."""
    rows = read(spark, d, "pet_activity_ml").where("is_active IS NOT NULL AND cv_split IS NOT NULL").select("cv_split", "is_active")
    guess = modelling.majority_by_fold(rows, "is_active", "cv_split")
    out = modelling.macro_f1(rows.join(guess, "cv_split"), "is_active", "guess", ["cv_split"])
    return out.select("cv_split", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def fold_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of activity per fold."""
    rows = read(spark, d, "pet_activity_ml").where(F.col("activity").isNotNull() & ~F.isnan("activity") & F.col("cv_split").isNotNull())
    return rows.groupBy("cv_split").agg(F.round(F.avg("activity"), 6).alias("mean"), F.round(F.stddev_pop("activity"), 6).alias("deviation"), F.count("*").alias("n"))


def regression_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the mean of substrate and temperature as a guess of activity, per fold."""
    rows = read(spark, d, "pet_activity_ml").where(F.col("activity").isNotNull() & ~F.isnan("activity") & F.col("cv_split").isNotNull())
    means = rows.groupBy("substrate", "temperature_c").agg(F.avg("activity").alias("guess"))
    out = modelling.regression_errors(rows.join(means, ["substrate", "temperature_c"]), "activity", "guess", ["cv_split"])
    return out.select("cv_split", *[F.round(c, 6).alias(c) for c in ("r2", "mae", "rmse")])


def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    """Label of every query vector by its five nearest rows."""
    table = read(spark, d, "embeddings")
    return modelling.knn_labels(table, table.where("vec_id % 100 = 0"), 5, "vec_id", "embedding", "label")


def _binned(rows: DataFrame) -> DataFrame:
    return modelling.bins(rows, CONDITIONS)


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pet_activity_ml").where("is_active IS NOT NULL AND cv_split IS NOT NULL")


def _cells(spark: SparkSession, d: str) -> modelling.CellCounts:
    return modelling.CellCounts(_binned(_measured(spark, d)), CONDITIONS, "is_active", "cv_split")


def minimal_columns(spark: SparkSession, d: str) -> DataFrame:
    """Fewest columns whose table model is within 0.02 of the one of all, over fixed folds."""
    best, value = search.minimal_subset(CONDITIONS, _cells(spark, d).score, most=3)
    return spark.createDataFrame([(c, i, round(value, 6)) for i, c in enumerate(best, 1)], "column_name string, place int, score double")


def _nested(spark: SparkSession, d: str) -> list[tuple[int, tuple[str, ...], float, float]]:
    """(fold, columns, score, score of all columns): columns chosen without the fold, then scored on it once."""
    cells, out = _cells(spark, d), []
    for f in cells.folds():
        chosen, _ = search.minimal_subset(CONDITIONS, lambda c, f=f: cells.score(c, without=(f,)), most=3)
        out.append((int(f), chosen, cells.by_fold(chosen, on=[f])[f], cells.by_fold(CONDITIONS, on=[f])[f]))
    return out


def nested_cv(spark: SparkSession, d: str) -> DataFrame:
    """Nested cross-validation: the selection never sees the fold that it is scored on."""
    rows = [(f, ",".join(c), round(x, 6), round(y, 6)) for f, c, x, y in _nested(spark, d)]
    return spark.createDataFrame(rows, "cv_split int, columns string, accuracy double, accuracy_of_all double")


def selected_columns(spark: SparkSession, d: str) -> DataFrame:
    """In how many outer folds each column was chosen."""
    rows = [(c,) for _, chosen, *_ in _nested(spark, d) for c in chosen]
    return spark.createDataFrame(rows, "column_name string").groupBy("column_name").agg(F.count("*").alias("folds"))


MODELS = {"conditions": CONDITIONS[:2], "sequence": CONDITIONS[2:], "all": CONDITIONS}


def _scenario_scores(spark: SparkSession, d: str) -> Callable[[str, str], float]:
    """The score of a model in a scenario; a scenario's cells are counted when it is first asked for."""
    rows = _measured(spark, d).withColumns({c: F.col(c).cast("double") for c in CONDITIONS})
    key = F.concat_ws("|", "enzyme_id", "ph", "temperature_c", "substrate", "activity")
    edges = modelling.edges(rows, CONDITIONS)  # of the undisturbed table, for both sides
    count = lambda df: modelling.CellCounts(modelling.binned_at(df, edges), CONDITIONS, "is_active", "cv_split")

    @functools.cache
    def cells(name: str) -> tuple[modelling.CellCounts, modelling.CellCounts]:
        train, test = modelling.scenario_pair(rows, name, CONDITIONS, "is_active", key)
        first = count(train)
        return first, first if train is test else count(test)

    def score(model: str, name: str) -> float:
        train, test = cells(name)
        got = list(test.by_fold(MODELS[model], train=train).values())
        return sum(got) / len(got) if got else 0.0

    return score


def robust_minimax(spark: SparkSession, d: str) -> DataFrame:
    """Worst score of three table models over adverse versions of the table, best first."""
    score = _scenario_scores(spark, d)
    worst = {m: min((score(m, name), name) for name in modelling.SCENARIOS) for m in MODELS}
    rows = sorted(((m, round(x, 6), name) for m, (x, name) in worst.items()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "model string, worst double, scenario string")


def robust_choice(spark: SparkSession, d: str) -> DataFrame:
    """The model whose worst case is best, found by alpha-beta search; scores that cannot matter are not
    computed, and how many were is told."""
    best, worst, n = search.worst_case_choice(list(MODELS), modelling.SCENARIOS, _scenario_scores(spark, d))
    return spark.createDataFrame([(best, round(worst, 6), n, len(MODELS) * len(modelling.SCENARIOS))], "model string, worst double, computed int, of int")


def tree_cv(spark: SparkSession, d: str) -> DataFrame:
    """A decision tree over fixed folds: mean macro-F1, its deviation, and the gap to training."""
    rows = _measured(spark, d).select("cv_split", "substrate", *[F.col(c).cast("double").alias(c) for c in CONDITIONS], F.col("is_active").cast("double").alias("label")).persist()
    scores = modelling.cross_validate(rows, "cv_split", lambda: modelling.pipeline(CONDITIONS, ("substrate",), "label"), "label")
    return modelling.fold_summary(scores).select(*[F.round(c, 4).alias(c) for c in ("mean", "deviation", "gap")])


def tuned_table_model(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the table model chosen by genetic search; the counts are made once, scores are sums of them."""
    cells = _cells(spark, d)
    chosen = lambda g: [c for c in CONDITIONS if g[c]]
    best, score = search.evolve({c: (True, False) for c in CONDITIONS}, lambda genomes: [cells.score(chosen(g)) if chosen(g) else float("nan") for g in genomes])
    return spark.createDataFrame([(",".join(chosen(best)), round(score, 6))], "columns string, score double")


QUERIES = {f.__name__: f for f in (
    loo_contrast, contrast_as_recorded, review_decisions, review_applied, review_counts, review_contrasts, review_reasons, review_eligible, nested_cv, selected_columns, stratified_sample, sample_allocation, uniform_sample, wilson_by_lang, reidentified, descriptors, sequence_counts, composition_long, conditions_long, ml_view,
    class_balance, majority_baseline, fold_stats, regression_errors, knn_predict, minimal_columns, robust_minimax, robust_choice, tree_cv, tuned_table_model,
)}

_OK = "activity IS NOT NULL AND NOT isnan(activity)"
_CLEAN_SEQ = "regexp_replace(regexp_replace(upper(sequence), '\\s+', '', 'g'), '\\*+$', '')"
_N = lambda a: f"(length(s) - length(replace(s, '{a}', '')))"

_CITES = review.CITES.replace("'", "''")
_RECORDS = """f AS (SELECT record_id, doc_id, enzyme, mutations, metric, value, unit, conditions, evidence_span, extracted_by, verified, nullif(regexp_extract(record_id, '([0-9]+)$', 1), '')::BIGINT AS n FROM mutant_stability
    QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY doc_id NULLS FIRST, enzyme NULLS FIRST, mutations NULLS FIRST, metric NULLS FIRST, value NULLS FIRST, unit NULLS FIRST, conditions NULLS FIRST, evidence_span NULLS FIRST, extracted_by NULLS FIRST, verified NULLS FIRST) = 1)"""
_CONTRAST = _RECORDS + f""", named AS (SELECT *, CASE WHEN trim(enzyme) <> '' THEN enzyme || '|' || coalesce(metric, '') || '|' || coalesce(unit, '') END AS e, coalesce(mutations, '') AS m, coalesce(regexp_matches(evidence_span, '{_CITES}'), false) AS cites FROM f WHERE value IS NOT NULL AND NOT isnan(value)),
    contrasts AS (SELECT a.record_id, count(DISTINCT b.doc_id) AS others, count(*) FILTER (b.cites) AS citing, median(b.value) AS median,
      CASE WHEN a.e IS NULL THEN 'generic' WHEN median(b.value) IS NULL THEN 'alone' WHEN abs(a.value - median(b.value)) > 5 THEN 'differs' ELSE 'agrees' END AS contrast
      FROM named a LEFT JOIN named b ON a.e = b.e AND a.m = b.m AND a.doc_id <> b.doc_id GROUP BY a.record_id, a.e, a.value)"""
_DECIDED = _RECORDS + """, a AS (SELECT record_id, n % 5 = 0 AS no1, n % 7 = 0 AS no2, n % 11 = 0 AS adds, n % 11 <> 0 AND n % 13 = 0 AS no4, CASE WHEN n % 14 = 0 THEN 'NewPETase' END AS e2, CASE WHEN n % 17 = 0 THEN 'A1C' END AS m2,
      CASE WHEN n % 10 = 0 THEN nullif(regexp_extract(evidence_span, '([0-9]+[.][0-9]{1,3})', 1), '')::DOUBLE END AS v2, coalesce(evidence_span, '') AS span, coalesce(conditions, '') AS c FROM f WHERE n % 3 <> 2),
    b AS (SELECT *, CASE WHEN v2 IS NOT NULL AND NOT contains(span, regexp_replace(regexp_replace(format('{:.6f}', v2), '0+$', ''), '[.]$', '')) THEN 'the corrected value is not in the sentence' END AS error,
      no4 OR (no1 AND v2 IS NULL) OR (no2 AND e2 IS NULL) AS lost, v2 IS NOT NULL OR e2 IS NOT NULL OR m2 IS NOT NULL AS changed FROM a),
    d0 AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN lost THEN 'descartar' WHEN no1 OR no2 OR no4 OR changed THEN 'corregir' ELSE 'ok' END END AS decision FROM b),
    decided AS (SELECT record_id, decision, CASE WHEN error IS NULL THEN CASE WHEN no1 OR no2 OR no4 THEN list_filter([CASE WHEN no1 THEN 'valor_no_respaldado' END, CASE WHEN no2 THEN 'enzima_equivocada' END, CASE WHEN no4 THEN 'condiciones_no_precisables' END], lambda x: x IS NOT NULL)
      WHEN changed THEN ['ajuste_menor'] ELSE [] END END AS reasons, error, CASE WHEN decision <> 'descartar' THEN e2 END AS enzyme, CASE WHEN decision <> 'descartar' THEN m2 END AS mutations, NULL::VARCHAR AS metric,
      CASE WHEN decision <> 'descartar' THEN v2 END AS value, CASE WHEN decision <> 'descartar' AND adds THEN concat_ws('; ', nullif(c, ''), 'pH 8') END AS conditions FROM d0)"""

SQL = {
    "contrast_as_recorded": f"WITH {_CONTRAST} SELECT record_id, others, citing, round(median, 6) AS median, contrast FROM contrasts",
    "review_decisions": f"WITH {_DECIDED} SELECT record_id, decision, array_to_string(reasons, ',') AS reasons, error, enzyme, mutations, metric, value, conditions FROM decided",
    "review_counts": f"""WITH {_DECIDED}, c AS (SELECT f.metric, count(*) FILTER (decision = 'ok') AS ok, count(*) FILTER (decision = 'corregir') AS corregir, count(*) FILTER (decision = 'descartar') AS descartar,
          count(*) FILTER (decision IS NULL) AS sin_revisar, count(decision) AS n FROM f LEFT JOIN decided g USING (record_id) GROUP BY f.metric)
        SELECT metric, ok, corregir, descartar, sin_revisar, CASE WHEN n > 0 THEN round(ok / n, 6) END AS precision,
          CASE WHEN n > 0 THEN round((ok / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(ok / n * (1 - ok / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) END AS lower FROM c""",
    "review_contrasts": f"""WITH {_DECIDED}, {_CONTRAST.removeprefix(_RECORDS + ", ")}, j AS (SELECT decision, CASE WHEN contrast IN ('differs', 'agrees') THEN contrast ELSE 'none' END AS contrast FROM decided LEFT JOIN contrasts USING (record_id) WHERE decision IS NOT NULL)
        SELECT contrast, count(*) FILTER (decision = 'ok') AS ok, count(*) FILTER (decision = 'corregir') AS corregir, count(*) FILTER (decision = 'descartar') AS descartar FROM j GROUP BY 1""",
    "review_reasons": f"WITH {_DECIDED}, u AS (SELECT unnest(reasons) AS reason FROM decided) SELECT reason, count(*) AS facts FROM u GROUP BY 1",
    "review_applied": f"""WITH {_DECIDED} SELECT record_id, coalesce(g.enzyme, f.enzyme) AS enzyme, coalesce(g.mutations, f.mutations) AS mutations, coalesce(g.value, f.value) AS value, CASE WHEN decision IS NOT NULL THEN true ELSE f.verified END AS verified,
        CASE WHEN decision = 'corregir' THEN 'human:reviewer' ELSE extracted_by END AS extracted_by FROM f LEFT JOIN decided g USING (record_id) WHERE coalesce(decision, '') <> 'descartar'""",
    "review_eligible": f"""WITH {_RECORDS} SELECT CASE WHEN contains(coalesce(conditions, ''), 'order of the names') THEN 'values in the order of the names' WHEN trim(coalesce(enzyme, '')) = '' THEN 'no enzyme' ELSE 'eligible' END AS why,
        count(*) AS facts, count(*) FILTER (regexp_matches(evidence_span, '{_CITES}')) AS citing FROM f GROUP BY 1""",
    "sample_allocation": """WITH g AS (SELECT section, count(*) AS n FROM (SELECT DISTINCT chunk_id, section FROM documents_curated) GROUP BY section)
        SELECT section, least(n, greatest(3, round_even(60 * n / (SELECT sum(n) FROM g), 0)))::BIGINT AS drawn FROM g""",
    "stratified_sample": """WITH r AS (SELECT DISTINCT chunk_id, section FROM documents_curated), g AS (SELECT section AS s, count(*) AS n FROM r GROUP BY 1), w AS (SELECT s, least(n, greatest(3, round_even(60 * n / (SELECT sum(n) FROM g), 0)))::BIGINT AS k FROM g)
        SELECT chunk_id, section FROM r JOIN w ON section IS NOT DISTINCT FROM s QUALIFY row_number() OVER (PARTITION BY section ORDER BY md5(chunk_id || '|0'), chunk_id) <= k""",
    "uniform_sample": "SELECT DISTINCT chunk_id FROM documents_curated ORDER BY md5(chunk_id || '|0'), chunk_id LIMIT 50",
    "reidentified": """WITH o AS (SELECT record_id, max(doc_id) AS d, max(enzyme) AS e, max(mutations) AS m, max(metric) AS k, max(value) AS v FROM mutant_stability GROUP BY 1),
        c AS (SELECT d, e, m, k, v, min(record_id) AS r FROM o WHERE k = 'Tm' GROUP BY ALL HAVING count(*) = 1) SELECT record_id AS old_key, record_id AS new_key FROM o WHERE k IS DISTINCT FROM 'Tm'
        UNION ALL SELECT r, 'new:' || r FROM c WHERE d IS NOT NULL AND e IS NOT NULL AND m IS NOT NULL AND v IS NOT NULL""",
    "wilson_by_lang": """WITH l AS (SELECT doc_id, count(DISTINCT subject) AS a FROM subject_labels GROUP BY 1), g AS (SELECT lang, count(*) FILTER (a > 1) AS good, count(*) AS n FROM l JOIN documents USING (doc_id) GROUP BY lang)
        SELECT lang, good, n, round((good / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(good / n * (1 - good / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lower FROM g""",
    "sequence_counts": f"WITH r AS (SELECT DISTINCT enzyme_id, {_CLEAN_SEQ} AS raw FROM enzyme_features), q AS (SELECT *, regexp_replace(raw, '[^{modelling.RESIDUES}]', '', 'g') AS s FROM r) SELECT enzyme_id, length(s)::INT AS seq_length, (length(raw) - length(s))::INT AS nonstandard_residues, "
    f"round(({_N('F')} + {_N('W')} + {_N('Y')}) / length(s), 5) AS aromaticity, round(({' + '.join(f'{_N(a)} * {v}' for a, v in modelling.HYDROPATHY.items())}) / length(s), 5) AS gravy, round({_N('L')} / length(s), 5) AS aa_l FROM q",
    "composition_long": "SELECT enzyme_id, residue, share FROM (UNPIVOT (SELECT enzyme_id, " + ", ".join(f"aa_{a.lower()}" for a in modelling.RESIDUES) + " FROM enzyme_features) ON COLUMNS('aa_.*') INTO NAME residue VALUE share)",
    "conditions_long": f"WITH m AS (SELECT enzyme_id, format('{{:.1f}}', ph)::DOUBLE AS ph, temperature_c, substrate, max(activity) AS activity FROM pet_activity_ml WHERE {_OK} GROUP BY ALL) SELECT *, activity > 0 AS is_active FROM m",
    "ml_view": "SELECT m.enzyme_id, CASE WHEN NOT isnan(ph) THEN ph END AS ph, temperature_c, substrate, CASE WHEN NOT isnan(activity) THEN activity END AS activity, is_active, "
    "CASE WHEN NOT isnan(instability_index) THEN instability_index END AS instability_index, CASE WHEN NOT isnan(helix_fraction) THEN helix_fraction END AS helix_fraction, CASE WHEN NOT isnan(aa_l) THEN aa_l END AS aa_l FROM pet_activity_ml m JOIN enzyme_features f USING (enzyme_id)",
    "class_balance": "SELECT substrate, temperature_c, count(*) FILTER (is_active) AS active, count(*) AS n FROM pet_activity_ml WHERE is_active IS NOT NULL GROUP BY ALL",
    "majority_baseline": """WITH r AS (SELECT cv_split, is_active FROM pet_activity_ml WHERE is_active IS NOT NULL AND cv_split IS NOT NULL),
        g AS (SELECT f.cv_split, (SELECT is_active FROM r WHERE r.cv_split <> f.cv_split GROUP BY is_active ORDER BY count(*) DESC, is_active LIMIT 1) AS guess FROM (SELECT DISTINCT cv_split FROM r) f),
        c AS (SELECT cv_split, is_active AS t, guess AS g, count(*) AS n FROM r JOIN g USING (cv_split) GROUP BY ALL), l AS (SELECT cv_split, t AS x FROM c UNION SELECT cv_split, g FROM c),
        f AS (SELECT l.cv_split, x, coalesce(sum(n) FILTER (t = x AND g = x), 0) AS tp, coalesce(sum(n) FILTER (t = x), 0) + coalesce(sum(n) FILTER (g = x), 0) AS two FROM l JOIN c USING (cv_split) GROUP BY l.cv_split, x)
        SELECT cv_split, round((SELECT sum(n) FILTER (t = g) / sum(n) FROM c WHERE c.cv_split = f.cv_split), 6) AS accuracy, round(avg(2 * tp / two), 6) AS macro_f1 FROM f GROUP BY cv_split""",
    "fold_stats": f"SELECT cv_split, round(avg(activity), 6) AS mean, round(stddev_pop(activity), 6) AS deviation, count(*) AS n FROM pet_activity_ml WHERE {_OK} AND cv_split IS NOT NULL GROUP BY cv_split",
    "regression_errors": f"""WITH r AS (SELECT * FROM pet_activity_ml WHERE {_OK} AND cv_split IS NOT NULL), m AS (SELECT substrate, temperature_c, avg(activity) AS guess FROM r GROUP BY ALL),
        j AS (SELECT cv_split, activity AS a, activity - guess AS e FROM r JOIN m USING (substrate, temperature_c))
        SELECT cv_split, round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM j GROUP BY cv_split""",
    "knn_predict": """WITH s AS (SELECT q.vec_id AS query_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, t.vec_id) AS r
        FROM embeddings t JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id QUALIFY r <= 5), v AS (SELECT query_id, label, count(*) AS n FROM s GROUP BY ALL)
        SELECT query_id, label AS guess FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
}
