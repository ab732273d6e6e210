import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.functions import classify, folding, keys, missing
from attestry.operators import chunking, components, dedup, merge, modelling, provenance, retrieval, review, search, topics
from attestry.operators.facts import enzymes_in, facts_in, mutations_in, quoted, sentences


def values(spark, texts, expr):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_doi_keys(spark):
    got = values(spark, ["10.1/A", "https://doi.org/10.1/a ", "doi:10.1/a", " https://doi.example/10.1/a.", "", None, "n/a"], keys.doi_key)
    assert got == ["10.1/a"] * 4 + [None] * 3


def test_standins(spark):
    texts = ["", None, "  ", "N/A", "[full text not available]", "PDF only", "Full text is held by the publisher and cannot be shown here.", "Resumen no disponible", "-", "The enzyme was not available in time, so a second batch was made."]
    assert values(spark, texts, missing.is_standin) == [True] * 9 + [False]


def test_license_names(spark):
    assert values(spark, ["CC BY 4.0", "cc-by", "", None, "CC_BY-NC  4.0"], classify.license_name) == ["cc-by", "cc-by", "(sin declarar)", "(sin declarar)", "cc-by-nc"]


def test_languages(spark):
    texts = ["The enzyme was found in the soil and it is stable at high temperature for days.", "La enzima se encontró en el suelo y es estable por muchos días con el calor de la zona.", "聚酯水解酶的热稳定性研究报告第二版本说明", "short", None, "Гидролаза ПЭТ была выделена из почвы и сохраняет активность при нагревании."]
    assert values(spark, texts, classify.language) == ["en", "es", "cjk", "desconocido", "desconocido", "cirilico"]


def test_relevance_leaves_out_scans(spark):
    f = lambda t: classify.document_relevance(F.lit("article"), t, F.lit(""), F.lit(""))
    assert values(spark, ["PET hydrolase engineering", "PET/CT of the liver", "Recycling of polyester", "A lipase for plastics"], f) == ["nucleo_pet_enzima", "fuera_de_alcance", "plasticos_sin_enzima", "enzima_plasticos_sin_pet"]


def test_folding():
    assert folding.fold_literal("Ｔm — “x” y​") == 'tm - "x" y'


def test_chunks_keep_ordinals_and_tables():
    table = "Table 1 " + "1.2 ± 0.3 " * 900
    text = f"## Intro\n{'A sentence of some words. ' * 30}\n## Data availability\n{'On request. ' * 20}\n## References\n[1] x\n## Tiny\nshort\n## Only title\n## Results\n{table}"
    out = chunking.chunk_document("T", "An abstract that is surely longer than fifty characters, is it not?", text)
    assert [c[0] for c in out] == list(range(1, len(out) + 1))
    assert [(c[1], c[3]) for c in out] == [("Resumen", None), ("Intro", None), ("Data availability", "administrative"), ("Tiny", "too_short"), ("Only title", "title_only"), ("Results", None)]
    assert out[-1][2] == table.strip()


def test_long_lines_overlap_and_stay_under_the_limit():
    text = "## S\n" + " ".join(f"Sentence number {i} tells of one more thing." for i in range(400)) + "\n" + "x " * 4000
    out = chunking.chunk_document("", "", text)
    assert len(out) > 4 and all(chunking.size(c[2]) <= chunking.MOST for c in out)
    assert out[1][2].split(". ")[0] in out[0][2]
    assert chunking.chunk_document(None, None, None) == [] == chunking.chunk_document("", " ", "")


DOC = "doc_id string, source string, doc_type string, title string, doi string, content_hash string, full_text string, abstract string"


def test_deduplication(spark):
    rows = [
        ("s:1", "europepmc", "article", "t", "10.1/x", "h1", "text", ""), ("s:2", "openalex", "preprint", "t", "https://doi.org/10.1/X", "h2", "longer text", ""), ("s:3", "pdb", "structure", "t", "10.1/x", "h3", "", ""),
        ("s:4", "openalex", "dataset", "A dataset title that is long", "10.2/a", "h4", "", "abc"), ("s:5", "zenodo", "dataset", "a dataset title that is LONG", "10.2/b", "h5", "", ""), ("s:6", "openalex", "dataset", "short", "10.2/c", "h6", "", ""),
        ("s:7", "zenodo", "dataset", "short", "10.2/d", "h7", "", ""), ("s:8", "openalex", "article", None, None, "same", "", ""), ("s:9", "openalex", "article", None, "", "same", "", ""), ("s:9", "openalex", "article", None, "", "same", "", ""),
    ]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.survivor for r in dedup.deduplicate(df).collect()}
    assert got == {f"s:{i}": f"s:{j}" for i, j in ((1, 1), (2, 1), (3, 3), (4, 5), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8))}
    again = {r.doc_id: r.survivor for r in dedup.deduplicate(df.where(F.col("doc_id").isin(*got.values()))).collect()}
    assert again == {k: k for k in got.values()}
    assert dedup.deduplicate(df.limit(0)).count() == 0


def test_surviving_rows_are_the_last_fetched(spark, tmp_path):
    rows = [("a", "one", 1), ("a", "two", 3), ("a", "two", 3), ("b", "x", 1), ("c", "y", 2), ("c", None, None)]
    spark.createDataFrame(rows, "doc_id string, full_text string, fetched_at int").repartition(3).write.parquet(str(tmp_path / "s"))
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "doc_id string, survivor string")
    assert sorted(map(tuple, dedup.surviving_rows(spark.read.parquet(str(tmp_path / "s")), members).collect())) == [("a", "two", 3), ("c", "y", 2)]


def test_cleaning_before_pieces(spark):
    from attestry.plans.curation import clean_text

    texts = ["&lt;i&gt;Is&lt;/i&gt;PETase", "&amp;lt;b&amp;gt;k&amp;lt;/b&amp;gt;<sub>cat</sub> a  b", "write to ana.b@uni.example now", "p < 0.05 & q > 1", None, ""]
    assert values(spark, texts, clean_text) == ["IsPETase", "kcat a b", "write to [correo omitido] now", "p < 0.05 & q > 1", None, ""]


FACT = "record_id string, doc_id string, enzyme string, mutations string, value double, special boolean, cites boolean"


def test_contrast_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(f"r{i:03}", f"d{int(rnd.integers(0, 9)) if i % 3 else 0}", ["LCC", "LCC", "HiC", "PETase", None][int(rnd.integers(0, 5))], ["", "A1C", None][int(rnd.integers(0, 3))], float(np.round(rnd.normal(60, 8), 0)), bool(i % 11 == 0), bool(i % 4 == 0)) for i in range(400)]
    got = {r.record_id: r for r in review.contrast(spark.createDataFrame(rows + rows[:5], FACT)).collect()}
    assert len(got) == 400
    for rid, doc, enzyme, mutations, value, *_ in rows:
        if not enzyme or enzyme == "PETase":
            assert got[rid].contrast == "generic" and got[rid].others == 0 and got[rid].median is None
            continue
        others = [r for r in rows if r[2] == enzyme and (r[3] or "") == (mutations or "") and r[1] != doc and not r[5]]
        median = float(np.median([r[4] for r in others])) if others else None
        want = "alone" if median is None else "differs" if abs(value - median) > 5 else "agrees"
        assert (got[rid].others, got[rid].citing, got[rid].median, got[rid].contrast) == (len({r[1] for r in others}), sum(r[6] for r in others), median, want), rid
    assert review.contrast(spark.createDataFrame([], FACT)).count() == 0


def test_decisions(spark):
    answer = "id string, q1_valor_en_frase string, q2_enzima_en_frase string, q3_metrica_correcta string, q4_condiciones string, enzima_corr string, mutaciones_corr string, metrica_corr string, valor_corr string, condiciones_corr string"
    told = {
        "ok": ("s", "S", " s ", "s", None, "", "", None, ""), "fixed": ("s", "n", "s", "s", "LCC", "", "", "", ""), "lost": ("s", "n", "s", "s", "", "", "", "", ""), "minor": ("s", "s", "s", "s", "", "A1C", "", "", ""),
        "noted": ("s", "s", "s", "a", "", "", "", "", "pH 8"), "vague": ("s", "s", "s", "n", "", "", "", "", "x"), "value": ("n", "s", "s", "s", "", "", "", "61,5", ""), "blank": ("", "", " ", None, "LCC", "", "", "", ""),
        "half": ("s", "", "s", "s", "", "", "", "", ""), "odd": ("s", "x", "s", "s", "", "", "", "", ""), "nan": ("n", "s", "s", "s", "", "", "", "sixty", ""), "far": ("n", "s", "s", "s", "", "", "", "99", ""), "metric": ("s", "s", "n", "s", "", "", "kcat", "", ""),
        "bare": ("s", "s", "s", "a", "", "", "", "", ""), "swap": ("s", "s", "n", "s", "", "", "dTm", "", ""), "gone": ("s", "s", "s", "s", "", "", "", "", ""),
    }
    facts = spark.createDataFrame([(k, "HiC", "", "Tm", 60.0, "in buffer" if k == "noted" else None, "The Tm was 61.5 C", "agent", False, "high" if k < "n" else "low") for k in told if k != "gone"], "record_id string, enzyme string, mutations string, metric string, value double, conditions string, evidence_span string, extracted_by string, verified boolean, confidence string")
    decided = review.decide(spark.createDataFrame([(k, *v) for k, v in told.items()], answer), facts)
    got = {r.record_id: r for r in decided.collect()}
    assert {k: r.decision for k, r in got.items() if r.error is None} == {"ok": "ok", "fixed": "corregir", "lost": "descartar", "minor": "corregir", "noted": "ok", "vague": "descartar", "value": "corregir", "swap": "corregir"}
    assert {k for k, r in got.items() if r.error} == {"half", "odd", "nan", "far", "metric", "bare"} and got["noted"].conditions == "in buffer; pH 8" and got["value"].value == 61.5
    assert got["fixed"].reasons == ["enzima_equivocada"] and got["minor"].reasons == ["ajuste_menor"] and got["vague"].reasons == ["condiciones_no_precisables"] and got["ok"].reasons == []
    try:
        review.apply_decisions(facts, decided, "ana")
        raise AssertionError("errors must stop everything")
    except ValueError as e:
        assert "6 rows" in str(e)
    good = decided.where("error IS NULL")
    done = {r.record_id: r for r in review.apply_decisions(facts, good, "ana").collect()}
    assert "lost" not in done and done["fixed"].enzyme == "LCC" and done["fixed"].extracted_by == "human:ana" and done["ok"].extracted_by == "agent" and done["ok"].verified and not done["blank"].verified
    counts = {r.confidence: r for r in review.decision_counts(facts, good).collect()}
    assert counts["high"].corregir == 2 and counts["high"].descartar == 1 and counts["high"].sin_revisar == 5 and counts["low"].ok == 2 and abs(counts["low"].precision - 0.4) < 1e-9
    crossed = {r.contrast: r for r in review.contrast_by_decision(good, spark.createDataFrame([("ok", "agrees"), ("lost", "differs")], "record_id string, contrast string")).collect()}
    assert crossed["agrees"].ok == 1 and crossed["differs"].descartar == 1 and crossed["none"].corregir == 4
    assert review.seconds_per_fact(good, 4).first().seconds == 30.0 and review.seconds_per_fact(good.limit(0), 4).first().seconds is None
    assert {r.reason: r.facts for r in review.reason_counts(good).collect()}["enzima_equivocada"] == 2


def test_eligibility_and_citations(spark):
    spans = ["as reported [ 19 ]", "by Then et al., 2016", "( Perz 2015 )", "(Ana and Bo, 2014)", "a value of 46.8", None]
    assert values(spark, spans, review.cites_another) == [True, True, True, True, False, False]
    df = spark.createDataFrame([("values in the order of the names", "LCC"), (None, " "), ("", "LCC")], "c string, e string").select(review.not_eligible(F.col("c"), F.col("e")))
    assert [r[0] for r in df.collect()] == ["values in the order of the names", "no enzyme", None]


def test_cell_counts_are_those_of_the_table_model(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4).alias("fold"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)).alias(f"{c}_bin") for i, c in enumerate("xyz")]).withColumn("y", (F.col("x_bin") + F.col("z_bin") + F.col("fold")) % 3 == 0)
    cells = modelling.CellCounts(df, "xyz", "y", "fold")
    for chosen in ("x", "xz", "xyz", ""):
        want = {r.fold: r.accuracy for r in modelling.table_model_scores(df, list(chosen), "y", "fold").collect()}
        got = cells.by_fold(list(chosen))
        assert want.keys() == got.keys() and all(abs(want[f] - got[f]) < 1e-12 for f in want), chosen
    other = df.withColumn("y", F.when(F.col("id") % 5 == 0, ~F.col("y")).otherwise(F.col("y")))
    want = {r.fold: r.accuracy for r in modelling.table_model_scores(df, ["x"], "y", "fold", train=other).collect()}
    got = cells.by_fold(["x"], train=modelling.CellCounts(other, "xyz", "y", "fold"))
    assert all(abs(want[f] - got[f]) < 1e-12 for f in want)
    inner = {r.fold: r.accuracy for r in modelling.table_model_scores(df.where("fold <> 2"), ["x"], "y", "fold").collect()}
    assert cells.by_fold(["x"], without=[2]) == inner
    rows, seen = modelling.separate(spark.createDataFrame([(1.0, True, "g", 0, "s", 2.0), (float("nan"), None, "g", 0, "s", 2.0)], "activity double, is_active boolean, enzyme_id string, cv_split int, source string, ph double"), "activity", ("activity", "is_active"), "enzyme_id", "cv_split", ("source",))
    assert rows.count() == 1 and seen == ["ph"]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, None), ("c", 3, False)], "k string, v int, verified boolean")
    new = spark.createDataFrame([("a", 9, False), ("b", 8, False), ("d", 7, True)], "k string, v int, verified boolean")
    both = merge.merge_snapshot(old, new, "k")
    assert {r.k: r.v for r in both.collect()} == {"a": 9, "b": 8, "c": 3, "d": 7}
    assert sorted(merge.merge_snapshot(both, new, "k").collect()) == sorted(both.collect())
    assert {r.k: r.v for r in merge.merge_where(old, new, "k", merge.keep_verified()).collect()} == {"a": 1, "b": 8, "c": 3, "d": 7}
    root = str(tmp_path / "t")
    merge.publish(old, root)
    merge.publish(both, root)
    assert merge.current(spark, root).count() == 4
    wider, added = merge.add_columns(old, new.withColumn("note", F.lit("x")).schema)
    assert added == ["note"] and wider.columns[-1] == "note" and merge.add_columns(wider, wider.schema)[1] == []
    assert merge.repeated_keys(new.unionByName(new), "k").count() == 3
    assert merge.audit_row(spark, {"kind": "x"}, ["b", "a", "a"]).first().refs == ["a", "b"]
    target = spark.createDataFrame([("d1#1", "d1"), ("d1#2", "d1"), ("d2#1", "d2")], "chunk string, doc string")
    source = spark.createDataFrame([("d1#1", "d1"), (None, "d1")], "chunk string, doc string")
    assert [r.chunk for r in merge.orphans(target, source, "chunk", "doc").collect()] == ["d1#2"]


def test_components_with_a_chain_and_a_hot_key(spark, monkeypatch):
    rows = [(f"n{i:03}", f"k{j}") for i in range(60) for j in (i, i + 1)] + [("solo", None), (None, "k1"), ("n000", "k0")] + [(f"h{i:04}", "hot") for i in range(500)]
    got = {r.node: r.component for r in components.components_by_keys(spark.createDataFrame(rows, "node string, key string"), "node", "key").collect()}
    monkeypatch.setattr(components, "NODES_PER_SALT", 40)  # the hot key over 13 salts
    assert {r.node: r.component for r in components.components_by_keys(spark.createDataFrame(rows, "node string, key string"), "node", "key").collect()} == got
    assert len(got) == 561 and got["solo"] == "solo" and {got[f"n{i:03}"] for i in range(60)} == {"n000"} and {got[f"h{i:04}"] for i in range(500)} == {"h0000"}


def test_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5)).astype("float32")
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 5), (103, [1.0, 2.0])] + [(i, [float(x) for x in v[0]]) for i in range(110, 114)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = retrieval.cosine_top_k(df, df.where("vec_id in (0, 7, 100, 102)"), 4).orderBy("query_id", "rank").collect()
    for q in (0, 7):
        pool = {i: np.array(e) for i, e in rows if e and len(e) == 5 and any(e) and i != q}
        best = sorted(pool, key=lambda i: (-round(float(pool[i] @ v[q] / np.linalg.norm(pool[i]) / np.linalg.norm(v[q])), 6), i))[:4]
        assert [r.vec_id for r in got if r.query_id == q] == best
    assert {r.query_id for r in got} == {0, 7}
    assert retrieval.only_approved(df, None, "vec_id").count() == df.count() and retrieval.only_approved(df, df.limit(0), "vec_id").count() == 0


def test_containment(spark):
    texts = spark.createDataFrame([(1, "a long text with a phrase in it"), (2, None), (3, "phrase")], "d long, t string")
    literals = spark.createDataFrame([(7, "phrase"), (8, "a phrase"), (9, ""), (10, None), (11, "phrase")], "i long, s string")
    assert {tuple(r) for r in retrieval.containing(texts, literals, "d", "t", "i", "s").collect()} == {(1, 7), (1, 8), (3, 7), (1, 11), (3, 11)}


def test_gate(spark):
    span = "The melting temperature of the enzyme was 46.8 C in buffer."
    hypotheses = spark.createDataFrame([
        ("good", "A statement that is long enough", "A prediction that is long enough", ["ph"]), ("bad", "short", None, ["ph", "nothing"]), ("lone", "A statement that is long enough", "A prediction that is long enough", []),
        ("one", "A statement that is long enough", "A prediction that is long enough", None),
    ], "hypothesis_id string, statement string, prediction string, variables array<string>")
    evidence = spark.createDataFrame([
        ("good", 1, " d1", span, 46.8, "r1"), ("good", 2, "d2", "Ｔhe   SECOND document says — quite something else.", None, ""), ("bad", 1, "d1", span, 46.9, "r1"), ("bad", 2, "gone", span, 46.8, "r9"),
        ("bad", 3, "d2", span, None, "r9"), ("bad", 4, "d3", "short", None, "r2"), ("bad", 5, "d1", None, 8.0, None), ("one", 1, "d1", span, 46.8, "r1"),
    ], "hypothesis_id string, evidence_no int, doc_id string, evidence_span string, value double, record_id string")
    corpus = spark.createDataFrame([("d1", f"x {span} y", "ana", "s1"), ("d1", None, None, "s1"), ("d2", 'no\nThe second document says - quite something else. "End"', "bo", "s2"), ("d3", "a short text", " ", None)], "doc_id string, text string, approved_by string, source string")
    records = spark.createDataFrame([("r1", 46.8, True, "x"), ("r2", 1.0, None, None)], "record_id string, value double, verified boolean, extracted_by string")
    columns = spark.createDataFrame([("ph",)], "name string")
    checks = provenance.gate(hypotheses, evidence, corpus, records, columns)
    got = {(r.hypothesis_id, r.evidence_no, r.name): r for r in checks.collect()}
    assert {k[2] for k in got} == {*provenance.GLOBAL_CHECKS, *provenance.EVIDENCE_CHECKS, provenance.WARNING}
    assert {(k[1], k[2]) for k, r in got.items() if k[0] == "bad" and not r.passed} == {
        (0, "enunciado_presente"), (0, "prediccion_presente"), (0, "variables_existen"), (1, "valor_en_span"), (1, "valor_coincide_registro"), (2, "doc_existe"), (3, "span_literal"), (3, "registro_existe"),
        (4, "doc_aprobado"), (4, "span_suficiente"), (4, "registro_verificado"), (5, "span_suficiente"), (5, "span_literal"), (5, "valor_en_span"),
    }
    assert got["bad", 3, "span_literal"].detail == "not in d2; found in 1 other, first d1" and got["bad", 0, "variables_existen"].detail == "no such column: nothing"
    assert got["bad", 1, "valor_coincide_registro"].value == 46.8 and got["bad", 1, "valor_coincide_registro"].threshold == 46.9 and (("bad", 2, "doc_aprobado") not in got)
    told = {r.hypothesis_id: r for r in provenance.verdicts(checks).collect()}
    assert {k: r.verdict for k, r in told.items()} == {"good": "ADMITIDA", "bad": "RECHAZADA", "lone": "RECHAZADA", "one": "ADMITIDA_CON_AVISOS"} and told["bad"].failed == 14 and told["one"].warnings == 1
    assert provenance.verdicts(checks).orderBy("hypothesis_id").collect() == provenance.verdicts(checks.repartition(5)).orderBy("hypothesis_id").collect()
    lines = [r.line for r in provenance.receipt_lines(checks).where("hypothesis_id = 'one'").orderBy("evidence_no", "place").collect()]
    assert lines[0] == "[ok] respaldo_presente: 1 / 1" and "[warning] fuentes_distintas: 1 / 2 - all evidence comes from fewer sources" in lines and "[ok] respaldo[0].span_suficiente: 59 / 40" in lines
    assert provenance.gate(hypotheses, evidence.limit(0), corpus, records).where("name = 'respaldo_presente'").select("passed").distinct().collect() == [Row(passed=False)]
    assert provenance.gate(hypotheses.limit(0), evidence.limit(0), corpus, records).count() == 0


def test_passages_snippets_and_answers(spark):
    text = "The variant withstands sixty degrees of heat for a whole day."
    chunks = spark.createDataFrame([
        ("a#1", "a", "Results", f"  {text} ", "ana"), ("a#2", "a", "Methods", "A variant of heat was measured over degrees in a bath.", "ana"), ("a#3", "a", "Results", text.upper(), None), ("b#1", "b", "Results", text + " Indeed it does.", " "),
        ("c#1", "c", "Results", text, "bo"), ("c#2", "c", "Results", "Unrelated sentences of sufficient length stand here.", "bo"), ("d#1", "d", "Results", "variant heat", "bo"), ("e#1", "e", None, None, "bo"),
    ], "chunk_id string, doc_id string, section string, text string, approved_by string")
    queries = spark.createDataFrame([(1, "Which variant withstands degrees of heat?"), (2, "and so on"), (3, "Nothing alike xylophone")], "query_id int, text string")
    got = retrieval.passages(chunks, queries).orderBy("rank").collect()
    assert [(r.chunk_id, r.overlap, r.rank) for r in got] == [("a#1", 4, 1), ("c#1", 4, 2), ("a#2", 3, 3)] and got[0].evidence_span == text
    only = spark.createDataFrame([(1, "c"), (3, "c")], "query_id int, doc_id string")
    assert [r.chunk_id for r in retrieval.passages(chunks, queries, documents=only).collect()] == ["c#1"] and retrieval.passages(chunks, queries, documents=only.limit(0)).count() == 0
    assert [r.chunk_id for r in retrieval.passages(chunks, queries, per_document=1, results=1, section="METH").collect()] == ["a#2"]
    hits = spark.createDataFrame([(1, "d", 1, True), (1, "c", 2, True), (3, "a", 1, False)], "query_id int, doc_id string, rank int, has_evidence boolean")
    told = retrieval.snippets(hits, chunks, queries)
    assert {(r.doc_id, r.snippet) for r in told.collect()} == {("d", ""), ("c", text), ("a", "")}
    said = {r.query_id: r for r in retrieval.answers(queries, told).collect()}
    assert said[1].answered and said[1].citations == ["d", "c"] and said[1].spoken == text and not said[3].answered and said[3].citations == [] and said[2].spoken == retrieval.NO_EVIDENCE


def test_wilson_and_allocation(spark):
    got = spark.createDataFrame([(30, 30), (28, 30), (0, 0)], "g int, n int").select(F.round(review.wilson_lower(F.col("g"), F.col("n")), 3)).collect()
    assert [r[0] for r in got] == [0.886, 0.787, None]
    df = spark.createDataFrame([(i, "a" if i < 900 else "b" if i < 995 else "c" if i < 998 else None) for i in range(1000)], "id int, s string")
    drawn = review.stratified_sample(df, "id", F.col("s"), 50)
    assert {r.s: r["count"] for r in drawn.groupBy("s").count().collect()} == {"a": 45, "b": 5, "c": 3, None: 2}
    assert sorted(drawn.collect()) == sorted(review.stratified_sample(df.repartition(7), "id", F.col("s"), 50).collect())


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 1 + [("c", "a")] * 1, "t string, g string")
    r = modelling.macro_f1(df, "t", "g").first()
    assert math.isclose(r.accuracy, 0.7) and math.isclose(r.macro_f1, (2 * 6 / (8 + 7) + 2 * 1 / (1 + 3) + 0) / 3)
    assert modelling.task_of(df, "t") == "classification" and modelling.task_of(spark.range(100).select(F.rand(1).alias("x")), "x") == "regression"


def test_descriptors(spark):
    r = modelling.descriptors(spark.createDataFrame([("e", "acdef ghik\nlmnpqrstvwy*"), ("n", None)], "enzyme_id string, sequence string")).orderBy("enzyme_id").collect()
    assert r[0].seq_length == 20 and abs(r[0].molecular_weight - 2395.7) < 1 and abs(r[0].aa_a - 0.05) < 1e-9 and abs(r[0].gravy + 0.49) < 1e-6 and 6 < r[0].isoelectric_point < 8
    assert r[1].seq_length == 0 and r[1].gravy is None
    odd = modelling.descriptors(spark.createDataFrame([("e", "AAXXB")], "enzyme_id string, sequence string")).first()
    assert odd.seq_length == 2 and odd.nonstandard_residues == 3 and odd.aa_a == 1.0


def test_scenarios_disturb_one_side(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 3 == 0, i % 4) for i in range(400)], "i int, x double, y boolean, fold int")
    for name in modelling.SCENARIOS:
        train, test = modelling.scenario_pair(df, name, ["x"], "y", F.col("i").cast("string"))
        assert (train is df) == (name in ("original", "noise", "missing")) and (test is df) == (name not in ("noise", "missing"))
        assert test.count() == 400 and test.where("y").count() == df.where("y").count()
    few = modelling.scenario_pair(df, "few", ["x"], "y", F.col("i").cast("string"))[0].count()
    flipped = modelling.scenario_pair(df, "flipped", ["x"], "y", F.col("i").cast("string"))[0].join(df.select("i", F.col("y").alias("z")), "i").where("y <> z").count()
    assert 80 < few < 160 and 20 < flipped < 65
    rows = spark.createDataFrame([(0, True, 0)] * 3 + [(0, False, 1)] * 3 + [(1, False, 0)] * 2 + [(1, False, 1)] * 2, "x_bin int, y boolean, fold int")
    got = {r.fold: r.accuracy for r in modelling.table_model_scores(rows, ["x"], "y", "fold").collect()}
    assert got == {0: 0.4, 1: 0.4}  # each fold's bin 0 is guessed from the other fold


def test_search_engines():
    edges = {"s": [("a", 1.0), ("b", 4.0)], "a": [("b", 1.0), ("s", 1.0)], "b": [("g", 1.0)], "g": []}
    path, cost = search.ida_star(search.Problem("s", lambda x: edges[x], lambda x: x == "g"))
    assert path == ["s", "a", "b", "g"] and cost == 3.0
    assert search.ida_star(search.Problem("s", lambda x: [e for e in edges[x] if e[0] != "g"], lambda x: x == "g")) is None
    best, score = search.minimal_subset(["x", "y", "z"], lambda s: 0.9 if {"x", "z"} <= set(s) else 0.5)
    assert best == ("x", "z") and score == 0.9
    tree = {0: [1, 2], 1: [3, 4], 2: [5, 6]}
    leaf = {3: 3.0, 4: 5.0, 5: 2.0, 6: 9.0}
    assert search.alpha_beta(0, 2, lambda s: tree.get(s, []), leaf.get) == (3.0, 1, 3)
    # fail-hard: a value outside the window comes out as the window's edge
    assert search.alpha_beta(0, 2, lambda s: tree.get(s, []), leaf.get, low=4.0, high=8.0)[0] == 4.0 and search.alpha_beta(0, 2, lambda s: tree.get(s, []), leaf.get, low=0.0, high=2.5)[0] == 2.5
    table = {"a": (0.9, 0.2, 0.8), "b": (0.7, 0.6, 0.65), "c": (0.5, 0.9, 0.9)}
    assert search.worst_case_choice(list(table), [0, 1, 2], lambda m, i: table[m][i]) == ("b", 0.6, 7)
    genome, value = search.evolve({"a": range(10), "b": range(10)}, lambda g: [float("nan") if x["a"] == 9 else x["a"] + x["b"] for x in g], population=30, generations=20, seed=3)
    assert value >= 15


def test_topics(spark):
    docs = spark.createDataFrame([(i, ("enzyme stability melting " if i % 2 else "plastic recycling market ") * 4) for i in range(40)], "doc_id long, text string")
    weights = topics.tf_idf(docs, "doc_id", "text", most=0.6)
    assert weights.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("n")).select("n").distinct().collect() == [Row(n=1.0)]
    rows, h, terms = topics.factorise(weights, "doc_id", 2)
    main = rows.select((F.col("doc_id") % 2).alias("kind"), F.array_position("topics", F.array_max("topics")).alias("topic"))
    assert topics.rand_index(main, "kind", "topic").first().ari == 1.0
    assert topics.factorise(weights.limit(0), "doc_id", 2)[2] == []


def test_topics_use_every_term(spark, monkeypatch):
    weights = spark.range(20_600).select((F.col("id") % 7).alias("doc_id"), F.format_string("t%06d", "id").alias("term"), F.lit(0.1).alias("weight"))
    _, h, terms = topics.factorise(weights, "doc_id", 2, rounds=1)
    assert len(terms) == h.shape[1] == 20_600 and (h.sum(axis=0) > 0).all()
    few = weights.where("term < 't000300'")
    whole = topics.factorise(few, "doc_id", 2, rounds=2)[1]
    monkeypatch.setattr(topics, "SUM_BYTES", 8 * 2 * 4 * 37)  # sums in blocks of 37 columns
    assert abs(topics.factorise(few, "doc_id", 2, rounds=2)[1] - whole).max() < 1e-12


def test_a_pass_serves_all_factorisations(spark, monkeypatch):
    weights = spark.range(6_000).select((F.col("id") % 61).alias("doc_id"), F.format_string("t%04d", F.col("id") * 7 % 900).alias("term"), (1 + F.col("id") % 5).cast("double").alias("weight"))
    rows, terms = topics._indexed(weights.groupBy("doc_id", "term").agg(F.sum("weight").alias("weight")), "doc_id")
    starts = [topics._start(k, s, len(terms)) for k in (2, 3, 5) for s in (0, 1)]
    passes, true = [], topics._sums
    monkeypatch.setattr(topics, "_sums", lambda *a: passes.append(a[1:3]) or true(*a))
    monkeypatch.setattr(topics, "SUM_BYTES", 8 * 20 * len(terms))  # less than the sums of four tasks
    shared = topics._sums_of(rows, starts)
    assert passes == [(0, len(terms))]
    monkeypatch.setattr(topics, "SUM_BYTES", 8 * 5 * 37)  # one factorisation a pass, in blocks of 37 columns and more
    monkeypatch.setattr(topics, "BLOCK_BYTES", 8 * 5 * 10)
    for (x, g, error), (y, f, other) in zip(shared, topics._sums_of(rows, starts)):
        assert abs(x - y).max() < 1e-9 and abs(g - f).max() < 1e-9 and abs(error - other) < 1e-9 * error
    dense = {r.doc_id: {t.term: t.w for t in r.e} for r in weights.groupBy("doc_id", "term").agg(F.sum("weight").alias("w")).groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("e")).collect()}
    full = np.array([[d.get(t, 0.0) for t in terms] for d in dense.values()])
    for h, (x, g, error) in zip(starts, shared):
        w = topics._fit(full @ h.T, h @ h.T)
        assert abs(w @ full - x).max() < 1e-6 * abs(x).max() and abs(((full - w.T @ h) ** 2).sum() - error) < 1e-6 * error


def test_packs_hold_every_entry(monkeypatch):
    monkeypatch.setattr(topics, "ENTRIES", 10)
    lists = [[5, 1], [3] * 1, list(range(25, 0, -1)), [2, 4, 9], [7]]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys), pa.array([lists[i] for i in keys], pa.list_(pa.int32())), pa.array([[x / 2 for x in lists[i]] for i in keys])], names=["k", "t", "w"]) for keys in ([0, 1, 2], [3, 4])]
    got, packs = {}, [p for b in topics._packed(iter(batches)) for p in topics._packs(b)]
    for keys, edges, at, v, by in packs:
        assert (np.diff(at[by]) >= 0).all() and (v == at / 2).all()
        got |= {k: at[lo:hi].tolist() for k, lo, hi in zip(keys.to_pylist(), edges, edges[1:])}
    assert got == {i: sorted(x) for i, x in enumerate(lists)} and len(packs) == 3


def test_number_of_topics_is_the_stable_one(spark):
    words = ["enzyme stability melting", "plastic recycling market", "ocean litter survey"]
    docs = spark.createDataFrame([(i, f"{words[i % 3]} " * 4) for i in range(60)], "doc_id long, text string")
    weights = topics.tf_idf(docs, "doc_id", "text")
    rows, h, terms, tried = topics.stable_factors(weights, "doc_id", ks=(2, 3), seeds=3)
    assert [k for k, _ in tried] == [2, 3] and tried[1][1] == 1.0 and tried[0][1] < 1.0 and len(h) == 3
    main = rows.select((F.col("doc_id") % 3).alias("kind"), F.array_position("topics", F.array_max("topics")).alias("topic"))
    assert topics.rand_index(main, "kind", "topic").first().ari == 1.0
    again = topics.factorise(weights, "doc_id", 3, tolerance=1e-9)
    assert abs(again[1].sum(axis=1) - 1).max() < 1e-9


def test_topic_summary(spark):
    rows = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.5, 0.4]), ("c", [0.0, 0.3]), ("d", [0.0, 0.0])], "k string, topics array<double>")
    years = spark.createDataFrame([("a", 2010), ("b", 2020), ("c", None)], "k string, year int")
    got = {r.topic: (r.docs, r.median_year, r.several) for r in topics.topic_summary(rows, years, "k").collect()}
    assert got == {0: (2, 2015.0, 0.5), 1: (1, None, 0.0)}


def test_network_and_scaled_target(spark):
    df = spark.createDataFrame([(float(i % 10), "ab"[i % 2], float(i % 10 > 4), 5.0 * i) for i in range(80)], "x double, s string, label double, y double")
    fitted = modelling.fit_network(df, ["x"], ["s"], "label", hidden=(6,))
    assert fitted.transform(df).where("prediction = label").count() >= 76
    genes = {"layers": (1,), "neurons": (2, 8), "shrink": (1.0,), "solver": ("l-bfgs",), "rate": (0.03,), "rounds": (1, 60)}
    best, score = modelling.tune_network(df.withColumn("fold", (F.col("y") % 2).cast("int")), ["x"], ["s"], "label", "fold", genes, population=4, generations=3)
    assert score > 0.9 and best["rounds"] == 60
    scaled, back = modelling.scaled_target(df, "y")
    r = scaled.agg(F.avg("y"), F.stddev_pop("y")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and abs(scaled.select(F.max(back(F.col("y")))).first()[0] - 395) < 1e-6


def test_sentences_and_names():
    assert sentences("As in Fig. 4 it rose. Then it fell; see al. 2010.") == ["As in Fig. 4 it rose.", "Then it fell", "see al. 2010."]
    assert mutations_in("Ser121Glu and D186H, again S121E") == ["S121E", "D186H"]
    assert enzymes_in("LCC, lcc-like things, Is PETase and a cutinase; LCC") == ["LCC", "IsPETase"]


CASES = {
    "The Tm of IsPETase was 46.8 °C.": [("IsPETase", "", "Tm", 46.8, "high")],
    "IsPETase S121E/D186H had a Tm of 57.6 °C, with a ΔTm of +8.8 °C.": [("IsPETase", "S121E,D186H", "Tm", 57.6, "high"), ("IsPETase", "S121E,D186H", "dTm", 8.8, "low")],
    "The T m of LCC was 9.3 °C higher than that of IsPETase.": [("LCC", "", "dTm", 9.3, "low")],
    "The Tm of LCC was 4 °C lower than before.": [("LCC", "", "dTm", -4.0, "low")],
    "PET films showed a melting temperature of 89 °C.": [],
    "Tm ranged from 36.4 to 80.1 °C for LCC.": [],
    "The Tm of LCC and LCC-ICCG were 84.7 and 94.0 °C, respectively.": [("LCC", "", "Tm", 84.7, "medium"), ("LCC-ICCG", "", "Tm", 94.0, "medium")],
    "Introducing S121E and D186H in IsPETase increased the Tm by 8.8 °C.": [("IsPETase", "S121E,D186H", "dTm", 8.8, "low")],
    "The mutation increased the Tm of LCC to 81.1 °C.": [("LCC", "", "Tm", 81.1, "low")],
    "The Tm of Ca PETase M9 was 83.2 °C.": [("CaPETase M9", "", "Tm", 83.2, "high")],
    "Compared to wild-type IsPETase, ThermoPETase has a Tm of 56.6 °C.": [("ThermoPETase", "", "Tm", 56.6, "high")],
    "DuraPETase reached a Tm = 77 °C in the presence of 20 mM Ca2+.": [("DuraPETase", "", "Tm", 77.0, "medium")],
    "A Tm of 300 °C was seen for LCC.": [],
    "A Tm of 62.5 °C was found for the LCC variant F243I.": [("LCC", "F243I", "Tm", 62.5, "high")],
    "The variant had a Tm of 71 °C for PET films.": [],
    "The melting temperature of EmberPETase L181R was 61.21 ℃ in buffer.": [("EmberPETase", "L181R", "Tm", 61.21, "high")],
    "Shift in melting temperature = 25.2 °C for XenMHETase T204Q.": [("XenMHETase", "T204Q", "dTm", 25.2, "low")],
    "HotPETase showed a ΔTm of 3-5 °C.": [("HotPETase", "", "dTm", 4.0, "low")],
    "The Tm of TfCut2 decreased by 2.5 °C.": [("TfCut2", "", "dTm", -2.5, "low")],
    "IsPETase with Ser121Glu has a Tm of 50.1 °C.": [("IsPETase", "S121E", "Tm", 50.1, "high")],
    "IsPETase was unstable, whereas under load the Tm was 45 °C.": [("IsPETase", "", "Tm", 45.0, "low")],
    "LCC has a Tm of about 86 °C.": [("LCC", "", "Tm", 86.0, "low")],
    "The cutinase had a Tm of 60 °C.": [("cutinase", "", "Tm", 60.0, "medium")],
    "LCC had a Tm of 84 °C and a Tm of 88 °C.": [("LCC", "", "Tm", 84.0, "high"), ("", "", "Tm", 88.0, "low")],
    "The glass transition T g of 78 °C and Tm of 90 °C belong to LCC.": [],
    "Tm unknown.": [], "": [],
}


def test_facts_of_sentences():
    for text, want in CASES.items():
        assert [(f.enzyme, f.mutations, f.metric, f.value, f.confidence) for f in facts_in(text)] == want, text
        assert all(q[6] in q[10] for q in quoted(text))


def test_facts_of_pieces(spark):
    from attestry.operators.facts import extract_facts, extraction_stats, table_triage

    table = "Table 1 Tm " + "IsPETase S121E 46.8 °C Tm " * 40
    rows = [
        ("d#2", "d", "The Tm of LCC was 84.7 °C. LCC had a Tm of 84.7 °C."), ("d#10", "d", "The Tm of LCC was 84.7 °C."), ("e#1", "e", "The Tm of LCC was 84.7 °C."), ("e#2", "e", None), ("e#3", "e", ""), ("e#4", "e", "No cue at 50 °C."),
        ("f#1", "f", table), ("d#2", "d", "The Tm of LCC was 84.7 °C. LCC had a Tm of 84.7 °C."),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string").withColumn("value", F.lit("clash"))
    got = extract_facts(df, is_table=classify.is_table_line).orderBy("doc_id").collect()
    assert [(r.chunk_id, r.doc_id, r.value, r.sentence_no) for r in got] == [("d#2", "d", 84.7, 0), ("e#1", "e", 84.7, 0)]
    assert len({r.record_id for r in got}) == 2 and extraction_stats(extract_facts(df, is_table=classify.is_table_line)).first().facts == 2
    assert [(r.chunk_id, r.cues, r.mutations) for r in table_triage(df, classify.is_table_line).collect()] == [("f#1", 41, 1)]
    assert extract_facts(df.limit(0)).count() == 0


def test_timestamps_are_plain(spark):
    from attestry.tables import free_name, with_timestamps

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    assert dict(with_timestamps(df).dtypes) == {"ts": "timestamp"} and free_name(df, "TS") == "TS_1"
