"""Operators of the llm subpackage against brute force, exact round trips and small cases."""

import datetime as dt
import itertools
import random
import time
import tracemalloc
import unicodedata

import pytest
from pyspark.sql import functions as F

from attestry.llm import folding, fusion, leaks, markup, matching, pieces, queries, splits, subjects, tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(set(map(tuple, rows))) == len(rows)


# 1 - fusion

STAGING = "doc_id string, source string, doc_type string, doi string, content_hash string, full_text string, abstract string, metadata string, fetched_at timestamp, size int"


def staging(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime(2024, 1, r_day), 0) for *r, r_day in rows], STAGING)


def test_fusion_by_field(spark):
    rows = [
        ("b:1", "b", "article", "10.1/X", None, "short text", "[Abstract missing]", '{"a": 1, "b": null, "c": []}', 1), ("a:1", "a", "preprint", "https://doi.example/10.1/x", None, "PDF only", "an abstract", "not json", 2),
        ("c:1", "zz", "thesis", "doi:10.1/x", None, "a longer text", "an abstrac.", '{"a": 1, "d": "x"}', 3), ("c:1", "zz", "thesis", "doi:10.1/x", None, "a longer text", "an abstrac.", '{"a": 1, "d": "x"}', 9),
        ("p:1", "a", "structure", "10.1/x", None, "the longest text of all", "", None, 1), ("e:1", "a", "dataset", " ", "h", None, None, None, 1), ("e:2", "b", "dataset", None, "h", "", " ", "{}", 1), ("f:1", "a", "article", None, None, "t", "t", None, 1),
    ]
    ranks = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, trust_rank int")
    got = {(r.group_id, r.field_name): r.doc_id for r in fusion.fuse(staging(spark, rows), ranks).collect()}
    assert got == {("a:1", "source"): "a:1", ("a:1", "full_text"): "c:1", ("a:1", "abstract"): "a:1", ("a:1", "metadata"): "c:1", ("e:1", "source"): "e:1"}
    assert fusion.fuse(staging(spark, []), ranks).count() == 0


def test_fusion_ties_by_trust_then_recency_then_id(spark):
    rows = [("x:1", "u", "article", "10.1/q", None, "aaaa", None, None, 5), ("x:2", "v", "article", "10.1/q", None, "bbbb", None, None, 1), ("x:3", "v", "article", "10.1/q", None, "cccc", None, None, 7), ("x:4", "v", "article", "10.1/q", None, "dddd", None, None, 7)]
    ranks = spark.createDataFrame([("v", 1), ("u", 2)], "source string, trust_rank int")
    got = {r.field_name: r.doc_id for r in fusion.fuse(staging(spark, rows), ranks).collect()}
    assert got["full_text"] == "x:3" and got["source"] == "x:3"


def test_survivor_is_the_maximum_of_the_posterior(spark):
    rows = [("x:1", "u", "article", "10.1/q", None, "aaaa", "long abstract", None, 5), ("x:2", "v", "article", "10.1/q", None, "bbb", "abstract", None, 1), ("x:3", "w", "article", "10.1/q", None, "bbb", "abstract", None, 7)]
    ranks = spark.createDataFrame([("v", 1), ("w", 2), ("u", 3)], "source string, trust_rank int")
    got = {r.field_name: r for r in fusion.fuse(staging(spark, rows), ranks).collect()}
    assert got["full_text"].doc_id == "x:1" == got["abstract"].doc_id and got["source"].doc_id == "x:2"
    assert all(r.posterior > 0.99 for r in got.values())


def test_copied_votes_lose_among_equals(spark):
    """Values level in completeness, trust and date: votes decide, and copies of a bad source count little."""
    rnd, rows = random.Random(11), []
    for i in range(150):
        doi, truth = f"10.9/{i}", f"{i:05}-true"
        false = lambda s: f"{i:05}-{s[0]}{rnd.randrange(100):03}"  # noqa: E731, B023
        bad = truth if rnd.random() < 0.3 else false("bad")
        told = {s: truth if rnd.random() < a else false(s) for s, a in (("good", 0.95), ("fair", 0.85), ("third", 0.85))} | dict.fromkeys(("bad", "copy"), bad)
        rows += [(f"{'zyxab'[j]}:{i}", s, "article", doi, None, v, None, None, 1) for j, (s, v) in enumerate(told.items())]
    rows += [(f"a{j}:last", s, "article", "10.9/last", None, v, None, None, 1) for j, (s, v) in enumerate((("bad", "00000-fake"), ("copy", "00000-fake"), ("good", "00000-true")))]
    ranks = spark.createDataFrame([(s, 1) for s in ("good", "fair", "third", "bad", "copy")], "source string, trust_rank int")
    df = staging(spark, rows)
    got = {r.group_id: r for r in fusion.fuse(df, ranks).where("field_name = 'full_text'").collect()}
    last = next(r for g, r in got.items() if g.endswith("last"))
    assert last.doc_id == "a2:last" and last.posterior > 0.5  # one good source against a bad one and its copy
    values = {r[0]: r[5] for r in rows}
    assert sum(values[r.doc_id].endswith("true") for r in got.values()) > 0.9 * len(got)


def test_copying_sources_are_found(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        truth = f"{i}-true"
        for s, accuracy in (("good", 0.95), ("fair", 0.8), ("third", 0.85)):
            rows.append((f"g{i}", "abstract", f"{s}{i}", s, None, 5, hash(truth if rnd.random() < accuracy else f"{i}-{s}-{rnd.random()}")))
        wrong = hash(truth if rnd.random() < 0.4 else f"{i}-bad")
        rows += [(f"g{i}", "abstract", f"{s}{i}", s, None, 5, wrong) for s in ("bad", "copy")]
    df = spark.createDataFrame(rows, "group_id string, field_name string, doc_id string, source string, fetched_at timestamp, size int, hash long")
    m = fusion.estimate_sources(df)
    assert m.dependence["bad", "copy"] > 0.9 and m.dependence["fair", "good"] < 0.1 and m.accuracy["good"] > m.accuracy["bad"]
    assert m.votes(["bad", "copy"]) < 1.5 * m.votes(["bad"])  # the copied vote counts little


# 2 - pieces


def test_pieces_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(30):
        text = "".join(rnd.choice(["word", " ", ". ", "\n", "\n\n", "; ", "x" * rnd.randint(1, 60), "é"]) for _ in range(400)).strip()
        got = pieces.split_text(text, 200, 20, 100)
        assert got == pieces.brute_force(text, 200, 20, 100)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= 200 for a, b in got) and all(x[1] - 25 <= y[0] <= x[1] - 20 and y[0] > x[0] for x, y in itertools.pairwise(got))


def test_every_neighbour_overlaps_by_the_stated_amount(spark):
    rows = queries.p2_pieces(spark, "/root/testdata/sf0.01").collect()
    found = {(r.doc_id, r.section_no, r.piece_no): r for r in rows}
    joins = [(r, found[k[0], k[1], k[2] - 1]) for k, r in found.items() if k[2] > 1]
    assert len(joins) > 40
    for r, before in joins:
        shared = before.end_at - r.start_at
        assert pieces.OVERLAP <= shared <= pieces.STRETCH * pieces.OVERLAP and before.piece[-shared:] == r.piece[:shared] and len(r.piece) <= pieces.LIMIT


def test_pieces_without_boundaries_and_sections(spark):
    long = "a" * 9001
    assert pieces.split_text(long) == [(0, 4000), (3800, 7800), (7600, 9001)]
    text = f"{'b ' * 2100}\n## One\n  {'c' * 4000}  \n## Two\nshort\n### not a section\n## Three\n{'d. ' * 1500}"
    rows = [("x", text), ("x", text), ("y", "## A\nshort"), ("z", None), ("w", "")]
    df = spark.createDataFrame(rows, "doc_id string, full_text string").withColumn("piece", F.lit("clash"))
    assert sorted(map(tuple, pieces.oversized_sections(df).collect())) == [("x", 0), ("x", 3)]
    out = pieces.split_oversized(df).orderBy("section_no", "piece_no").collect()
    assert [r.chunk_id for r in out] == ["x#1", "x#2", "x#5", "x#6"] and all(text[r.start_at : r.end_at] == r.piece for r in out)


# 3 - folding


def test_forms():
    assert folding.visual("ＡＢ１") == "AB1" and folding.visual("Аl​fa\u00a0x\u2007") == "Alfa x" and folding.visual("ﬁne e\u0301") == "fine é"
    assert folding.visual("x²") != folding.visual("x2") and folding.visual("é") != folding.visual("e") and folding.visual("a–b") != folding.visual("a-b") and folding.visual("a‑b") == "a-b"
    assert folding.canonical("Straße Ⅳ") == "strasse iv" and folding.canonical("x²") == "x2"
    for c in map(chr, range(0x20, 0x2FFF)):
        if unicodedata.category(c) != "Cn":
            assert folding.canonical(folding.visual(c)) == folding.canonical(c) == folding.canonical(folding.canonical(c)), hex(ord(c))


def test_same_looking_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    texts = ["alpha 1", "ａlpha 1", "alpha\u200b 1", "alpha 1 ", "Alpha 1", "alpha ¹", "b", "Ь", None, "", " ", "alpha 1"]
    rows = [(f"k{i:03}", rnd.choice(texts)) for i in range(120)] + [("k001", "alpha 1")]
    df = spark.createDataFrame(rows, "k string, v string").withColumn("form", F.lit(1))
    want = {(a, b) for (a, x), (b, y) in itertools.product(rows, rows) if a < b and x and y and x != y and folding.visual(x) and folding.visual(x) == folding.visual(y)}
    assert {(r.key_a, r.key_b) for r in folding.same_looking_pairs(df, "k", "v", "f").collect()} == want
    assert folding.same_looking_pairs(df.limit(0), "k", "v", "f").count() == 0
    classes = folding.form_classes(df, "k", "v", "f").orderBy("records").collect()
    assert len(classes) == 1 and classes[0].looks == 3 and classes[0].spellings == 6


# 4 - splits

MEASURED = "enzyme_id string, source_doc_id string, cv_split int, substrate string, is_active boolean"


def test_straddling_groups(spark):
    m = spark.createDataFrame([("e1", "Z:1 ", 0, "s", True), ("e2", "z:1", 1, "s", None), ("e3", "n/a", 2, "s", True), ("e4", "N/A", 3, "s", True), ("e5", None, None, "s", True), ("e3", "", 2, "s", True), (None, "z:1", 4, "s", True), ("e8", "q", 1, None, None), ("e8", "q", 2, None, None)], MEASURED)
    f = spark.createDataFrame([("e3", "mkv*"), ("e5", "MK V"), ("e6", None), ("e7", ""), ("e2", "AAA")], "enzyme_id string, sequence string")
    assert {tuple(r) for r in splits.straddling_groups(m, f).collect()} == {("e1", "e1"), ("e1", "e2"), ("e8", "e8")}
    out = splits.split_enzymes(m, f).collect()
    assert {r.enzyme_id for r in out} == {"e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8"} and len({r.split for r in out if r.group_id == "e3"}) == 1
    assert splits.straddling_groups(m.limit(0), f.limit(0)).count() == 0 == splits.split_enzymes(m.limit(0), f.limit(0)).count()


def test_quotas_are_those_of_one_by_one():
    rnd = random.Random(12)
    for _ in range(300):
        need, total = [float(rnd.randint(-20, 60)) for _ in range(3)], [float(rnd.randint(-50, 200)) for _ in range(3)]
        count, size = rnd.randint(0, 40), rnd.randint(1, 9)
        got, x, t = [0, 0, 0], list(need), list(total)
        for _ in range(count):
            i = max(range(3), key=lambda i: (x[i], t[i], -i))
            got[i], x[i], t[i] = got[i] + 1, x[i] - size, t[i] - size
        assert splits.quotas(count, size, need, total) == got
    assert sum(splits.quotas(10**9, 3, [2.4e9, 3e8, 3e8], [1.0, 1.0, 1.0])) == 10**9


def placed_one_by_one(vectors, proportions):
    """Iterative stratification over components, one after the other; returns rows per split and label."""
    names, open_, rows = list(proportions), dict(vectors), {}
    labels = {k for v in vectors.values() for k in v}
    need = {k: {s: p * sum(v.get(k, 0) for v in vectors.values()) for s, p in proportions.items()} for k in labels}
    while open_:
        left = {k: n for k in labels if (n := sum(v.get(k, 0) for v in open_.values()))}
        key = min(left, key=lambda k: (left[k], k))
        for c in sorted((c for c, v in open_.items() if v.get(key)), key=lambda c: -open_[c][key]):
            v = open_.pop(c)
            s = max(names, key=lambda s: (need[key][s], sum(need[k][s] for k in labels), -names.index(s)))
            for k, n in v.items():
                need[k][s] -= n
                rows[s, k] = rows.get((s, k), 0) + n
    return rows


def test_splits_meet_proportions_of_mixed_labels(spark):
    rnd = random.Random(7)
    vectors = {}
    for g in range(3000):
        main = rnd.choices(["a", "b", "c"], [60, 30, 10])[0]
        v = {main: 700 if g == 0 else rnd.randint(1, 6)}
        for k, p in (("a", 0.3), ("b", 0.2), ("d", 0.02)):
            if rnd.random() < p:
                v[k] = v.get(k, 0) + rnd.randint(1, 3)
        vectors[f"g{g}"] = v
    df = spark.createDataFrame([(c, k, n) for c, v in vectors.items() for k, n in v.items()], "c string, label string, n long")
    placed = splits.stratified_splits(df, "c", F.col("label"), F.col("n"))
    assert placed.count() == 3000 == placed.select("c").distinct().count()
    mine = {(r.split, r.label): r.n for r in df.join(placed, "c").groupBy("split", "label").agg(F.sum("n").alias("n")).collect()}
    plain = placed_one_by_one(vectors, splits.PROPORTIONS)
    for label in "abcd":
        total = sum(n for (_, k), n in mine.items() if k == label)
        for s, p in splits.PROPORTIONS.items():
            assert abs(mine.get((s, label), 0) / total - p) < 0.02, (s, label)
            assert abs(mine.get((s, label), 0) - plain.get((s, label), 0)) < 0.03 * total, (s, label)
    assert splits.stratified_splits(df.limit(0), "c", F.col("label"), F.col("n")).count() == 0


# 6 - matching


def test_names_and_titles():
    assert matching.entry_surnames("Wexrin É; Østlón, P.") == ["ostlon", "wexrin"] and matching.entry_surnames("A. Mibter, B. Kor") == ["kor", "mibter"]
    assert matching.entry_surnames("Pell G et al.") == ["pell"] and matching.entry_surnames("anon.") == [] == matching.entry_surnames(None) and matching.entry_surnames("Ana Kor and Uma Zul") == ["kor", "zul"]
    assert matching.unit_surnames(["Ana Korberg", "Zul, B.", "Tov C"]) == ["korberg", "tov", "zul"] == matching.unit_surnames(["Korberg A", "Zul B", "Cy Tov"])
    t = matching.title_words
    assert matching.title_agreement(t("Suface charge tuning in Alba..."), t("Surface <b>charge</b> tuning in Alba under load")) == 1.0
    assert matching.title_agreement(t("On surface charge tuning [preprint]"), t("Surface charge tuning")) == 1.0
    assert matching.title_agreement(t("Mining of A1 at 45 C"), t("Mining of A1 at 54 C")) < 0.9
    assert matching.near("istoherms", "isotherms", 1) and not matching.near("143", "436", 1)


def test_matching(spark):
    ref = "ref_id long, ref_title string, ref_authors string, ref_year int, extra string"
    doc = "doc_id string, doc_type string, doi string, content_hash string, title string, authors array<string>, year int, words int"
    refs = [
        (1, "Thermal hardenng of enzymes on film – a tale", "Kor A et al.", 2010, None), (2, "Thermal hardening of enzymes on film", "Zul B", 2010, None), (3, "Thermal hardening of enzymes on film...", None, 2011, None), (4, None, "Kor A", 2010, None),
        (5, "Reply to: Thermal hardening of enzymes on film – a tale", "Vex C", 2012, None), (6, "Quite another thing altogether", "Kor A", 2010, None), (1, "Thermal hardenng of enzymes on film – a tale", "Kor A et al.", 2010, None), (None, "x", "y", 1, None),
    ]
    docs = [
        ("a:1", "article", "10.1/a", "h1", "Thermal hardening of enzymes on film – a tale", ["Ana Kor"], 2010, 1), ("a:2", "preprint", "10.1/A", "h2", "THERMAL HARDENING OF ENZYMES ON FILM – A TALE", [], None, 1),
        ("a:3", "article", None, "h3", "Thermal hardening of enzymes on film – a tale.", ["Kor, A."], None, 1), ("b:1", "article", "10.1/b", "h4", "Surface charge tuning in soil", ["Zul B"], 2010, 1), ("b:1", "article", "10.1/b", "h4", "Surface charge tuning in soil", ["Zul B"], 2010, 1),
        ("s:1", "structure", "10.1/a", "h5", "Crystal form of an enzyme", None, 2010, 1), (None, "article", None, None, None, None, None, 1),
    ]
    r, d = spark.createDataFrame(refs, ref), spark.createDataFrame(docs, doc)
    got = matching.match_references(r, d).collect()
    assert {(x.ref_id, x.doc_id) for x in got} == {(i, f"a:{j}") for i in (1, 3) for j in (1, 2, 3)} and all(matching.CONFIDENCE <= x.confidence <= 1 for x in got)
    assert matching.match_references(r.limit(0), d).count() == 0 == matching.match_references(r, d.limit(0)).count()


def test_beliefs_exclude_each_other(spark):
    edges = spark.createDataFrame([(1, "u", 5.0), (1, "v", 3.0), (2, "u", 5.0), (3, "v", 1.5)], "eid long, unit string, odds double")
    got = {(r.eid, r.unit): r.marginal for r in matching.propagate(edges).collect()}
    assert got[1, "u"] > 0.8 and got[2, "u"] > 0.9 and got[1, "v"] < 0.3 and got[3, "v"] > 0.6


def test_two_entries_compete_for_a_work(spark):
    """Alone each would be a match; together the weaker is none, unless it is as good as the other."""
    edges = spark.createDataFrame([(1, "u", 6.0), (2, "u", 0.9), (3, "v", 0.9), (4, "w", 4.0), (5, "w", 4.0)], "eid long, unit string, odds double")
    got = {(r.eid, r.unit): r.marginal for r in matching.propagate(edges).collect()}
    assert got[1, "u"] > 0.9 and got[2, "u"] < matching.CONFIDENCE < got[3, "v"] and got[4, "w"] == got[5, "w"] > 0.9


def test_marginals_are_exact_on_trees(spark):
    """On a graph without loops the marginals are those of all assignments, weighed one by one."""
    edges = [(1, "u", 1.2), (1, "v", 0.3), (2, "v", 0.8), (2, "w", -0.4), (3, "w", 2.0), (4, "w", 0.1), (5, "x", 0.7)]
    mass, total = dict.fromkeys(edges, 0.0), 0.0
    for bits in itertools.product((0, 1), repeat=len(edges)):
        on = [e for e, b in zip(edges, bits) if b]
        if len({e[0] for e in on}) < len(on):
            continue
        p = 1.0
        for e in on:
            p *= 2.718281828459045 ** e[2]
        for u in {e[1] for e in on}:
            p *= matching.RELISTED ** (sum(e[1] == u for e in on) - 1)
        total += p
        for e in on:
            mass[e] += p
    got = {(r.eid, r.unit): r.marginal for r in matching.propagate(spark.createDataFrame(edges, "eid long, unit string, odds double"), still=1e-9).collect()}
    assert all(abs(got[e[0], e[1]] - mass[e] / total) < 1e-6 for e in edges)


def test_long_titles_meet_by_classes():
    rnd = random.Random(13)
    for _ in range(50):
        words = [f"word{rnd.randrange(10**6)}" for _ in range(rnd.randint(25, 60))]
        other = [w for i, w in enumerate(words) if i not in rnd.sample(range(len(words)), 2)] if rnd.random() < 0.5 else [*words, "added", "twice"]
        assert set(matching.block_keys(words, [], True)) & set(matching.block_keys(other, [], False))
    assert len(matching.block_keys([f"w{i}" for i in range(3000)], [], True)) < 3100


def test_titles_of_a_pattern_meet_by_their_authors(spark):
    """Works whose titles differ in two words are pairs of all with all by their titles; known authors leave each with its own."""
    rnd = random.Random(3)
    names = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 7)) for _ in range(30)]
    titles = [["adsorption", "isotherms", "of", f"enz{i}ase", f"film{i}x"] for i in range(30)]
    entries = [(i, t, [n[1:]], 2010 if i % 2 else None) for i, (t, n) in enumerate(zip(titles, names))] + [(30, titles[0], [], None)]
    units = [(i, t, [n, f"{n}{n}"], 2010) for i, (t, n) in enumerate(zip(titles, names))] + [(30, titles[1], [], 2010), (31, titles[2], [*names[3:10], names[2]], 2010)]
    of = lambda k, rows: spark.createDataFrame(rows, f"{k} long, words array<string>, names array<string>, year int")
    got = {tuple(r) for r in matching.candidates(of("eid", entries), of("uid", units)).collect()}
    # whoever has no authors, or more than are held side by side, still meets all
    assert got == {(i, i) for i in range(30)} | {(30, u) for u in range(32)} | {(e, u) for e in range(30) for u in (30, 31)}


def test_sketches_admit_every_slip():
    rnd = random.Random(5)
    for _ in range(3000):
        a = "".join(rnd.choices("abcdeorsé-", k=rnd.randint(1, 13)))
        b = a
        for _ in range(rnd.randint(1, 2)):
            i, c = rnd.randrange(len(b) + 1), rnd.choice("aezü")
            b = rnd.choice((b[:i] + c + b[i:], b[:i] + b[i + 1 :], b[:i] + c + b[i + 1 :], b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :])) or "a"
        if matching.near(a, b, 2 if min(len(a), len(b)) > 8 else 1):
            x, y = matching.name_sketch(a), matching.name_sketch(b)
            assert x >= 0 <= y and all((x ^ y).bit_count() <= matching.EDIT_BITS * (2 if len(n) > 8 else 1) for n in (a, b)), (a, b)


# 7 - markup

CASES = {
    "plain text, 3 < 4 and A<B or C>D, $ 3 per run and $ 4, * of note * and snake_case_name, [12], ## two": ((), None),
    "<p>One, two &amp; three.<br/>Four</p><ul><li>a</li><li>b</li></ul>": (("html",), "One, two & three.\nFour\n\n• a\n• b"),
    "<h3>Head</h3><table><tr><td>pH</td><td>7</td></tr></table><pre><code>x &lt; 1\n  y</code></pre>": (("html",), "## Head\n\npH\t7\n\n    x < 1\n      y"),
    "&lt;i&gt;Is&lt;/i&gt; so": (("html",), "Is so"),
    "### Head\n- **a** `b`\n- [c](http://x.y)\n\n```python\nz = 1 * 2 * 3\n```": (("markdown",), "## Head\n• a b\n• c\n\n    z = 1 * 2 * 3"),
    "| a | b |\n|---|---|\n| 1 | 2 |": (("markdown",), "a\tb\n1\t2"),
    "== Head ==\n* [[Yield]] and [[x (y)|z]]\n# '''bold''' {{lang|la|vita}}\n[[Category:Q]]": (("wiki",), "## Head\n• Yield and z\n• bold vita"),
    '{| class="w"\n! a !! b\n|-\n| 1 || 2\n|}': (("wiki",), "a\tb\n1\t2"),
    "\\section*{Head}\n\\begin{itemize}\n\\item \\emph{a} at $T_{m}=5$\n\\end{itemize}\\cite{k}": (("latex",), "## Head\n\n• a at ⟦T_{m}=5⟧"),
    "\\begin{verbatim}\n<b> **x**\n\\end{verbatim}": (("latex",), "    <b> **x**"),
    "See $$\\frac{a}{b}$$ and <sub>2</sub>": (("html", "latex"), "See ⟦\\frac{a}{b}⟧ and 2"),
    "## Results\nfine": ((), None), "": ((), None), "   ": ((), None),
}


def test_markup_cases():
    for text, (kinds, out) in CASES.items():
        got, found = markup.clean(text)
        assert found == kinds, text
        assert got == (text if out is None else out), text
        assert "**x**" in text or markup.clean(got) == (got, ()), text


def test_navigation_is_dropped_and_long_text_ends():
    page = "<body><div><a href='x'>Home</a> <a href='y'>Contact us</a> <a href='z'>More, more links</a></div><div><p>" + "A paragraph of real text, with commas, and more. " * 9 + "</p><p>Another one, too.</p></div></body>"
    out, _ = markup.clean(page)
    assert "Home" not in out and "real text" in out and "Another one" in out
    for odd in ("<" * 5000, "[[" * 3000, "{{" * 3000, "*" * 5000, "$" * 3000, "''" * 3000, "_a" * 4000, "\\begin{verbatim}" * 300, "| " * 4000, "`" * 4001):
        markup.clean(odd)


def test_best_container_and_its_siblings_are_kept():
    article = "<p>" + "A paragraph of real text, with commas, and more. " * 9 + "</p><p>Another one, too.</p>"
    page = f"<body><div>Site name</div><div id='w'><h1>Head</h1><div class='ad'>Short ad text, buy now.</div><div>{article}</div><p>A last remark.</p><p>Menu</p><div><p>More of it, as well, in a second block, with commas, and so on.</p></div></div><div>Foot, note.</div></body>"
    out, kinds = markup.clean(page)
    assert kinds == ("html",) and "Short ad" not in out and "Site name" not in out and "Foot" not in out and "Menu" not in out
    assert "## Head" in out and "real text" in out and "Another one" in out and "A last remark." in out and "second block" in out
    # what is dropped is looked at for residue, and text without containers is kept whole
    assert markup.clean(page.replace("buy now.", "buy **now** at $x_{1}=2$."))[1] == ("html", "latex", "markdown")
    assert markup.clean("Results <i>in</i> vitro\n<ul><li>one</li><li>two</li></ul> End") == ("Results in vitro\n\n• one\n• two\n End", ("html",))


def test_any_depth_is_turned():
    assert markup.clean("&" + "amp;" * 30 + "lt;i&" + "amp;" * 9 + "gt;x</i>") == ("x", ("html",))
    assert markup.clean("a " + "{{lang|la|" * 12 + "vita" + "}}" * 12) == ("a vita", ("wiki",))
    assert markup.clean("[[File:a.png|thumb|see [[b|the [[c]] there]]]] x") == ("see the c there x", ("wiki",))
    assert markup.clean("\\emph{" * 20 + "x {y}" + "}" * 20 + " z") == ("x {y} z", ("latex",))
    assert markup.clean("*a **b _c_ d** e*")[0] == "a b c d e" and "$x_{" + "1" * 300 + "}$" not in markup.clean("see $x_{" + "1" * 300 + "}$")[0]
    for odd in ("{{a|" * 20_000 + "}}" * 20_000, "[[a|" * 20_000 + "]]" * 20_000, "\\ab{" * 20_000 + "}" * 20_000, "&" + "amp;" * 50_000 + "lt;", "<div>" * 20_000 + "x" + "</div>" * 20_000):
        began = time.process_time()
        markup.clean(odd)
        assert time.process_time() - began < 15, odd[:10]


def test_long_residue_is_turned():
    long = "long words of it " * 400 + "end"
    for text in (f"**{long}**", f"_{long}_", f"~~{long}~~", f"`{long}`", f"[{long}](http://x.y)", f"![{long}](data:{'A' * 3000})", f"[{long}](<{'a b' * 300}>)", f"[{long}][{'r' * 300}]"):
        assert markup.clean(f"See {text} here") == (f"See {long} here", ("markdown",)), text[:20]
    for text in (f"''{long}''", f"[[{long}]]", f"[[x|{long}]]", "{{lang|la|" + long + "}}"):
        assert markup.clean(f"See {text} here") == (f"See {long} here", ("wiki",)), text[:20]
    for text in (f"$${long}$$", f"\\({long}\\)", f"\\[{long}\\]"):
        assert markup.clean(f"See {text} here") == (f"See ⟦{long}⟧ here", ("latex",)), text[:20]
    assert markup.clean("<?xml " + "a='b' " * 200 + "?>x") == ("x", ("html",))
    out, kinds = markup.clean("{|\n" + "|-\n| cell one || cell two\n" * 3000 + "|}\nAfter")
    assert kinds == ("wiki",) and out == "cell one\tcell two\n" * 3000 + "After"


def test_unclosed_signs_take_linear_time():
    for odd in (" _a", " ''a", "\\( ", "\\[ ", "[](<", "[a](", "**a ", "~~a ", "`a ", "[[a|", "{{a ", "<?xml ", "<pre ", "[a][", "$$ a", "{|\n", "![a](<b "):
        began = time.process_time()
        markup.clean(odd * 40_000)
        assert time.process_time() - began < 10, odd


def test_every_list_and_quote_is_looked_at(spark):
    texts = {"a": " - wash", "b": "-\twash", "c": ">quoted", "d": "x\n\t+ wash", "e": "a - b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert [markup.clean(t)[1] for t in texts.values()] == [("markdown",)] * 4 + [()]
    assert sorted(r.doc_id for r in markup.residue(df, "doc_id", ("text",)).collect()) == ["a", "b", "c", "d"]


def test_clean_fields(spark):
    df = spark.createDataFrame([("a", "x <b>y</b>", None), ("a", "x <b>y</b>", None), ("b", None, ""), ("c", "plain", "**z**")], "doc_id string, title string, abstract string").withColumn("kinds", F.lit(1))
    assert sorted(map(tuple, markup.residue(df, "doc_id", ("title", "abstract")).collect())) == [("a", "title", "html"), ("c", "abstract", "markdown")]
    assert markup.clean_fields(df, "doc_id", ("title", "abstract")).count() == 5


# 8 - tokens


@pytest.fixture(scope="module")
def raw():
    return tokens.read_vocabulary(tokens.default_vocabulary())


def test_encoding_is_that_of_the_public_tokenizer(raw):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rnd = random.Random(8)
    small = tokens.ByteBpe(raw, 64, 8)
    texts = ["a", " ", "\n\n x", "<|endoftext|>", "don't  stop", "é" * 300, "x" * 9001, "=-" * 700, " " * 5000, "漢字かな" * 90, "0123456789" * 80, "🧬👍🏽" * 40]
    texts += ["".join(rnd.choice("abcdefgh éß漢1 \n.") for _ in range(rnd.randint(1, 900))) for _ in range(60)] + ["".join(rnd.choice("acgt") for _ in range(3000))]
    for t in texts:
        want = other.encode(t, add_special_tokens=False).ids
        assert small.encode(t) == want == tokens.ByteBpe(raw).encode(t) if len(t) < 50 else small.encode(t) == want
        assert tokens.decode(want, raw) == t


def test_corpus_ids(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "  "), (1, "hello world")], "doc_id long, text string").withColumn("extra", F.lit(1))
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, []), (4, [220, 220])]
    with pytest.raises(ValueError):
        tokens.encode_corpus(df.withColumnRenamed("doc_id", "ids"), keep=("ids",))


# 9 - leaks


def test_search_equals_brute_force():
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    items = [(i, leaks.squeezed(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))))) for i in range(30)]
    index = leaks.WuManber(items)
    for _ in range(40):
        text = leaks.squeezed(" ".join(rnd.choice(words) for _ in range(120)))
        found = {i for i, runs in index.runs(text).items() if any(n >= leaks.PATTERN_CHARS or n == len(index.items[i]) for _, _, n in runs)}
        want = {i for i, t in items if (t in text if len(t) < leaks.PATTERN_CHARS else any(t[k : k + leaks.PATTERN_CHARS] in text for k in range(0, len(t) - leaks.PATTERN_CHARS + 1, leaks.STRIDE)))}
        assert found == want
        for i, runs in index.runs(text).items():
            assert all(text[a : a + n] == index.items[i][b : b + n] for a, b, n in runs)


PASSAGE = "The court of the northern valley decided that every bottle made before the war should be returned to its owner, although no owner could be found. A second ruling followed in spring and closed the matter for the whole of the province."


def test_leaks(spark):
    words = PASSAGE.split()
    half = " ".join(words[: len(words) // 2 + 1])
    docs = [
        (1, f"Intro. {PASSAGE} Outro."), (2, PASSAGE.upper().replace(" ", "\n ")), (3, f"x {half} y"), (4, " ".join(words[:8])), (5, None), (6, ""), (7, " ".join(("really" if i % 9 == 8 else "") + " " + w for i, w in enumerate(words))),
        (8, f"{' '.join(words[:12])} something quite different stands here for a good while, or so {' '.join(words[24:38])}"), (1, f"Intro. {PASSAGE} Outro."), (9, " ".join(reversed(words))), (10, "Kurz."),
    ]
    items = spark.createDataFrame([(100, PASSAGE, 1), (101, None, 1), (102, "", 1), (103, "kurz", 1), (100, PASSAGE, 1)], "item_id long, text string, share int")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("stretches", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, items).collect()}
    assert got == {(i, 100) for i in (1, 2, 3, 7, 8)} | {(10, 103)}
    assert leaks.leaked_items(df, items.limit(0)).count() == 0 == leaks.leaked_items(df.limit(0), items).count()


def test_index_is_bounded():
    rnd = random.Random(14)
    tracemalloc.start()
    leaks.WuManber([(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))) for i in range(100)])
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size < 300 * 100_000  # bytes a character of random, that is most different, items


def test_more_passes_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    one = {tuple(r) for r in leaks.leaked_items(docs, items).collect()}
    monkeypatch.setattr(leaks, "ITEM_CHARS_PER_PASS", 30_000)
    assert {tuple(r) for r in leaks.leaked_items(docs, items).collect()} == one and one


# 10 - subjects


STABILITY = ["A new disulfide bridge rigidified the loop.", "Proline made the variant heat-tolerant.", "Directed evolution lifted the unfolding point."]
SOIL = ["Earthworms moved microplastic into the soil.", "Biofilms covered drifting debris.", "El suelo guarda microplásticos."]


def test_paragraphs_and_mentions(spark):
    stability, soil = " ".join(STABILITY), " ".join(SOIL[:2])
    docs = [(1, f"{stability}\n\n{soil}"), (2, f"{stability} {SOIL[0]}"), (3, "Nothing of note here."), (4, None), (5, ""), (6, SOIL[0]), (6, soil), (7, f"{STABILITY[1]} {STABILITY[2]}\n\n{SOIL[2]}")]
    docs += [(k + i, " ".join(t[i % 2 :])) for k, t in ((100, STABILITY), (200, SOIL)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"container": F.lit(None).cast("string"), "source": F.lit("s"), "subject": F.lit("clash")})
    names = spark.createDataFrame([(1, "stability_engineering"), (2, "environmental_fate"), (3, None)], "subject_no int, subject string")
    labels = spark.createDataFrame([(100 + i, "stability_engineering") for i in range(6)] + [(200 + i, "environmental_fate") for i in range(6)] + [(None, "environmental_fate"), (1, "no such area")], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(df, labels, names).collect() if r.doc_id < 100}
    assert got == {(1, "stability_engineering"), (1, "environmental_fate"), (2, "stability_engineering"), (6, "environmental_fate"), (7, "stability_engineering"), (7, "environmental_fate")}
    assert subjects.subject_areas(df, labels, names.limit(0)).count() == 0 == subjects.subject_areas(df.limit(0), labels, names).count()
    told = names.withColumn("description", F.when(F.col("subject_no") == 2, "What earthworms and debris do").otherwise("Proteins"))
    assert {(r.doc_id, r.subject) for r in subjects.subject_areas(df, labels.limit(0), told).collect()} >= {(6, "environmental_fate")}


def test_accuracies_are_learned():
    rnd = random.Random(10)
    patterns = {}
    for _ in range(4000):
        t = rnd.randrange(5)
        v = tuple(t if rnd.random() < p else rnd.randrange(5) if rnd.random() < 0.7 else -1 for p in (0.9, 0.8, 0.4, 0.1, 0.1))
        patterns[v] = patterns.get(v, 0) + 1
    right = subjects.Accuracies.learn(patterns, 5).right
    assert right[0] > 0.85 > 0.7 > right[2] > right[3]


def test_held_out_labels(spark):
    """Labels of half of the documents find the areas of the other half; no word is written down anywhere."""
    folder = "/root/testdata/sf0.1"
    labels = {}
    for r in spark.read.parquet(f"{folder}/subject_labels.parquet").collect():
        labels.setdefault(r.doc_id, set()).add(r.subject)
    held = {d for d in labels if d % 2}
    base = spark.read.parquet(f"{folder}/documents.parquet")
    rest = spark.read.parquet(f"{folder}/subject_labels.parquet").where("doc_id % 2 = 0")
    got = {}
    for r in subjects.subject_areas(base, rest, spark.read.parquet(f"{folder}/subjects.parquet")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(len(got.get(d, set()) & labels[d]) for d in held)
    recall, precision = right / sum(len(labels[d]) for d in held), right / sum(len(got.get(d, set())) for d in held)
    print(f"held out: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
