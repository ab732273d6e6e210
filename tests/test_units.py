import itertools
import random

from pyspark.sql import Row

from attestry.operators import units

METRICS = [Row(metric="Km", common_unit="mM"), Row(metric="Tm", common_unit="°C")]
SCHEMA = "record_id string, doc_id string, enzyme string, mutations string, conditions string, metric string, value double, unit string, evidence_span string, extra string"


def facts(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def test_units_from_column_text_and_none(spark):
    rows = [
        ("a", "d", "E", "", "", "K_M", 2.0, "mM", "x"), ("b", "d", "E", "", "", "Michaelis constant", 2010.0, None, "was 2010 µM in buffer"), ("c", "d", "E", "", "", "Km", 2.0, "", "a value of 2.0 in buffer"),
        ("e", "d", "E", "", "", "Tm", 300.0, "K", None), ("f", "d", "E", "", "", "T_m", 80.33, " ", "reached ８０.３３ °F then"), ("g", "d", "E", "", "", "Tm", None, "K", None), ("a", "d", "E", "", "", "K_M", 2.0, "mM", "x"),
    ]
    out = units.to_common_units(facts(spark, rows), spark.createDataFrame(METRICS)).collect()
    got = {r.record_id: r.common_value for r in out}
    assert len(out) == 5 and got["c"] is None and "g" not in got
    assert abs(got["b"] - 2.01) < 1e-9 and abs(got["e"] - 26.85) < 1e-9 and abs(got["f"] - 26.85) < 0.01
    pairs = {tuple(r) for r in units.agreeing_facts(facts(spark, rows), spark.createDataFrame(METRICS)).collect()}
    assert pairs == {("a", "b"), ("e", "f")}


def test_unknown_unit_is_learned_from_links(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(12):
        v = rnd.uniform(0.1, 9)
        rows += [(f"m{i}", f"d{i}", "E", "", "", "Km", v, "mM", None), (f"z{i}", f"d{i}", "E", "", "", "Km", v * 1000 * rnd.uniform(0.999, 1.001), "zots", None)]
        t = rnd.uniform(40, 90)
        rows += [(f"c{i}", f"d{i}", "E", "", "", "Tm", t, "°C", None), (f"q{i}", f"d{i}", "E", "", "", "Tm", t + 273.15, "quell", None)]
    table = {(r.metric_name, r.source_unit): r for r in units.conversions(units.with_units(facts(spark, rows)), spark.createDataFrame(METRICS)).collect()}
    assert abs(table["Km", "zots"].scale - 0.001) < 1e-12 and table["Km", "zots"].how == "snapped"
    assert abs(table["Tm", "quell"].offset + 273.15) < 1e-9 and table["Tm", "quell"].scale == 1.0


def test_estimates_propagate_over_any_number_of_steps(spark):
    """Units that no table knows: a scale alone, a scale with an offset, and a chain of five such steps.
    A third of the links are of other facts."""
    rnd, rows = random.Random(3), []
    chain = ["°C", "u1", "u2", "u3", "u4", "u5"]
    for step in range(5):
        for i in range(60):
            t = rnd.uniform(40, 90)
            read = lambda k, t: (t * 0.8**k) + 3 * k
            other = rnd.uniform(40, 90) if i % 3 == 0 else t
            rows += [(f"a{step}-{i}", f"d{step}-{i}", "E", "", "", "Tm", read(step, t), chain[step], None), (f"b{step}-{i}", f"d{step}-{i}", "E", "", "", "Tm", read(step + 1, other), chain[step + 1], None)]
    for i in range(60):
        v = rnd.uniform(1, 9)
        rows += [(f"m{i}", f"k{i}", "E", "", "", "Km", v, "mM", None), (f"n{i}", f"k{i}", "E", "", "", "Km", v * 0.8, "zots", None)]
    table = {(r.metric_name, r.source_unit): r for r in units.conversions(units.with_units(facts(spark, rows)), spark.createDataFrame(METRICS)).collect()}
    assert abs(table["Km", "zots"].scale - 1.25) < 1e-9 and table["Km", "zots"].how == "estimated"
    for k in range(1, 6):
        got = table["Tm", f"u{k}"]
        assert got.how == "estimated" and abs(got.scale * 0.8**k - 1) < 1e-6 and abs(got.offset + 3 * k / 0.8**k) < 1e-3
    pairs = {tuple(r) for r in units.agreeing_facts(facts(spark, rows), spark.createDataFrame(METRICS)).collect()}
    assert {(f"a4-{i}", f"b4-{i}") for i in range(60) if i % 3} <= pairs and {(f"m{i}", f"n{i}") for i in range(60)} <= pairs


def test_a_name_is_overruled_by_many_links_only(spark):
    many, few = ([(f"{p}{i}{u}", f"{p}{i}", "E", "", "", m, v, u, None) for i in range(n) for u, v in (("mM", 1.0 + i), ("μM", 1.0 + i))] for p, n, m in (("x", 40, "Km"), ("y", 5, "product release")))
    metrics = spark.createDataFrame([*METRICS, Row(metric="product_release", common_unit="mM")])
    table = {(r.metric_name, r.source_unit): r for r in units.conversions(units.with_units(facts(spark, [*many, *few])), metrics).collect()}
    assert table["Km", "μM"].scale == 1.0 and table["product_release", "μM"].scale == 1e-3 and table["product_release", "μM"].how == "name"


def test_band_join_equals_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(f"r{i:03}", f"d{i % 3}", None if i % 4 == 0 else "E", "", "", "Km", float(round(rnd.choice([1, 1.004, 1.0101, 0, -2, -2.01, 5e-7]) * rnd.choice([1, 1.0005]), 8)), "mM", None) for i in range(120)]
    got = {tuple(r) for r in units.agreeing_facts(facts(spark, rows), spark.createDataFrame(METRICS)).collect()}
    want = {
        (a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2)
        if a[1:3] == b[1:3] and abs(a[6] - b[6]) <= 0.01 * max(abs(a[6]), abs(b[6]))
    }
    assert got == want


def test_empty_table(spark):
    assert units.agreeing_facts(facts(spark, []), spark.createDataFrame(METRICS)).count() == 0


def test_every_known_conversion_round_trips():
    for metric, groups in units.KNOWN.items():
        for names, scale, offset in groups:
            assert scale > 0 and all(units.unit_spelling(n) in units._spellings(metric) for n in names)
            assert units.unit_in_text(metric, 3.5, f"a value of 3.5 {names[0]} was seen") == units.unit_spelling(names[0])
