"""Quantities recorded in different units, brought to the common unit of their metric (problem 5).

A *source* is a unit as it is written for a metric. The same entity recorded under two sources links
them; over all links the scale and offset of each pair of sources are estimated robustly (repeated median
of slopes, then median of intercepts) and snapped to a known conversion where that meets the links as well.
From the common unit, estimates and snapped conversions alike are propagated through the graph of
sources, over any number of steps, along the paths whose weakest pair has most links. A source that no
link reaches is converted by the meaning of its name; a name that the graph contradicts is overruled if
many links agree.

Entities of any size cost one number per source: links are made between sources of an entity, never
between its records.
"""

from __future__ import annotations

import itertools
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.folding import fold_signs
from attestry.functions.missing import is_missing
from attestry.lineage import cut

#: Names under which the metrics are recorded (fixed values), without case, blanks and signs.
METRIC_NAMES = {
    "tm": "Tm", "meltingtemperature": "Tm", "dtm": "dTm", "δtm": "dTm", "deltatm": "dTm", "shiftinmeltingtemperature": "dTm",
    "halflife": "half_life", "t12": "half_life", "activity": "activity", "specificactivity": "activity",
    "kcat": "kcat", "turnovernumber": "kcat", "km": "Km", "michaelisconstant": "Km",
    "productrelease": "product_release", "tpareleased": "product_release", "conversion": "conversion",
    "depolymerisationdegree": "conversion", "degreeofdepolymerisation": "conversion", "enzymeloading": "enzyme_loading",
    "enzymedose": "enzyme_loading", "loading": "enzyme_loading",
}

#: Known conversions to the common unit of a metric: unit names, scale, offset (fixed values).
_TIME = ((("h", "hr", "hrs", "hour", "hours"), 1.0), (("min", "mins", "minute", "minutes"), 1 / 60), (("s", "sec", "secs", "second", "seconds"), 1 / 3600), (("10^3 s", "ks"), 1 / 3.6), (("d", "day", "days"), 24.0), (("ms",), 1 / 3.6e6))
_MOLAR = (
    (("mM", "mmol/L", "mmol/l", "mmol l-1", "x10^-3 M", "10^-3 M", "mol/m3", "mol m-3"), 1.0),
    (("μM", "uM", "umol/L", "umol/l", "μmol/L", "μmol/l", "μmol l-1", "umol l-1", "x10^-6 M"), 1e-3),
    (("nM", "nmol/L", "nmol/l"), 1e-6), (("M", "mol/L", "mol/l", "mol l-1"), 1e3),
)
KNOWN: dict[str, tuple[tuple[tuple[str, ...], float, float], ...]] = {
    "Tm": ((("°C", "C", "degC", "deg C", "deg. C", "celsius"), 1.0, 0.0), (("K", "kelvin"), 1.0, -273.15), (("°F", "F", "degF", "deg. F", "fahrenheit"), 5 / 9, -160 / 9)),
    "dTm": ((("°C", "C", "degC", "deg. C", "K", "kelvin", "celsius"), 1.0, 0.0), (("°F", "F", "degF", "deg. F"), 5 / 9, 0.0), (("mK", "m°C"), 1e-3, 0.0)),
    "half_life": tuple((n, s, 0.0) for n, s in _TIME),
    "activity": (
        (("U/mg", "U mg-1", "μmol/min/mg", "umol/min/mg", "μmol min-1 mg-1", "kU/g"), 1.0, 0.0),
        (("U/g", "mU/mg", "nmol/min/mg"), 1e-3, 0.0), (("nkat/mg", "mkat/kg", "μkat/g"), 0.06, 0.0), (("kat/kg",), 60.0, 0.0),
    ),
    "kcat": ((("1/s", "s-1", "s^-1", "/s", "per second"), 1.0, 0.0), (("1/min", "min-1", "min^-1", "per minute"), 1 / 60, 0.0), (("1/h", "h-1", "h^-1", "per hour"), 1 / 3600, 0.0)),
    "Km": tuple((n, s, 0.0) for n, s in _MOLAR),
    "product_release": tuple((n, s, 0.0) for n, s in _MOLAR),
    "conversion": ((("%", "pct", "percent", "per cent"), 1.0, 0.0), (("fraction", "mol/mol", "ratio"), 100.0, 0.0), (("‰", "permille", "per mille"), 0.1, 0.0), (("ppm",), 1e-4, 0.0)),
    "enzyme_loading": ((("mg/g", "g/kg", "kg/t", "μg/mg", "ug/mg", "mg g-1"), 1.0, 0.0), (("μg/g", "ug/g", "mg/kg"), 1e-3, 0.0), (("wt%", "wt.%", "% w/w"), 10.0, 0.0)),
}

#: Least links of a pair of sources, share of them that a conversion must meet within TOLERANCE, and
#: links that an estimate needs to overrule a known name.
LEAST_LINKS, LEAST_SHARE, TOLERANCE, OVERRULE = 3, 0.5, 0.01, 30
#: An estimate is snapped to a known conversion that meets this share of the links that it meets itself.
AS_WELL = 0.9
#: Links that are compared with each other while slopes are made.
BLOCK = 64


def metric_name(metric: Column) -> Column:
    """The metric's own name, however it is recorded; other names come out trimmed, null stays null."""
    bare = F.regexp_replace(F.lower(metric), r"[^a-z0-9δ]", "")
    names = F.create_map(*[F.lit(x) for p in METRIC_NAMES.items() for x in p])
    return F.coalesce(F.try_element_at(names, F.regexp_replace(bare, "∆", "δ")), F.trim(metric))


def unit_spelling(unit: str) -> str:
    """A unit with plain signs: NFKC, superscripts as digits, one kind of micro sign, single blanks."""
    return fold_signs(unit.replace("⁻", "-").replace("℃", "°C"))


def _spellings(metric: str) -> dict[str, tuple[float, float]]:
    return {unit_spelling(n): (s, o) for names, s, o in KNOWN.get(metric, ()) for n in names}


_NUMBER = re.compile(r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_UNIT_AFTER: dict[str, re.Pattern] = {}


def unit_in_text(metric: str, value: float, text: str | None) -> str | None:
    """The unit that follows the value in a text; None where there is none.

    The number that equals the value decides. If the text spells no such number, the number of the text
    that has a unit of the metric and is nearest to the value does, if it is within a factor of two.
    """
    if not text or value is None or math.isnan(value):
        return None
    if metric not in _UNIT_AFTER:
        names = sorted(_spellings(metric), key=len, reverse=True)
        _UNIT_AFTER[metric] = re.compile(r"\s*(" + "|".join(map(re.escape, names)) + r")(?![\w/^%°])") if names else re.compile(r"(?!)")
    plain = unit_spelling(text)
    near: tuple[float, str] | None = None
    equal = False
    for m in _NUMBER.finditer(plain):
        x = float(m[0])
        after = _UNIT_AFTER[metric].match(plain, m.end())
        if abs(x - value) <= 1e-9 * max(abs(value), 1e-300):
            equal = True
            if after:
                return after[1]
        elif after:
            apart = abs(math.log(x / value)) if x > 0 and value > 0 else math.inf
            if apart < math.log(2) and (near is None or apart < near[0]):
                near = (apart, after[1])
    return None if equal or near is None else near[1]


@F.pandas_udf(T.StringType())
def _spelled(units: pd.Series) -> pd.Series:
    table = {u: unit_spelling(u) for u in units.dropna().unique()}
    return units.map(lambda u: table.get(u), na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def _found_in_text(metric: pd.Series, value: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([unit_in_text(m, v, t) if m is not None else None for m, v, t in zip(metric, value, text)], dtype=object)


ENTITY = ("doc_id", "enzyme", "mutations", "conditions")
#: 128 bits that stand for an entity in shuffles and joins.
KEY = ("e1", "e2")


def with_units(facts: DataFrame) -> DataFrame:
    """One row per record: record_id, the entity and its key, metric_name, value, source_unit.

    ``source_unit`` is the unit as written, with plain signs, or the one in ``evidence_span`` where the
    column has none; null if there is none. Records without value (null, NaN) are left out; an exact
    repetition counts once. Null parts of an entity are equal to each other.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ENTITY]
    key = [F.xxhash64(*parts).alias("e1"), F.xxhash64(F.lit(7), *parts).alias("e2")]
    base = facts.where(F.col("record_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select(
        "record_id", *ENTITY, *key, metric_name(F.col("metric")).alias("metric_name"), "value", F.when(~is_missing(F.col("unit")), F.col("unit")).alias("unit"), "evidence_span",
    )
    told = base.where(F.col("unit").isNotNull()).withColumn("source_unit", _spelled("unit"))
    silent = base.where(F.col("unit").isNull()).withColumn("source_unit", _found_in_text("metric_name", "value", "evidence_span"))
    both = told.unionByName(silent).drop("unit", "evidence_span")
    one = both.groupBy("record_id", *KEY, "metric_name", "value").agg(F.max("source_unit").alias("source_unit"), F.max(F.struct(*ENTITY)).alias("_e"))
    return one.select("record_id", *[F.col(f"_e.{c}").alias(c) for c in ENTITY], *KEY, "metric_name", "value", "source_unit")


def _known_table(df: DataFrame) -> DataFrame:
    rows = [(m, u, s, o) for m in KNOWN for u, (s, o) in _spellings(m).items()]
    return df.sparkSession.createDataFrame(rows, "metric_name string, source_unit string, known_scale double, known_offset double")


def _known_maps(df: DataFrame) -> DataFrame:
    """(metric_name, maps): every conversion between two known units of a metric, as (scale, offset)."""
    rows = []
    for m, units in KNOWN.items():
        forms = {(s, o) for _, s, o in units}
        maps = {(float(f"{a[0] / b[0]:.12g}"), float(f"{(a[1] - b[1]) / b[0]:.12g}")) for a, b in itertools.product(forms, forms)}
        rows.append((m, sorted(maps)))
    return df.sparkSession.createDataFrame(rows, "metric_name string, maps array<struct<scale:double,offset:double>>")


PAIR = ("metric_name", "source_unit", "other_unit")


def _links(records: DataFrame) -> DataFrame:
    """(metric_name, source_unit, other_unit, x, y, h): an entity's value under each two of its sources.
    Where its records under a source disagree, it is not known which fact the other source has, so such an
    entity links nothing there."""
    cells = records.where(F.col("source_unit").isNotNull()).groupBy(*KEY, "metric_name", "source_unit").agg(F.min("value").alias("value"), F.max("value").alias("top")).where("value = top")
    # sources of an entity are as few as the spellings of its unit
    entities = cells.groupBy(*KEY, "metric_name").agg(F.collect_list(F.struct("source_unit", "value")).alias("v")).where(F.size("v") > 1)
    both = F.filter(F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: F.struct(a["source_unit"].alias("source_unit"), b["source_unit"].alias("other_unit"), a["value"].alias("x"), b["value"].alias("y"))))), lambda p: p["source_unit"] != p["other_unit"])
    return entities.select("metric_name", F.col("e2").alias("h"), F.inline(both))


def _met(scale: Column, offset: Column) -> Column:
    return F.abs(F.col("y") - (scale * F.col("x") + offset)) <= TOLERANCE * F.greatest(F.abs("y"), F.lit(1e-12))


def source_graph(records: DataFrame) -> DataFrame:
    """(metric_name, source_unit, other_unit, scale, offset, links, agree, snapped): how a value in one
    source is read in another, for each pair of sources with LEAST_LINKS links or more.

    Two estimates are made: the median ratio, and the repeated median of slopes with the median of the
    intercepts that it leaves. A link's slope is the median of those to the other links of its block, of
    some BLOCK links by hash; the slope is the median over all links, so up to half of them may be wrong,
    every link counts and none is compared with all. The estimate that meets more links within TOLERANCE
    stands (of equals the ratio); the known conversion of the metric that meets most takes its place if it
    meets as many, but for AS_WELL.
    ``agree`` is how many links it meets; a pair of which less than LEAST_SHARE agree is no conversion.
    """
    links = cut(_links(records))
    counts = links.groupBy(*PAIR).agg(F.count("*").alias("links"), F.percentile_approx(F.when(F.col("x") != 0, F.col("y") / F.col("x")), 0.5, 10_000).alias("ratio")).where(F.col("links") >= LEAST_LINKS)
    block = F.pmod("h", F.ceil(F.col("links") / BLOCK)).alias("b")
    blocks = links.join(counts, list(PAIR)).select(*PAIR, block, F.struct("x", "y").alias("p")).groupBy(*PAIR, "b").agg(F.collect_list("p").alias("p"))
    to_others = lambda a: F.array_sort(F.filter(F.transform("p", lambda b: F.when(a["x"] != b["x"], (b["y"] - a["y"]) / (b["x"] - a["x"]))), lambda m: m.isNotNull()))
    medians = F.transform(F.transform("p", to_others), lambda m: F.try_element_at(m, (F.floor(F.size(m) / 2) + 1).cast("int")))
    slopes = blocks.where(F.size("p") > 1).select(*PAIR, F.explode(medians).alias("slope")).groupBy(*PAIR).agg(F.percentile_approx("slope", 0.5, 10_000).alias("slope"))
    lines = links.join(slopes.where("slope > 0"), list(PAIR))
    affine = lines.groupBy(*PAIR, "slope").agg(F.percentile_approx(F.col("y") - F.col("slope") * F.col("x"), 0.5, 10_000).alias("intercept"))
    known = _known_maps(records).select("metric_name", F.explode("maps").alias("m")).select("metric_name", "m.scale", "m.offset", F.lit(2).alias("kind"))
    pairs = counts.select(*PAIR)
    tried = (
        counts.where("ratio > 0").select(*PAIR, F.col("ratio").alias("scale"), F.lit(0.0).alias("offset"), F.lit(1).alias("kind"))
        .unionByName(affine.select(*PAIR, F.col("slope").alias("scale"), F.col("intercept").alias("offset"), F.lit(0).alias("kind"))).unionByName(pairs.join(known, "metric_name").select(*PAIR, "scale", "offset", "kind"))
    )
    options = tried.groupBy(*PAIR).agg(F.collect_list(F.struct("scale", "offset", "kind")).alias("options"))  # as few as the known units
    met = links.join(options, list(PAIR)).select(*PAIR, "x", "y", F.explode("options").alias("o")).groupBy(*PAIR, "o").agg(F.count_if(_met(F.col("o.scale"), F.col("o.offset"))).alias("agree"))
    best = met.groupBy(*PAIR).agg(
        F.max(F.when(F.col("o.kind") < 2, F.struct("agree", F.col("o.kind").alias("kind"), F.col("o.scale").alias("scale"), F.col("o.offset").alias("offset")))).alias("fit"),
        F.max(F.when(F.col("o.kind") == 2, F.struct("agree", (-F.abs("o.offset")).alias("near"), F.col("o.scale").alias("scale"), F.col("o.offset").alias("offset")))).alias("known"),
    )
    snap = F.col("known").isNotNull() & (F.col("fit").isNull() | (F.col("known.agree") >= AS_WELL * F.col("fit.agree")))
    pick = lambda c: F.when(F.col("snapped"), F.col(f"known.{c}")).otherwise(F.col(f"fit.{c}")).alias(c)
    rows = best.join(counts.select(*PAIR, "links"), list(PAIR)).withColumn("snapped", snap).select(*PAIR, pick("scale"), pick("offset"), "links", pick("agree"), "snapped")
    return rows.where(F.col("agree") >= F.greatest(F.lit(LEAST_LINKS), LEAST_SHARE * F.col("links")))


def conversions(records: DataFrame, metric_units: DataFrame) -> DataFrame:
    """(metric_name, source_unit, scale, offset, how): reading of each source in the metric's common unit.

    ``how`` is ``common``, ``snapped`` (a path of links, all of them snapped to known conversions),
    ``estimated`` (a path with an estimate that no known conversion meets), ``name`` (no link reaches it,
    or fewer than OVERRULE links contradict the name) or null.
    """
    graph = cut(source_graph(records))
    common = metric_units.where(F.col("metric").isNotNull() & F.col("common_unit").isNotNull()).select(metric_name(F.col("metric")).alias("metric_name"), _spelled("common_unit").alias("source_unit")).distinct()
    start = [F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit(2**31).cast("long").alias("agree"), F.lit(True).alias("snapped")]
    reached, new = None, cut(common.select("metric_name", "source_unit", *start, F.lit(0).alias("hops")))
    known, hop = _known_table(records), 0
    while True:
        reached = new if reached is None else reached.unionByName(new)
        hop += 1
        # of all pairs that lead out of what is reached, the strongest; it can only be as strong as its path
        to = reached.select("metric_name", F.col("source_unit").alias("other_unit"), F.col("scale").alias("s2"), F.col("offset").alias("o2"), F.col("agree").alias("a2"), F.col("snapped").alias("n2"))
        step = graph.join(to, ["metric_name", "other_unit"]).select("metric_name", "source_unit", (F.col("scale") * F.col("s2")).alias("scale"), (F.col("offset") * F.col("s2") + F.col("o2")).alias("offset"), F.least("agree", "a2").alias("agree"), (F.col("snapped") & F.col("n2")).alias("snapped"))
        best = step.join(reached.select("metric_name", "source_unit"), ["metric_name", "source_unit"], "left_anti").groupBy("metric_name", "source_unit").agg(F.max(F.struct("agree", "snapped", "scale", "offset")).alias("w"))
        new = cut(best.select("metric_name", "source_unit", "w.scale", "w.offset", "w.agree", "w.snapped", F.lit(hop).alias("hops")))
        if not new.limit(1).count():
            break
    sources = records.where(F.col("source_unit").isNotNull()).select("metric_name", "source_unit").distinct()
    joined = sources.join(reached, ["metric_name", "source_unit"], "left").join(known, ["metric_name", "source_unit"], "left")
    same = (F.abs(F.col("scale") / F.col("known_scale") - 1) < 1e-3) & (F.abs(F.col("offset") - F.col("known_offset")) < 0.05)
    by_name = F.col("known_scale").isNotNull() & (F.col("scale").isNull() | (~same & (F.col("agree") < OVERRULE)))
    return joined.select(
        "metric_name", "source_unit", F.when(by_name, F.col("known_scale")).otherwise(F.col("scale")).alias("scale"), F.when(by_name, F.col("known_offset")).otherwise(F.col("offset")).alias("offset"),
        F.when(F.col("hops") == 0, "common").when(by_name, "name").when(F.col("snapped"), "snapped").when(F.col("scale").isNotNull(), "estimated").alias("how"),
    )


def to_common_units(facts: DataFrame, metric_units: DataFrame) -> DataFrame:
    """(record_id, doc_id, enzyme, mutations, conditions, metric_name, source_unit, common_value, how).

    Every record with a value comes out; ``common_value`` is null where there is no unit, neither in its
    column nor in the text, or where nothing tells how to convert it. A record_id with two different
    values keeps both. Extra columns are not read; an empty table gives an empty result.
    """
    return _converted(cut(with_units(facts)), metric_units).select("record_id", *ENTITY, "metric_name", "source_unit", "common_value", "how")


def _converted(records: DataFrame, metric_units: DataFrame) -> DataFrame:
    table = conversions(records, metric_units)
    return records.join(table, ["metric_name", "source_unit"], "left").withColumn("common_value", F.col("value") * F.col("scale") + F.col("offset"))


def agreeing_facts(facts: DataFrame, metric_units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """:func:`agreeing_pairs` of all facts in common units; names of entities are not carried along."""
    return agreeing_pairs(_converted(cut(with_units(facts).drop(*ENTITY)), metric_units), tolerance)


def agreeing_pairs(values: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(record_id_a, record_id_b): records of one entity and metric whose common values agree.

    A band join: values fall in bands as wide as the tolerance on a logarithmic scale, and each meets
    its own band and the two beside it, so an entity with many records is no all-pairs join. Null parts
    of an entity are equal to each other. Repeated records count once.
    """
    width = -math.log1p(-tolerance) * 1.001
    band = F.when(F.col("common_value") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("common_value")) / width)).cast("long")
    # entity, metric, sign and band as 128 bits: one narrow row per record is all that is shuffled
    place = lambda b: [F.xxhash64(*KEY, "metric_name", "sign", b).alias("k1"), F.xxhash64(F.lit(7), *KEY, "metric_name", "sign", b).alias("k2")]
    rows = values.where(F.col("common_value").isNotNull()).select("record_id", *KEY, "metric_name", F.col("common_value").alias("v"), F.signum("common_value").alias("sign"), band.alias("band"))
    a = rows.select(F.col("record_id").alias("record_id_a"), F.col("v").alias("v_a"), *place(F.col("band")))
    b = rows.withColumn("at", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).select(F.col("record_id").alias("record_id_b"), F.col("v").alias("v_b"), *place(F.col("at")))
    close = F.abs(F.col("v_a") - F.col("v_b")) <= tolerance * F.greatest(F.abs("v_a"), F.abs("v_b"))
    return a.join(b, ["k1", "k2"]).where((F.col("record_id_a") < F.col("record_id_b")) & close).select("record_id_a", "record_id_b").distinct()
