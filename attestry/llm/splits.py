"""Splits that keep related records together (problem 4).

Entities that share a sequence or a source document, also through others, are one component. The
components are placed by grouped iterative stratification: their rows are summed to a vector of labels;
the label with the fewest rows still to place is the next; its components, those with most of its rows
first, go one after the other to the split that still needs that label most (of equals, the split that
needs most rows of all labels). What has been placed is taken from the needs of every label.

Components with equally many rows of the label are interchangeable to that rule, so it is enough to know
how many there are of each number (at most the square root of twice the rows, whatever the components):
the rule is played through on these counts, and each component takes its place by its rank, in an order
by hash, among its equals. No task and no driver holds all components.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.missing import is_missing
from attestry.lineage import cut
from attestry.operators.components import components_by_keys

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Buckets of the two-level rank.
BUCKETS = 256


def sequence_key(sequence: Column) -> Column:
    """Sequence without letter case, white space and closing ``*``; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(sequence), r"[\s ]+", ""), r"\*+$", "")
    return F.when(~is_missing(bare), bare)


def source_key(source: Column) -> Column:
    """Source document without letter case and outer blanks; null for missing and stand-in values."""
    bare = F.lower(F.trim(source))
    return F.when(~is_missing(bare), bare)


def related_enzymes(measured: DataFrame, features: DataFrame) -> DataFrame:
    """(enzyme_id, group_id): group_id is the least enzyme_id of the component.

    Enzymes of either table count; null ids are ignored. Rows are reduced to distinct (enzyme, key)
    before anything is joined, so an enzyme or a source with a third of all rows is one row by then.
    """
    by_source = measured.select("enzyme_id", F.concat(F.lit("d:"), source_key(F.col("source_doc_id"))).alias("key")).distinct()
    by_sequence = features.select("enzyme_id", F.concat(F.lit("s:"), F.sha2(sequence_key(F.col("sequence")), 256)).alias("key")).distinct()
    return components_by_keys(by_source.unionByName(by_sequence), "enzyme_id", "key", "group_id")


def straddling_groups(measured: DataFrame, features: DataFrame) -> DataFrame:
    """(group_id, enzyme_id) of the components whose rows carry more than one non-null cv_split."""
    groups = cut(related_enzymes(measured, features))
    held = measured.where(F.col("cv_split").isNotNull()).select("enzyme_id", "cv_split").distinct()
    bad = held.join(groups, "enzyme_id").groupBy("group_id").agg(F.min("cv_split").alias("lo"), F.max("cv_split").alias("hi")).where("lo < hi").select("group_id")
    return groups.join(bad, "group_id", "left_semi").select("group_id", "enzyme_id")


def quotas(count: int, size: int, need: Sequence[float], total: Sequence[float]) -> list[int]:
    """How many of ``count`` equal components of ``size`` rows each split gets if every one goes to the
    split that then has the largest need (of equals the larger total need, then the first split)."""
    if not count:
        return [0] * len(need)
    # split s has the need need[s] - j * size before its component j: the count largest of these are taken
    def taken(level: float) -> list[int]:
        return [max(0, int((x - level) // size) + 1) if x >= level else 0 for x in need]

    high, low = max(need) + size, min(need) - count * size - 1.0
    while sum(taken(low)) < count:
        low -= count * size + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if sum(taken(middle)) >= count else (low, middle)
    out = taken(high) if sum(taken(high)) < count else [0] * len(need)
    left = [(-(x - k * size), -(t - k * size), i) for i, (x, t, k) in enumerate(zip(need, total, out))]
    heapq.heapify(left)
    for _ in range(count - sum(out)):
        x, t, i = heapq.heappop(left)
        out[i] += 1
        heapq.heappush(left, (x + size, t + size, i))
    return out


def stratified_splits(rows: DataFrame, component: str, label: Column, weight: Column | None = None, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """(component, split): one split per component, all labels near the given proportions.

    ``label`` is any expression of ``rows`` with few values; null is a label of its own. ``weight`` is
    what a row counts for (1 if none). Equal components are told apart by a hash of their id; a null
    component is ignored. An empty table gives an empty result. Per label, what comes to the driver is
    one row per number of rows that a component has of it.
    """
    names = list(proportions)
    share = [proportions[k] / sum(proportions.values()) for k in names]
    counted = rows.where(F.col(component).isNotNull()).select(F.col(component).alias("c"), F.coalesce(label.cast("string"), F.lit("(none)")).alias("label"), (F.lit(1) if weight is None else weight).cast("long").alias("n"))
    cells = counted.groupBy("c", "label").agg(F.sum("n").alias("n")).where("n > 0")
    comps = cut(cells.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector")))
    open_rows = {r.label: r.n for r in comps.select(F.explode("vector").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    need = {k: [s * n for s in share] for k, n in open_rows.items()}
    spark, done, placed = rows.sparkSession, [], None
    while open_rows:
        key = min(open_rows, key=lambda k: (open_rows[k], k))  # the rarest outstanding label
        mine = comps.where(F.col("vector")[key].isNotNull() & ~F.arrays_overlap(F.map_keys("vector"), F.array(*map(F.lit, done)).cast("array<string>"))).select("c", F.col("vector")[key].alias("n"), "vector")
        total = [sum(need[k][i] for k in need) for i in range(len(names))]
        plan = []
        for r in sorted(mine.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r.n):
            got = quotas(r.m, r.n, need[key], total)
            need[key] = [x - k * r.n for x, k in zip(need[key], got)]
            total = [x - k * r.n for x, k in zip(total, got)]
            plan.append((r.n, [sum(got[: i + 1]) for i in range(len(got))]))
        quota = spark.createDataFrame(plan, "n long, until array<long>")
        here = cut(_by_rank(mine, quota, key, names))
        # a component may have more rows of other labels, which its split has now got as well
        for r in here.select("split", F.explode("vector").alias("label", "n")).groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
            open_rows[r.label] -= r.n
            if r.label != key:
                need[r.label][names.index(r.split)] -= r.n
        open_rows = {k: n for k, n in open_rows.items() if n > 0 and k != key}
        done.append(key)
        placed = here.select("c", "split") if placed is None else placed.unionByName(here.select("c", "split"))
    if placed is None:
        return comps.select(F.col("c").alias(component), F.lit(None).cast("string").alias("split"))
    return placed.select(F.col("c").alias(component), "split")


def _by_rank(mine: DataFrame, quota: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(c, split, vector): the first of each size by hash go to the first split, and so on. The rank is
    one within a bucket of a size plus the components in the buckets before it."""
    spot = F.xxhash64(F.col("c").cast("string"), F.lit(key))
    rows = mine.withColumns({"h": spot, "b": F.pmod(F.shiftrightunsigned(spot, 8), F.lit(BUCKETS))})
    sizes = rows.groupBy("n", "b").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    first = before.join(quota, "n").select("n", "b", F.coalesce("before", F.lit(0)).alias("before"), "until")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("n", "b").orderBy("h", "c"))).join(first, ["n", "b"])
    at = F.size(F.filter("until", lambda u: u < F.col("before") + F.col("r"))) + 1
    return ranked.select("c", F.element_at(F.array(*map(F.lit, names)), at).alias("split"), "vector")


def split_enzymes(measured: DataFrame, features: DataFrame, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """(enzyme_id, group_id, split) for every enzyme; labels are substrate and activity. An enzyme that
    was never measured counts as one row without a label."""
    groups = cut(related_enzymes(measured, features))
    active = F.when(F.col("is_active").isNull(), F.lit("?")).otherwise(F.col("is_active").cast("string"))
    label = F.concat_ws("|", F.coalesce("substrate", F.lit("?")), active)
    # rows are summed per enzyme before the join, so the control enzyme is a few rows
    cells = measured.where(F.col("enzyme_id").isNotNull()).select("enzyme_id", label.alias("label")).groupBy("enzyme_id", "label").agg(F.count("*").alias("n"))
    per_group = groups.join(cells, "enzyme_id", "left").groupBy("group_id", "label").agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n"))
    chosen = stratified_splits(per_group, "group_id", F.coalesce("label", F.lit("(unmeasured)")), F.col("n"), proportions)
    return groups.join(chosen, "group_id").select("enzyme_id", "group_id", "split")
