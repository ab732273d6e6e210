"""Best representative of each duplicate group, field by field (problem 1).

Bayesian fusion with copy detection. Sources claim values of items (group and field). From shared
values the accuracy of each source and the dependence of each pair of sources are estimated: two
sources that share *false* values are likely to copy, and a copied vote counts only by the share that
is its own. The posterior of a value is proportional to ``exp(votes + prior)``. The prior says that a
value loses ``K`` nats at the first of three levels at which it falls behind the best value of its item:
3 K if it is less complete (texts here are cut short, never lengthened), 2 K if its best claim is less
trusted, K if that is older. ``K`` exceeds any difference of votes, so the value of maximum posterior is
never one that falls behind, and among values that are level in all three the discounted votes decide.

Groups can be of any size: an item is reduced to how many of its values each *set of sources* claims
(at most ``2 ** sources`` numbers, whatever the rows), and equal items are estimated once, with their
count. Texts are never shuffled, only their lengths and hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.keys import UNGROUPED, doi_key, kind_key
from attestry.functions.missing import is_missing, is_standin
from attestry.lineage import cut

FIELDS = ("source", "full_text", "abstract", "metadata")
#: Sources that the table of ranks does not list are one source to the model, which bounds their number.
UNLISTED = "(unlisted)"


@dataclass(frozen=True)
class SourceModel:
    """Accuracies and dependences; all of them numbers per source or pair of sources."""

    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float] = field(default_factory=dict)
    false_values: int = 10
    copy_rate: float = 0.8

    def votes(self, sources: Iterable[str]) -> float:
        """Log-odds that a value claimed by these sources is true, with copied votes discounted."""
        total = 0.0
        seen: list[str] = []
        for s in sorted(sources, key=lambda x: (-self.accuracy.get(x, 0.5), x)):
            own = 1.0
            for t in seen:
                own *= 1 - self.copy_rate * self.dependence.get((min(s, t), max(s, t)), 0.0)
            a = min(max(self.accuracy.get(s, 0.5), 0.01), 0.99)
            total += own * math.log(self.false_values * a / (1 - a))
            seen.append(s)
        return total

    def most(self) -> float:
        """More than any two values' votes can differ."""
        each = (min(max(a, 0.01), 0.99) for a in self.accuracy.values())
        return 1 + sum(abs(math.log(self.false_values * a / (1 - a))) for a in each)


def filled_keys(metadata: Column) -> Column:
    """Filled keys of a valid JSON object; null if it is none. Null, blank, n/a and [] are not filled."""
    ok = F.try_parse_json(metadata).isNotNull() & F.ltrim(metadata).startswith("{")
    values = F.map_values(F.from_json(metadata, "map<string,string>"))
    # an empty list inside a list field comes back as its JSON text
    filled = F.filter(values, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "n/a", "[]"))
    return F.when(ok, F.coalesce(F.size(filled), F.lit(0)))


def group_members(staging: DataFrame) -> DataFrame:
    """(group_id, doc_id, source, fetched_at, and per field f: f_size, f_hash) of the duplicate groups.

    One row per doc_id of every group of two or more; a doc_id held in several rows counts once, with
    its latest ``fetched_at``. ``f_size`` is null where the doc_id has no genuine value.
    """
    kind = kind_key(F.col("doc_type"))
    doi = doi_key(F.col("doi"))
    key = F.when(doi.isNotNull(), F.concat(kind, F.lit("|d|"), doi)).when(~is_missing(F.col("content_hash")), F.concat(kind, F.lit("|h|"), F.col("content_hash")))
    sizes = {
        "source": F.when(~is_missing(F.col("source")), F.lit(1)),
        "full_text": F.when(~is_standin(F.col("full_text")), F.length("full_text")),
        "abstract": F.when(~is_standin(F.col("abstract")), F.length("abstract")),
        "metadata": F.when(filled_keys(F.col("metadata")) > 0, filled_keys(F.col("metadata"))),
    }
    rows = staging.where(F.col("doc_id").isNotNull() & ~kind.isin(*UNGROUPED)).select(
        "doc_id", key.alias("gk"), F.lower(F.trim("source")).alias("source"), "fetched_at",
        *[F.struct(c.alias("size"), F.when(c.isNotNull(), F.xxhash64(F.col(f))).alias("hash")).alias(f"f_{f}") for f, c in sizes.items()],
    ).where(F.col("gk").isNotNull())
    # A doc_id that was fetched again has the same content, so the largest struct is its value.
    docs = rows.groupBy("doc_id").agg(
        F.min("gk").alias("gk"), F.min("source").alias("source"), F.max("fetched_at").alias("fetched_at"),
        *[F.max(f"f_{f}").alias(f"f_{f}") for f in FIELDS],
    )
    groups = docs.groupBy("gk").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(groups.select("gk", "group_id"), "gk").drop("gk")


def claims(members: DataFrame) -> DataFrame:
    """One row per group, field and doc_id with a value: group_id, field_name, doc_id, source, fetched_at, size, hash."""
    stacked = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f_{f}.size").alias("size"), F.col(f"f_{f}.hash").alias("hash")) for f in FIELDS])
    return members.select("group_id", "doc_id", "source", "fetched_at", F.explode(stacked).alias("c")).select("group_id", "doc_id", "source", "fetched_at", "c.*").where(F.col("size").isNotNull())


def estimate_sources(rows: DataFrame, rounds: int = 5, prior_accuracy: float = 0.8, false_values: int = 10, copy_rate: float = 0.8) -> SourceModel:
    """Accuracies and dependences of the sources of ``rows`` (as from :func:`claims`; the field
    ``source`` itself is no evidence and is left out).

    What comes to the driver is one row per pair of sources that claim values of one item, a round.
    """
    told = rows.where((F.col("field_name") != "source") & F.col("source").isNotNull())
    values = told.groupBy("group_id", "field_name", "hash").agg(F.array_sort(F.collect_set("source")).alias("who"))
    items = values.groupBy("group_id", "field_name", "who").agg(F.count("*").alias("c"))
    patterns = items.groupBy("group_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("who", "c"))).alias("sets"))
    patterns = cut(patterns.groupBy("sets").agg(F.count("*").alias("items")))
    names = [r[0] for r in patterns.select(F.explode("sets.who").alias("w")).select(F.explode("w")).distinct().collect()]
    model = SourceModel(dict.fromkeys(names, prior_accuracy), {}, false_values, copy_rate)
    schema = T.StructType([T.StructField(c, t) for c, t in (("a", T.StringType()), ("b", T.StringType()), ("n", T.DoubleType()), ("true_w", T.DoubleType()), ("both_true", T.DoubleType()), ("both_false", T.DoubleType()), ("differ", T.DoubleType()))])
    for _ in range(rounds if names else 0):
        got = patterns.mapInPandas(_pair_counts(model), schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in schema.names[2:]]).collect()
        accuracy = {r.a: (r.true_w + 2 * prior_accuracy) / (r.n + 2) for r in got if r.a == r.b and r.n}
        dependence = {(r.a, r.b): _dependence(r, model) for r in got if r.a < r.b}
        done = max((abs(accuracy[s] - model.accuracy[s]) for s in accuracy), default=0) < 1e-3
        model = SourceModel(model.accuracy | accuracy, dependence, false_values, copy_rate)
        if done:
            break
    return model


def _pair_counts(model: SourceModel):
    """Per pattern: expected true claims of each source (a = b) and shared true, shared false and
    differing claims of each pair, weighted by the pattern's items."""

    def run(batches):
        for pdf in batches:
            out: dict[tuple[str, str], list[float]] = {}
            for sets, items in zip(pdf["sets"], pdf["items"]):
                sets = [(list(s["who"]), int(s["c"])) for s in sets]
                score = [model.votes(w) for w, _ in sets]
                top = max([*score, 0.0])
                total = sum(c * math.exp(x - top) for x, (_, c) in zip(score, sets)) + math.exp(-top)
                each = [math.exp(x - top) / total for x in score]  # posterior of one value with that set
                held: dict[str, float] = {}
                common: dict[tuple[str, str], float] = {}
                for p, (who, c) in zip(each, sets):
                    for i, a in enumerate(who):
                        held[a] = held.get(a, 0) + c
                        row = out.setdefault((a, a), [0.0] * 5)
                        row[0] += items * c
                        row[1] += items * c * p
                        for b in who[i + 1 :]:
                            row = out.setdefault((a, b), [0.0] * 5)
                            row[0] += items * c
                            row[2] += items * c * p
                            row[3] += items * c * (1 - p)
                            common[a, b] = common.get((a, b), 0) + c
                for a in held:
                    for b in held:
                        if a < b:
                            out.setdefault((a, b), [0.0] * 5)[4] += items * max(0.0, min(held[a], held[b]) - common.get((a, b), 0))
            yield pd.DataFrame([(a, b, *v) for (a, b), v in out.items()], columns=["a", "b", "n", "true_w", "both_true", "both_false", "differ"])

    return run


def _dependence(r, model: SourceModel, prior: float = 0.1) -> float:
    """Posterior that one of two sources copies the other, from shared true, shared false and differing values."""
    a = min(max((model.accuracy.get(r.a, 0.8) + model.accuracy.get(r.b, 0.8)) / 2, 0.05), 0.95)
    n, c = model.false_values, model.copy_rate
    same_true, same_false = a * a, (1 - a) ** 2 / n
    apart = max(1e-6, 1 - same_true - same_false)
    free = r.both_true * math.log(same_true) + r.both_false * math.log(same_false) + r.differ * math.log(apart)
    copied = (
        r.both_true * math.log(a * c + same_true * (1 - c))
        + r.both_false * math.log((1 - a) * c + same_false * (1 - c))
        + r.differ * math.log(apart * (1 - c))
    )
    x = max(-50.0, min(50.0, math.log(prior / (1 - prior)) + copied - free))
    return 1 / (1 + math.exp(-x))


def fuse(staging: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per duplicate group and field: group_id, field_name, doc_id, source, size, posterior.

    ``doc_id`` is the member whose value has the maximum posterior; of members that hold that value the
    most trusted, then the latest, then the smallest doc_id, which also settles equal posteriors.
    ``posterior`` is that value's share among the field's values. No row where no member has a genuine
    value; groups of one have no rows; null doc_ids are ignored; an empty table gives an empty result;
    extra columns are not read. A source that ``ranks`` does not list is trusted least.
    """
    rank = ranks.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.min("trust_rank").cast("long").alias("rank"))
    last = F.lit(2**62)
    told = claims(group_members(staging)).join(rank, "source", "left").withColumns({
        "voter": F.when(F.col("rank").isNotNull(), F.col("source")).otherwise(F.lit(UNLISTED)), "rank": F.coalesce("rank", last),
    })
    rows = cut(told)
    model = estimate_sources(rows.select("group_id", "field_name", "hash", F.col("voter").alias("source")))
    votes = F.pandas_udf(lambda who: who.map(lambda w: float(model.votes(w))).astype("float64"), T.DoubleType())
    # small is good in all three, so that the smallest doc_id of the best claims comes out of one aggregate
    less = F.when(F.col("field_name") == "source", F.col("rank")).otherwise(-F.col("size").cast("long"))
    older = F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), last)
    claim = F.struct(less.alias("less"), F.col("rank"), older.alias("older"), "doc_id", "source", "size")
    item = ["group_id", "field_name"]
    values = rows.groupBy(*item, "hash").agg(F.collect_set("voter").alias("who"), F.min(claim).alias("best"))
    values = values.select(*item, "best", votes("who").alias("vote"))
    tops = values.groupBy(*item).agg(F.min(F.struct("best.less", "best.rank", "best.older")).alias("top"), F.max("vote").alias("most"))
    both = values.join(tops, item)
    behind = F.when(F.col("best.less") > F.col("top.less"), 3).when(F.col("best.rank") > F.col("top.rank"), 2).when(F.col("best.older") > F.col("top.older"), 1).otherwise(0)
    scored = both.withColumn("log", F.col("vote") - F.col("most") - model.most() * behind)
    final = scored.groupBy(*item).agg(F.min(F.struct((-F.col("log")).alias("cost"), "best.doc_id", "best.source", "best.size")).alias("w"), F.sum(F.exp("log")).alias("sum"))
    return final.select(*item, "w.doc_id", "w.source", "w.size", (F.exp(-F.col("w.cost")) / F.col("sum")).alias("posterior"))
