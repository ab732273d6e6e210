"""Measurement tables for modelling: descriptors, long form, folds, metrics, neighbours, scenarios."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.retrieval import cosine_top_k

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Hydropathy, average residue masses (Da) and ionisation constants (fixed values of the literature).
HYDROPATHY = dict(zip(RESIDUES, (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3)))
MASS = dict(zip(RESIDUES, (71.0779, 103.1429, 115.0874, 129.114, 147.1739, 57.0513, 137.1393, 113.1576, 128.1723, 113.1576, 131.1961, 114.1026, 97.1152, 128.1292, 156.1857, 87.0773, 101.1039, 99.1311, 186.2099, 163.1733)))
WATER = 18.0153
POSITIVE, NEGATIVE = {"K": 10.0, "R": 12.0, "H": 5.98}, {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINUS, C_TERMINUS = 7.5, 3.55


def bare_sequence(sequence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(sequence), r"\s+", ""), r"\*+$", "")


def charge(seq: str, ph: float) -> float:
    """Net charge at a pH from the ionisation constants."""
    out = 1 / (1 + 10 ** (ph - N_TERMINUS)) - 1 / (1 + 10 ** (C_TERMINUS - ph))
    out += sum(seq.count(a) / (1 + 10 ** (ph - pk)) for a, pk in POSITIVE.items())
    return out - sum(seq.count(a) / (1 + 10 ** (pk - ph)) for a, pk in NEGATIVE.items())


def isoelectric_point(seq: str) -> float:
    low, high = 0.0, 14.0
    while high - low > 1e-4:
        mid = (low + high) / 2
        low, high = (mid, high) if charge(seq, mid) > 0 else (low, mid)
    return (low + high) / 2


_POINT = T.StructType([T.StructField("isoelectric_point", T.DoubleType()), T.StructField("charge_ph7", T.DoubleType())])


@F.pandas_udf(_POINT)
def electric(seq: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if not s else (round(isoelectric_point(s), 2), round(charge(s, 7.0), 2)) for s in seq]
    return pd.DataFrame(rows, columns=_POINT.names)


def descriptors(features: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(enzyme_id, seq_length, composition, aromaticity, gravy, molecular_weight, ...) from sequences.

    Letters that are no standard residue are counted and then left out of everything else. Counts are
    taken in the JVM; only the iterative isoelectric point goes to Python. A null or empty sequence gives a
    length of 0 and nulls.
    """
    raw = features.select("enzyme_id", bare_sequence(F.col(sequence)).alias("_raw")).distinct()
    rows = raw.withColumn("_s", F.regexp_replace("_raw", f"[^{RESIDUES}]", ""))
    n = F.nullif(F.length("_s"), F.lit(0))
    count = {a: F.length("_s") - F.length(F.replace("_s", F.lit(a), F.lit(""))) for a in RESIDUES}
    total = lambda table: sum((count[a] * v for a, v in table.items()), F.lit(0.0))
    share = lambda letters: sum((count[a] for a in letters), F.lit(0)) / n
    wide = rows.select(
        "enzyme_id", F.coalesce(F.length("_s"), F.lit(0)).alias("seq_length"), (F.length("_raw") - F.length("_s")).alias("nonstandard_residues"),
        *[(count[a] / n).alias(f"aa_{a.lower()}") for a in RESIDUES], share("FWY").alias("aromaticity"), share("AVILMFWC").alias("hydrophobic_fraction"),
        (total(HYDROPATHY) / n).alias("gravy"), F.when(n.isNotNull(), total(MASS) + WATER).alias("molecular_weight"), electric("_s").alias("_e"),
    )
    return wide.select("*", "_e.isoelectric_point", "_e.charge_ph7").drop("_e")


def to_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per id and column that is not blank; blanks are "not measured", never zero."""
    return wide.unpivot(list(ids), [F.col(f"`{c}`") for c in columns], name, value).where(F.col(value).isNotNull())


def measured_conditions(long: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Condition columns ``activity_at_<ph>_<temperature>_<substrate>`` as values, and activity above zero."""
    part = lambda i: F.regexp_extract(name, r"^activity_at_([0-9.]+)_([0-9]+)_(.+)$", i)
    return long.where(F.col(name).rlike("^activity_at_")).select(*[c for c in long.columns if c not in (name, value)], part(1).cast("double").alias("ph"), part(2).cast("int").alias("temperature_c"), part(3).alias("substrate"), F.col(value).alias("activity"), (F.col(value) > 0).alias("is_active"))


def confusion(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*by, truth, guess).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., accuracy, macro_f1): F1 of every label that is true or guessed, unweighted."""
    cells = confusion(df, truth, guess, by).select(*by, F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g"), "n")
    sides = cells.select(*by, "n", F.explode(F.array(F.struct(F.col("t").alias("label"), (F.col("t") == F.col("g")).alias("hit"), F.lit(True).alias("is_truth")), F.struct(F.col("g").alias("label"), (F.col("t") == F.col("g")).alias("hit"), F.lit(False).alias("is_truth")))).alias("x"))
    per = sides.groupBy(*by, "x.label").agg(F.sum(F.when(F.col("x.hit") & F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"), F.sum(F.when(F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("true"))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("true")).alias("accuracy"), F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1"))


def regression_errors(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r2, mae, rmse) in one pass."""
    ok = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull() & ~F.isnan(truth) & ~F.isnan(guess))
    error = F.col(truth) - F.col(guess)
    return ok.groupBy(*by).agg((1 - F.sum(error * error) / F.nullif(F.var_pop(truth) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def majority_by_fold(df: DataFrame, truth: str, fold: str) -> DataFrame:
    """(fold, guess): the most frequent label outside each fold; ties go to the smaller label. The
    counts per fold and label are all that is joined."""
    cells = df.where(F.col(truth).isNotNull() & F.col(fold).isNotNull()).groupBy(fold, truth).agg(F.count("*").alias("n"))
    total = cells.groupBy(truth).agg(F.sum("n").alias("all"))
    folds = cells.select(fold).distinct()
    pairs = folds.crossJoin(total).join(cells, [fold, truth], "left")  # folds times labels, both few
    rest = pairs.select(fold, truth, (F.col("all") - F.coalesce("n", F.lit(0))).alias("rest"))
    order = Window.partitionBy(fold).orderBy(F.desc("rest"), F.col(truth).cast("string"))
    return rest.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(fold, F.col(truth).alias("guess"))


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """A fold per row, the same for all rows of a group, by hash; a null group is its own group."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("\u0000")), F.lit(seed)), F.lit(folds)).cast("int"))


def knn_labels(table: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """(query_id, guess): most frequent label of the k nearest rows; ties go to the smaller label."""
    near = cosine_top_k(table, queries, k, key=key, vector=vector, keep=(label,))
    votes = near.groupBy("query_id", label).agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("w")).select("query_id", F.col("w.l").alias("guess"))


def edges(df: DataFrame, columns: Sequence[str], n: int = 4) -> dict[str, list[float]]:
    """Quantiles that part each column into ``n`` bins, all in one pass."""
    q = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c).cast("double")), [i / n for i in range(1, n)], 1000).alias(c) for c in columns]).first()
    return {c: q[c] or [] for c in columns}


def binned_at(df: DataFrame, at: Mapping[str, Sequence[float]]) -> DataFrame:
    """Each column as its bin (0 to n - 1), -1 for null and NaN."""
    binned = {}
    for c, points in at.items():
        value = F.col(c).cast("double")
        binned[f"{c}_bin"] = F.when(value.isNull() | F.isnan(value), F.lit(-1)).otherwise(sum(((value > F.lit(x)).cast("int") for x in points), F.lit(0)))
    return df.withColumns(binned)


def bins(df: DataFrame, columns: Sequence[str], n: int = 4) -> DataFrame:
    """Each column as its quantile bin."""
    return binned_at(df, edges(df, columns, n))


def table_model_scores(binned: DataFrame, columns: Sequence[str], truth: str, fold: str, weight: str | None = None, train: DataFrame | None = None) -> DataFrame:
    """(fold, accuracy) of a table model: the label that is most frequent outside the fold among rows
    with the same bins. Counts only; ``weight`` is the column with the rows that a row stands for. The
    labels are learned from ``train`` where that is given (another version of the same rows), else from
    ``binned``; it is always ``binned`` that is scored."""
    keys = [f"{c}_bin" for c in columns]
    count = lambda df: df.where(F.col(truth).isNotNull() & F.col(fold).isNotNull()).groupBy(*keys, fold, truth).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    asked = count(binned)
    known = asked if train is None else count(train)
    per_key = known.groupBy(*keys, truth).agg(F.sum("n").alias("all"))
    here = asked.select(*keys, fold).distinct()
    rest = here.join(per_key, keys) if keys else here.crossJoin(per_key)
    guess = rest.join(known.withColumnRenamed("n", "own"), [*keys, fold, truth], "left").select(*keys, fold, F.struct((F.col("all") - F.coalesce("own", F.lit(0))).alias("n"), F.col(truth).cast("string").alias("t")).alias("g"))
    best = guess.groupBy(*keys, fold).agg(F.max("g").alias("g"))
    scored = asked.join(best, [*keys, fold], "left")
    return scored.groupBy(fold).agg((F.sum(F.when(F.col(truth).cast("string") == F.col("g.t"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


class CellCounts:
    """The rows of a table model as counts per cell (bins, fold, label), for searches that score many sets of
    columns. Cells are at most bins ** columns * folds * labels, whatever the rows, and refused over
    ``most``; they come to the driver once, and a score is a few sums over them."""

    def __init__(self, binned: DataFrame, columns: Sequence[str], truth: str, fold: str, most: int = 2_000_000):
        self.columns, self.truth, self.fold = list(columns), truth, fold
        keys = [f"{c}_bin" for c in columns]
        cells = binned.where(F.col(truth).isNotNull() & F.col(fold).isNotNull()).groupBy(*keys, fold, F.col(truth).cast("string").alias("_t")).agg(F.count("*").alias("_n"))
        self.cells = cells.limit(most + 1).toPandas()
        if len(self.cells) > most:
            raise ValueError(f"more than {most} cells")

    def folds(self) -> list:
        return sorted(self.cells[self.fold].unique())

    def by_fold(self, columns: Sequence[str], without: Sequence = (), on: Sequence | None = None, train: CellCounts | None = None) -> dict:
        """Accuracy on each fold (of ``on``) of the labels most frequent outside it among rows with its bins,
        as :func:`table_model_scores`; rows of the folds ``without`` are not there at all, and labels are
        learned from ``train`` where that is given."""
        keys = [f"{c}_bin" for c in columns] or ["_all"]

        def summed(cells: pd.DataFrame) -> pd.DataFrame:
            return cells[~cells[self.fold].isin(list(without))].assign(_all=0).groupby([*keys, self.fold, "_t"], as_index=False, dropna=False)["_n"].sum()

        asked = summed(self.cells)
        known = asked if train is None else summed(train.cells)
        out = {}
        for f in sorted(asked[self.fold].unique()) if on is None else on:
            here, rest = asked[asked[self.fold] == f], known[known[self.fold] != f].groupby([*keys, "_t"], as_index=False)["_n"].sum()
            guess = rest.sort_values(["_n", "_t"]).groupby(keys, as_index=False).last().rename(columns={"_t": "_g"})[[*keys, "_g"]]
            told = here.merge(guess, on=keys, how="left")
            out[f] = float(told.loc[told["_t"] == told["_g"], "_n"].sum() / told["_n"].sum()) if len(told) else float("nan")
        return out

    def score(self, columns: Sequence[str], without: Sequence = ()) -> float:
        scores = list(self.by_fold(columns, without).values())
        return sum(scores) / len(scores) if scores else 0.0


def separate(df: DataFrame, target: str, targets: Sequence[str], group: str, fold: str, metadata: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The rows with a target, and the columns that a model may see: not the target, nor another target,
    nor what names the group, the fold or where a row is from, all of which would tell it the answer."""
    missing = [c for c in (target, group, fold) if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    hidden = {target, group, fold, *targets, *metadata}
    rows = df.where(F.col(target).isNotNull() & ~F.isnan(target)) if dict(df.dtypes)[target] == "double" else df.where(F.col(target).isNotNull())
    return rows, [c for c in df.columns if c not in hidden]


SCENARIOS = ("original", "noise", "missing", "few", "flipped")


def scenario_pair(df: DataFrame, name: str, columns: Sequence[str], truth: str, key: Column, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) of an adverse scenario: noise and missing values disturb what is tested, fewer rows
    (three tenths) and flipped labels what is learned from; the truth that scores are taken against stays."""
    if name in ("noise", "missing"):
        return df, scenario(df, name, columns, truth, key, seed)
    return scenario(df, name, columns, truth, key, seed), df


def scenario(df: DataFrame, name: str, columns: Sequence[str], truth: str, key: Column, seed: int = 0) -> DataFrame:
    """An adverse version of a table: ``original``, ``noise`` (0.2 of a column's deviation), ``missing``
    (a fifth of the values gone), ``few`` (three tenths of the rows), ``flipped`` (a tenth of the labels
    turned). Seeded by key, so it is the same for any partitioning."""
    draw = lambda salt: F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    if name == "noise":
        spread: Mapping[str, float] = df.agg(*[F.stddev_pop(F.when(~F.isnan(c), F.col(c).cast("double"))).alias(c) for c in columns]).first().asDict()
        # two uniform draws make a normal one
        normal = lambda c: F.sqrt(-2 * F.log(draw(f"{c}0") + 1e-6)) * F.cos(6.283185307179586 * draw(f"{c}1"))
        return df.withColumns({c: F.col(c) + 0.2 * (spread[c] or 0.0) * normal(c) for c in columns})
    if name == "missing":
        return df.withColumns({c: F.when(draw(c) >= 0.2, F.col(c)) for c in columns})
    if name == "few":
        return df.where(draw("row") < 0.3)
    if name == "flipped":
        return df.withColumn(truth, F.when(draw("label") < 0.1, ~F.col(truth)).otherwise(F.col(truth)))
    return df


def robust_choice(scores: DataFrame) -> DataFrame:
    """(model, worst): the model whose worst scenario is best; ties go to the smaller name."""
    worst = scores.groupBy("model").agg(F.min("score").alias("worst"))
    return worst.orderBy(F.desc("worst"), "model").limit(1)


def pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str, task: str = "classification", model: str = "tree"):
    """Preparation (median and mode for blanks, standard scale, one column per category, unknown ones
    kept apart) and a model: ``tree`` (depth 8), ``forest`` (100 trees) or ``linear``."""
    from pyspark.ml import Pipeline, classification, regression
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    kinds = {
        ("tree", "classification"): lambda: classification.DecisionTreeClassifier(maxDepth=8, labelCol=label, seed=0), ("tree", "regression"): lambda: regression.DecisionTreeRegressor(maxDepth=8, labelCol=label, seed=0),
        ("forest", "classification"): lambda: classification.RandomForestClassifier(numTrees=100, labelCol=label, seed=0), ("forest", "regression"): lambda: regression.RandomForestRegressor(numTrees=100, labelCol=label, seed=0),
        ("linear", "classification"): lambda: classification.LogisticRegression(labelCol=label, maxIter=50), ("linear", "regression"): lambda: regression.LinearRegression(labelCol=label, maxIter=50),
    }
    filled = [f"{c}_filled" for c in numeric]
    steps = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    for c in categorical:
        steps += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index"], outputCols=[f"{c}_hot"], handleInvalid="keep")]
    steps.append(VectorAssembler(inputCols=["_scaled", *[f"{c}_hot" for c in categorical]], outputCol="features"))
    return Pipeline(stages=[*steps, kinds[model, task]()])


def preparation(numeric: Sequence[str], categorical: Sequence[str], label: str):
    """The steps of :func:`pipeline` before the model."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=pipeline(numeric, categorical, label).getStages()[:-1])


def fit_network(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, hidden: Sequence[int] = (16,), rounds: int = 100, rate: float = 0.03):
    """A fitted pipeline with a multilayer perceptron: its layers follow from what the preparation gives.
    Labels are 0, 1, ... as doubles."""
    from pyspark.ml import PipelineModel, classification

    ready = preparation(numeric, categorical, label).fit(df)
    made = ready.transform(df).select("features", label).persist()
    inputs = made.first()["features"].size
    classes = int(made.agg(F.max(label)).first()[0]) + 1
    network = classification.MultilayerPerceptronClassifier(layers=[inputs, *hidden, max(2, classes)], labelCol=label, seed=0, maxIter=rounds, stepSize=rate).fit(made)
    made.unpersist()
    return PipelineModel(stages=[*ready.stages, network])


#: Genes of a perceptron: layers, neurons of the first, how they shrink, solver, step and rounds.
NETWORK_GENES = {"layers": (1, 2, 3), "neurons": (8, 16, 32, 64), "shrink": (1.0, 0.5), "solver": ("l-bfgs", "gd"), "rate": (0.003, 0.03, 0.3), "rounds": (50, 100, 200)}


def tune_network(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str, genes: Mapping[str, Sequence] = NETWORK_GENES, **search_options) -> tuple[dict, float]:
    """(genes, score) of the perceptron that is best over fixed folds, by genetic search with its defaults
    (``search_options`` are those of :func:`attestry.operators.search.evolve`). The score is the mean
    macro-F1; the preparation is fitted on the other folds only. A network that cannot be fitted counts as
    the worst. Fits run one after the other, each as Spark jobs over all rows; it is meant for tables of a
    few folds."""
    from pyspark.ml import classification

    from attestry.operators import search

    folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
    made = []
    for f in folds:
        ready = preparation(numeric, categorical, label).fit(df.where(F.col(fold) != f))
        made.append((f, ready.transform(df.where(F.col(fold).isNotNull())).select("features", label, fold).persist()))
    classes = max(2, int(df.agg(F.max(label)).first()[0] or 0) + 1)

    def score(g: dict) -> float:
        total = 0.0
        for f, rows in made:
            inputs = rows.first()["features"].size
            hidden = [max(2, int(g["neurons"] * g["shrink"] ** i)) for i in range(g["layers"])]
            model = classification.MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], labelCol=label, seed=0, maxIter=g["rounds"], stepSize=g["rate"], solver=g["solver"])
            try:
                guessed = model.fit(rows.where(F.col(fold) != f)).transform(rows.where(F.col(fold) == f))
                total += float(macro_f1(guessed, label, "prediction").first()["macro_f1"] or 0.0)
            except Exception:  # noqa: BLE001 - a network that does not fit is the worst
                return float("nan")
        return total / len(made) if made else float("nan")

    best = search.evolve(dict(genes), lambda genomes: [score(g) for g in genomes], **search_options)
    for _, rows in made:
        rows.unpersist()
    return best


def scaled_target(df: DataFrame, target: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The table with ``target`` at mean 0 and deviation 1, and the way back for predictions."""
    r = df.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    mean, spread = r.m or 0.0, r.s or 1.0
    return df.withColumn(target, (F.col(target) - mean) / spread), lambda c: c * spread + mean


def cross_validate(df: DataFrame, fold: str, make: Callable[[], object], label: str) -> DataFrame:
    """(fold, side, accuracy, macro_f1): a model per fold, scored on the fold and on the rest."""
    folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().limit(101).collect())
    if len(folds) > 100:
        raise ValueError("more than 100 folds")
    out = None
    for f in folds:
        fitted = make().fit(df.where(F.col(fold) != f))
        guessed = fitted.transform(df.where(F.col(fold).isNotNull())).select(F.lit(f).alias("fold"), F.when(F.col(fold) == f, "validation").otherwise("training").alias("side"), F.col(label), F.col("prediction"))
        one = macro_f1(guessed, label, "prediction", ["fold", "side"])
        out = one if out is None else out.unionByName(one)
    return out


def fold_summary(scores: DataFrame, score: str = "macro_f1") -> DataFrame:
    """(mean, deviation, gap): over folds, of validation, and how much better training is."""
    wide = scores.groupBy("fold").pivot("side", ["training", "validation"]).agg(F.first(score))
    return wide.agg(F.avg("validation").alias("mean"), F.stddev_pop("validation").alias("deviation"), F.avg(F.col("training") - F.col("validation")).alias("gap"))


def task_of(df: DataFrame, target: str, most_classes: int = 20) -> str:
    """``classification`` for text, booleans and few whole numbers, else ``regression``."""
    kind = dict(df.dtypes)[target]
    if kind in ("string", "boolean"):
        return "classification"
    few = df.select(target).distinct().limit(most_classes + 1).count() <= most_classes
    whole = df.where(F.col(target).cast("double") != F.floor(F.col(target).cast("double"))).limit(1).count() == 0
    return "classification" if few and whole else "regression"
