"""Supervised detection, its evaluation and cut-off, and an outlier score."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models import cells as grown
from panelsift.models.forest import NODE_CACHE, assembled, cells_of, fold_rows, spread, vectors
from panelsift.models.logistic import area_under_roc, confusion
from panelsift.models.prepare import holdout
from panelsift.operators.ordered import quantiles, running_total
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise


def _weighted(data: DataFrame) -> DataFrame:
    """Weights that make both classes count alike."""
    counts = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    return data.withColumn("weight", weight)


def _learner(
    kind: str, trees: int = 100, depth: int | None = None, min_leaf: int = 2, rate: float = 0.1, seed: int = 42
):
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=trees, maxDepth=depth or 20, minInstancesPerNode=min_leaf,
            weightCol="weight", seed=seed, **NODE_CACHE,
        )
    if kind == "gradient_boosting":
        return GBTClassifier(maxIter=trees, maxDepth=depth or 5, stepSize=rate, seed=seed)
    raise ValueError(f"unknown detector {kind!r}")


def train_detector(
    df: DataFrame,
    features: Sequence[str],
    outcome: str,
    keys: Sequence[str],
    kind: str = "random_forest",
    test_size: float = 0.2,
    trees: int = 100,
    depth: int | None = None,
    min_leaf: int = 2,
    rate: float = 0.1,
    seed: int = 42,
):
    """Fit on the rows outside the hold-out; returns the model and scored hold-out rows.

    ``keys`` decide the hold-out, so passing the user keeps users on one side.
    """
    label = F.when(F.coalesce(c(outcome) > 0, F.lit(False)), 1.0).otherwise(0.0)
    extra = {"label": label, "held_out": holdout(keys, test_size, seed)}
    data = spread(materialise(assembled(df, features, extra)))
    train = data.where("NOT held_out")
    learner = _learner(kind, trees, depth, min_leaf, rate, seed)
    model = learner.fit(_weighted(train) if kind == "random_forest" else train)
    scored = model.transform(data.where("held_out"))
    return model, scored.withColumn("score", vector_to_array("probability")[1])


KINDS = ("random_forest", "gradient_boosting")
# bins of the score curve; a cut is a multiple of its width
CURVE_BINS = 10_000
PARALLEL_FITS = 5


@dataclass
class DetectorChoice:
    """Scores of every row by models that had not seen its user, and what follows from them."""

    scores: DataFrame  # kind, fold, carried columns, label, score
    folds: DataFrame  # kind, fold, confusion counts and scores at 0.5, auc
    curve: DataFrame  # kind, bin, cut, flagged, tp, precision, recall, f1
    chosen: DataFrame  # the chosen point of each kind's curve, meets_targets, best


def cross_validate_detectors(
    df: DataFrame,
    features: Sequence[str],
    outcome: str,
    user: str,
    carried: Sequence[str] = (),
    kinds: Sequence[str] = KINDS,
    folds: int = 5,
    target_precision: float = 0.8,
    target_recall: float = 0.7,
    **settings,
) -> DetectorChoice:
    """Fit each kind once per fold of whole users and choose a cut-off and a kind.

    Folds are balanced. ``settings`` are those of :func:`train_detector`. Trees are grown on
    counted cells of the rows and each row takes the score of its bins; where there are too
    many cells, MLlib fits the rows. Scores are stored.
    """
    label = F.when(F.coalesce(c(outcome) > 0, F.lit(False)), 1.0).otherwise(0.0)
    rows = fold_rows(df, features, label, user, folds, carried)
    if rows.select("fold").distinct().count() < 2:
        raise ValueError("complete rows of at least two users are needed")
    learners = {kind: _learner(kind, **settings) for kind in kinds}
    cells, binned = cells_of(rows, len(features))
    if cells is None:
        scores = _scores_by_rows(vectors(rows, len(features), carried), carried, learners)
    else:
        scores = _scores_by_cells(binned, cells, carried, learners)
    curve = materialise(score_curve(scores, ["kind"]))
    return DetectorChoice(scores, fold_metrics(scores), curve, choose_cut(curve, target_precision, target_recall))


def _scores_by_rows(data: DataFrame, carried: Sequence[str], learners: dict[str, object]) -> DataFrame:
    """Out-of-fold scores by MLlib; folds are fitted as parallel jobs, a scored model is dropped."""
    spark = data.sparkSession
    present = sorted(r.fold for r in data.select("fold").distinct().collect())

    def fit(job: tuple[str, int]) -> DataFrame:
        kind, fold = job
        train = data.where(F.col("fold") != fold)
        sides = {r.label for r in train.select("label").distinct().collect()}
        test = data.where(F.col("fold") == fold)
        if len(sides) < 2:  # nothing to tell apart: all rows score the one label there is
            scored = test.withColumn("score", F.lit(sides.pop()))
        else:
            model = learners[kind].fit(_weighted(train) if kind == "random_forest" else train)
            scored = model.transform(test).withColumn("score", vector_to_array("probability")[1])
        return materialise(scored.select(F.lit(kind).alias("kind"), "fold", *[c(n) for n in carried], "label", "score"))

    with ThreadPool(PARALLEL_FITS) as pool:
        parts = pool.map(inheritable_thread_target(spark)(fit), [(k, f) for k in learners for f in present])
    return reduce(DataFrame.unionByName, parts)


def _scores_by_cells(
    binned: DataFrame, cells: grown.Cells, carried: Sequence[str], learners: dict[str, object]
) -> DataFrame:
    """Out-of-fold scores of bin vectors, joined to the rows."""
    spark = binned.sparkSession
    present = np.unique(cells.fold).tolist()
    counts = [[int(cells.n[(cells.fold != f) & (cells.label == s)].sum()) for s in (0, 1)] for f in present]
    # a fold whose training rows have one label scores it
    values = {kind: np.tile([[float(n[1] > 0)] for n in counts], len(cells.bins)) for kind in learners}
    told = [i for i, n in enumerate(counts) if min(n) > 0]
    folds = [present[i] for i in told]
    for kind, learner in learners.items():
        if not folds:
            continue
        if kind == "random_forest":
            weights = [[sum(counts[i]) / (2 * n) for n in counts[i]] for i in told]
            forests = grown.classification_forests(
                spark, cells, folds, weights, learner.getNumTrees(), learner.getMaxDepth(),
                learner.getMinInstancesPerNode(), learner.getSeed(),
            )
            values[kind][told] = grown.forest_values(spark, cells, forests, "gini")
        else:
            values[kind][told] = grown.boosted_values(
                spark, cells, folds, learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize()
            )
    keys = [n for n in binned.columns if n.startswith("__b")][: cells.bins.shape[1]]
    place = {f: i for i, f in enumerate(present)}
    met = np.unique(np.column_stack([cells.fold, cells.at]), axis=0)
    table = pd.DataFrame(cells.bins[met[:, 1]].astype(np.int8), columns=keys).assign(fold=met[:, 0].astype(np.int32))
    for i, kind in enumerate(learners):
        table[f"__s{i}"] = values[kind][[place[f] for f in met[:, 0]], met[:, 1]]
    types = ", ".join([*(f"{k} tinyint" for k in keys), "fold int", *(f"__s{i} double" for i in range(len(learners)))])
    stored = materialise(spark.createDataFrame(table, types))
    joined = lookup_join(binned, stored, ["fold", *keys], "left")
    each = [F.struct(F.lit(k).alias("kind"), F.col(f"__s{i}").alias("score")) for i, k in enumerate(learners)]
    shown = joined.select("fold", *[c(n) for n in carried], "label", F.inline(F.array(*each)))
    return materialise(shown.select("kind", "fold", *[c(n) for n in carried], "label", "score"))


def fold_metrics(scores: DataFrame, by: Sequence[str] = ("kind", "fold"), cut: float = 0.5) -> DataFrame:
    """Confusion counts and scores at a cut, and the exact area under the ROC curve.

    The area comes from the ranks of the distinct scores, equal ones sharing theirs; a
    part with one class only has none.
    """
    keys = list(by)
    guessed = scores.withColumn("prediction", F.when(F.col("score") >= cut, 1.0).otherwise(0.0))
    counts = scores.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")
    )
    along = running_total(counts, {"cum": F.col("n")}, [F.col("score")], keys)
    rank = F.col("cum") - (F.col("n") - 1) / 2
    sums = along.groupBy(*keys).agg(
        F.sum(F.col("p") * rank).alias("ranks"), F.sum("p").cast("double").alias("pos"),
        F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"),
    )
    area = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    areas = sums.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("auc"))
    return confusion(guessed, keys).join(areas, keys)


def score_curve(scores: DataFrame, by: Sequence[str] = (), bins: int = CURVE_BINS) -> DataFrame:
    """Precision and recall at every cut where rows lie, from one histogram of the scores.

    Scores are in [0, 1]. Histograms of parts of the data add up, so one pass is enough;
    what is ordered are at most ``bins`` rows of a kind.
    """
    keys = list(by)
    bin_ = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counted = scores.groupBy(*[c(k) for k in keys], bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")
    )
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    down = own.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.select(
        *keys, "bin", F.sum("n").over(down).alias("flagged"), F.sum("p").over(down).alias("tp"),
        F.sum("p").over(own).alias("positives"),
    )
    tp = F.col("tp").cast("double")
    return summed.select(
        *keys, "bin", (F.col("bin") / bins).alias("cut"), "flagged", "tp", "positives",
        F.try_divide(tp, F.col("flagged")).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("positives")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, F.col("flagged") + F.col("positives")), F.lit(0.0)).alias("f1"),
    )


def choose_cut(
    curve: DataFrame, target_precision: float = 0.8, target_recall: float = 0.7, kind: str = "kind"
) -> DataFrame:
    """Per kind the cut of the best F1, among cuts that meet both targets if any does.

    Of equal cuts the lower one is taken, as it misses less. ``best`` marks the kind
    with the greatest F1.
    """
    met = (F.col("precision") >= target_precision) & (F.col("recall") >= target_recall)
    rated = curve.withColumn("meets_targets", met)
    order = [F.col("meets_targets").desc(), F.col("f1").desc(), F.col("bin").asc()]
    top = rated.withColumn("__r", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    # one row per kind from here on
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("f1").desc(), F.col(kind)))
    return top.where("__r = 1").drop("__r").withColumn("best", first == 1)


def evaluate_detector(
    scored: DataFrame, target_precision: float = 0.8, target_recall: float = 0.7
) -> DataFrame:
    """One row: confusion counts, scores, AUC and whether both targets are met."""
    met = (F.col("precision") >= target_precision) & (F.col("recall") >= target_recall)
    auc = area_under_roc(scored)
    return confusion(scored).withColumn("auc", F.lit(auc).cast("double")).withColumn(
        "meets_targets", met
    )


def flag_top_share(
    df: DataFrame, score_col: str, target_rate: float = 0.05, name: str = "flagged"
) -> DataFrame:
    """Flag scores above the quantile that leaves the target rate above it."""
    cut = quantiles(df, score_col, {"cut": 1 - target_rate}).select("cut").scalar()
    over = F.coalesce(c(score_col) > cut, F.lit(False))
    return df.withColumn("cut_off", cut).withColumn(name, F.when(over, 1).otherwise(0))


def rate_reduction(flagged: DataFrame, label_col: str, flag_col: str = "flagged") -> DataFrame:
    """Outcome rate before and after leaving out the flagged rows."""
    positive = F.when(F.coalesce(c(label_col) > 0, F.lit(False)), 1.0).otherwise(0.0)
    kept = c(flag_col) == 0
    rates = flagged.agg(
        F.avg(c(flag_col)).alias("flag_rate"),
        F.avg(positive).alias("baseline_rate"),
        F.avg(F.when(kept, positive)).alias("remaining_rate"),
    )
    change = 1 - F.try_divide(F.col("remaining_rate"), F.col("baseline_rate"))
    return rates.withColumn("reduction", change)


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    longer = np.maximum(n, 3)
    many = 2 * (np.log(longer - 1) + np.euler_gamma) - 2 * (longer - 1) / longer
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Random splits until a row is alone, as (column, cut, left, right, path) rows."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(())
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if level >= depth or len(spread) == 0:
            nodes[at] = (-1, 0.0, -1, -1, level + float(_path_norm(len(rows))))
            return at
        column = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, column].min(), rows[:, column].max()))
        left = rows[:, column] < cut
        nodes[at] = (column, cut, build(rows[left], level + 1), build(rows[~left], level + 1), 0.0)
        return at

    build(x, 0)
    return nodes


def outlier_scores(
    df: DataFrame,
    features: Sequence[str],
    trees: int = 100,
    contamination: float = 0.1,
    seed: int = 42,
    max_samples: int = 256,
) -> DataFrame:
    """Isolation score of every complete row, and a flag for the top share.

    Each tree is grown in its own task on at most ``max_samples`` rows drawn by hash,
    which the method subsamples by design; every row is then scored where it is
    against the trees, whose size does not depend on the data.
    """
    names = [f"x{i}" for i in range(len(features))]
    complete = df.dropna(subset=list(features))
    n = complete.count()
    # a row takes part in a tree with the chance that yields about max_samples rows each,
    # with room above so that the smallest 256 hashes are almost surely among them
    share = min(1.0, 2.0 * max_samples / max(n, 1))
    buckets = 1 << 40

    def place(tree):
        return F.pmod(F.xxhash64(F.col("__row"), tree, F.lit(seed)), F.lit(buckets))

    lucky = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(t.alias("tree"), place(t).alias("place")),
        ),
        lambda s: s["place"] < int(share * buckets),
    )
    columns = [c(f).cast("double").alias(x) for f, x in zip(features, names)]
    # rows are numbered so that copies of a row are drawn independently
    numbered = complete.withColumn("__row", F.monotonically_increasing_id())
    picked = numbered.select(*columns, F.explode(lucky).alias("p")).select("p.*", *names)
    depth = max(1, math.ceil(math.log2(max_samples)))

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = group.nsmallest(max_samples, "place")[names].to_numpy(float)
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), depth)
        table = pd.DataFrame(nodes, columns=["col", "cut", "left", "right", "path"])
        return table.assign(tree=int(key[0]), node=range(len(table)), rows=len(x))

    # about 2 * max_samples rows per group by the hash share, whatever the size of the data
    forest = picked.groupBy("tree").applyInPandas(
        grow,
        "col int, cut double, left int, right int, path double, tree int, node int, rows int",
    )
    grown = [
        part.sort_values("node").reset_index(drop=True)
        for _, part in forest.toPandas().groupby("tree")
    ]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    out = [*df.columns, "outlier_score"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[[f"__{n}" for n in names]].to_numpy(float)
            total = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                col, cut = t["col"].to_numpy(), t["cut"].to_numpy()
                left, right = t["left"].to_numpy(), t["right"].to_numpy()
                for _ in range(depth):
                    inner = np.flatnonzero(col[at] >= 0)
                    if len(inner) == 0:
                        break
                    here = at[inner]
                    at[inner] = np.where(x[inner, col[here]] < cut[here], left[here], right[here])
                total += t["path"].to_numpy()[at] / max(float(_path_norm(t["rows"].iloc[0])), 1e-9)
            yield batch.assign(outlier_score=2.0 ** (-total / max(len(shared.value), 1)))[out]

    rows = complete.select("*", *[v.alias(f"__{n}") for v, n in zip(columns, names)])
    kinds = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, ("outlier_score", "double")])
    scored = materialise(rows.mapInPandas(score, kinds))
    return flag_top_share(scored, "outlier_score", contamination, "is_outlier").drop("cut_off")
