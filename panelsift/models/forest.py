"""Random forest regression with folds that keep a user's rows together."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models import cells as grown
from panelsift.models.prepare import with_group_folds
from panelsift.session import materialise

OVERFIT_GAP = 0.1  # fixed value
# a task goes through its rows once per level of all trees; more tasks than a few a core add only sums
ROWS_OF_A_TASK = 10_000
TASKS_OF_A_CORE = 4
# rows keep their node of every tree instead of being led down from the root at each level;
# a lineage as long as a tree is deep needs no checkpoints
NODE_CACHE = {"cacheNodeIds": True, "checkpointInterval": -1}


def assembled(
    df: DataFrame, features: Sequence[str], extra: dict[str, object], key: str = "features"
) -> DataFrame:
    """Feature vector of complete rows plus extra columns; names need no escaping."""
    plain = {f"__f{i}": c(n).cast("double") for i, n in enumerate(features)}
    rows = df.select(*[v.alias(n) for n, v in extra.items()], *[v.alias(n) for n, v in plain.items()])
    rows = rows.dropna(subset=[*extra, *plain])
    return VectorAssembler(inputCols=list(plain), outputCol=key).transform(rows).drop(*plain)


def spread(data: DataFrame) -> DataFrame:
    """Stored rows dealt evenly to files, so that every core takes part in a fit.

    Vectors are few bytes, and a small table would be read by one task. Up to
    ROWS_OF_A_TASK rows are one task's work and stay as they are.
    """
    tasks = math.ceil(data.count() / ROWS_OF_A_TASK)
    if tasks <= 1:
        return data
    most = TASKS_OF_A_CORE * data.sparkSession.sparkContext.defaultParallelism
    return materialise(data.repartition(min(tasks, most)))


def fold_rows(
    df: DataFrame, features: Sequence[str], label: Column, user: str, folds: int, carried: Sequence[str] = ()
) -> DataFrame:
    """Label, balanced fold and features ``__f<i>`` of complete rows of known users, stored.

    The rows are stored before their users are dealt, too, as that reads them several times.
    """
    plain = {f"__f{i}": c(n).cast("double") for i, n in enumerate(features)}
    narrow = df.select(
        c(user).alias("__user"), label.alias("label"), *[c(n).alias(f"__c{i}") for i, n in enumerate(carried)],
        *[v.alias(n) for n, v in plain.items()],
    )
    complete = materialise(narrow.dropna(subset=["__user", "label", *plain]))
    kept = [F.col(f"__c{i}").alias(n) for i, n in enumerate(carried)]
    return materialise(with_group_folds(complete, "__user", folds).select("label", "fold", *plain, *kept))


def vectors(rows: DataFrame, width: int, carried: Sequence[str] = ()) -> DataFrame:
    """Stored rows of :func:`fold_rows`, in many tasks, with one vector for their features.

    The vector is made when it is read: plain columns are smaller and read faster.
    """
    plain = [f"__f{i}" for i in range(width)]
    data = VectorAssembler(inputCols=plain, outputCol="features").transform(spread(rows))
    return data.select("label", "fold", "features", *[c(n) for n in carried])


def folded(
    df: DataFrame, features: Sequence[str], label: Column, user: str, folds: int, carried: Sequence[str] = ()
) -> DataFrame:
    """Vectors of complete rows of known users, label and balanced fold, read in many tasks."""
    return vectors(fold_rows(df, features, label, user, folds, carried), len(features), carried)


def cells_of(rows: DataFrame, width: int) -> tuple[grown.Cells | None, DataFrame]:
    """Cells of the rows of :func:`fold_rows`, None if too many; and the rows with bins ``__b<i>``."""
    plain, bins = [f"__f{i}" for i in range(width)], [f"__b{i}" for i in range(width)]
    cuts = grown.candidate_cuts(rows, plain)
    binned = grown.binned(rows, plain, cuts, bins)
    return grown.count_cells(binned, bins, cuts), binned


def regression_metrics(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R squared, mean squared and mean absolute error, in one aggregate."""
    error = F.col("label") - F.col("prediction")
    return predicted.groupBy(*[c(n) for n in by]).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("label") * F.count(F.lit(1)))).alias("r2"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
    )


@dataclass
class ForestFit:
    model: RandomForestRegressionModel
    importance: DataFrame
    cv_scores: DataFrame
    best_fold: int
    overfit_gap: float
    possible_overfit: bool


def build_random_forest_model(
    df: DataFrame,
    feature_cols: Sequence[str],
    outcome_var: str,
    user_id_var: str,
    n_estimators: int = 100,
    max_depth: int = 10,
    n_splits: int = 5,
    min_leaf: int = 10,
    seed: int = 42,
) -> ForestFit:
    """One forest per fold, scored on the fold left out; the best one is returned.

    A minimum leaf of 10 implies the minimum split of 20. Trees are grown on counted cells
    of the rows, all trees of all folds at once; on the rows where there are too many cells.
    """
    names = list(feature_cols)
    spark = df.sparkSession
    rows = fold_rows(df, names, c(outcome_var).cast("double"), user_id_var, n_splits)
    grower = RandomForestRegressor(
        numTrees=n_estimators,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all",
        seed=seed,
        **NODE_CACHE,
    )

    if rows.select("fold").distinct().count() < 2:
        raise ValueError("complete rows of at least two users are needed")
    cells, _ = cells_of(rows, len(names))
    if cells is None:
        model, scores, best = _grown_on_rows(vectors(rows, len(names)), grower, n_splits)
    else:
        model, scores, best = _grown_on_cells(spark, cells, grower)
    gap = sum(s[1] - s[2] for s in scores if s[2] is not None) / len(scores)
    schema = "fold int, train_r2 double, test_r2 double, test_mse double, test_mae double"
    return ForestFit(
        model,
        importance_table(spark, names, model),
        spark.createDataFrame(scores, schema),
        best,
        gap,
        gap > OVERFIT_GAP,
    )


def _grown_on_rows(data: DataFrame, grower: RandomForestRegressor, n_splits: int):
    """Best model, scores and best fold by MLlib, whose tasks hold rows instead of cells.

    Two folds are fitted at a time and only the best model is kept: the driver holds the
    trees of each fit.
    """

    def fit_fold(fold: int):
        fitted = grower.fit(data.where(F.col("fold") != fold))
        predicted = fitted.transform(data).withColumn("test", F.col("fold") == fold)
        return fitted, {r.test: r for r in regression_metrics(predicted, ["test"]).collect()}

    scores, best, model, top = [], 0, None, None
    with ThreadPool(2) as pool:
        fits = pool.imap(inheritable_thread_target(data.sparkSession)(fit_fold), range(n_splits))
        for fold, (made, by_side) in enumerate(fits):
            train, test = by_side.get(False), by_side.get(True)
            if test is None:  # a fold without users has nothing to score
                continue
            scores.append((fold, train.r2, test.r2, test.mse, test.mae))
            if model is None or _or_least(test.r2) > _or_least(top):
                best, model, top = fold, made, test.r2
            del made
    return model, scores, best


def _grown_on_cells(spark, cells: grown.Cells, grower: RandomForestRegressor):
    """Best model, scores and best fold of forests grown on cells, every fold's at once."""
    folds = np.unique(cells.fold).tolist()  # a fold without users has nothing to score
    forests = grown.regression_forests(
        spark, cells, folds, grower.getNumTrees(), grower.getMaxDepth(), grower.getMinInstancesPerNode(),
        grower.getSeed(),
    )
    scores = []
    for fold, values in zip(folds, grown.forest_values(spark, cells, forests, "variance")):
        predicted, held_out = values[cells.at], cells.fold == fold
        train, test = (
            counted_metrics(cells.label[side], predicted[side], cells.n[side]) for side in (~held_out, held_out)
        )
        scores.append((fold, train[0], *test))
    best = max(range(len(folds)), key=lambda i: _or_least(scores[i][2]))
    return grown.as_model(spark, forests[best], cells.cuts, grower), scores, folds[best]


def counted_metrics(label: np.ndarray, predicted: np.ndarray, n: np.ndarray) -> tuple[float | None, float, float]:
    """R squared, mean squared and mean absolute error of cells with n rows each."""
    rows, error = int(n.sum()), label - predicted
    squared = float(n @ (error * error))
    around = float(n @ (label - n @ label / rows) ** 2)
    return 1 - squared / around if around > 0 else None, squared / rows, float(n @ np.abs(error)) / rows


def _or_least(score: float | None) -> float:
    return float("-inf") if score is None else score


def importance_table(spark, names: Sequence[str], model) -> DataFrame:
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = spark.createDataFrame(rows, "feature string, rf_importance double")
    return table.withColumn("rf_importance_pct", F.round(F.col("rf_importance") * 100, 2)).orderBy(
        F.col("rf_importance").desc(), "feature"
    )
