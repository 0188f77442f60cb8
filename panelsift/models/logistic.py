"""Regularised logistic regression with user-wise cross-validation and Wald tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models.forest import fold_rows, vectors
from panelsift.models.prepare import Scaler, fit_scaler
from panelsift.session import materialise
from panelsift.stats.gram import gram_matrix, scaled_inverse


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives, and the scores made from them.

    A score without any case to count is 0.
    """
    label, guess = F.col("label") == 1, F.col("prediction") == 1
    counts = predicted.groupBy(*[c(n) for n in by]).agg(
        F.count_if(label & guess).alias("tp"),
        F.count_if(~label & guess).alias("fp"),
        F.count_if(label & ~guess).alias("fn"),
        F.count_if(~label & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def area_under_roc(predicted: DataFrame, score_col: str = "rawPrediction") -> float | None:
    """Exact area under the ROC curve; None when only one class is present."""
    if predicted.select("label").distinct().count() < 2:
        return None
    evaluator = BinaryClassificationEvaluator(rawPredictionCol=score_col, numBins=0)
    return float(evaluator.evaluate(predicted))


@dataclass
class LogisticFit:
    model: LogisticRegressionModel
    scaler: Scaler
    importance: DataFrame
    cv_scores: DataFrame


def build_logistic_regression_model(
    df: DataFrame,
    feature_cols: Sequence[str],
    outcome_var: str,
    user_id_var: str,
    significance_level: float = 0.05,
    regularization_C: float = 1.0,
    n_splits: int = 5,
) -> LogisticFit:
    """Fit on standardised features; coefficients are given per original unit.

    The Wald covariance needs the weighted cross products of the features only,
    one k x k aggregate, not a matrix over the rows.
    """
    names = list(feature_cols)
    spark = df.sparkSession
    complete = df.where(c(user_id_var).isNotNull()).dropna(subset=names)
    scaler = fit_scaler(complete, names, "standard")
    # scaled under plain names so that any feature name works in the vectors
    label = F.when(F.coalesce(c(outcome_var) > 0, F.lit(False)), 1.0).otherwise(0.0)
    scaled = {
        f"s{i}": (c(n).cast("double") - F.lit(scaler.shift[n])) / F.lit(scaler.width[n])
        for i, n in enumerate(names)
    }
    rows = complete.select("*", label.alias("__label"), *[v.alias(f"__{n}") for n, v in scaled.items()])
    dealt = fold_rows(rows, [f"__{n}" for n in scaled], F.col("__label"), user_id_var, n_splits)
    data = vectors(dealt, len(names))
    sizes = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
    if len(sizes) < 2:
        raise ValueError("complete rows of at least two users are needed")

    def learner(n: int) -> LogisticRegression:
        return LogisticRegression(
            regParam=1.0 / (regularization_C * n),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=1000,
            tol=1e-6,
        )

    total = sum(sizes.values())
    model = learner(total).fit(data)
    scores = []
    for fold in sorted(sizes):
        trained = learner(total - sizes[fold]).fit(data.where(F.col("fold") != fold))
        predicted = trained.transform(data).withColumn("test", F.col("fold") == fold)
        sides = {r.test: r for r in confusion(predicted, ["test"]).collect()}
        test = sides[True]
        scores.append(
            (fold, test.accuracy, test.precision, test.recall, test.f1,
             area_under_roc(predicted.where("test")), sides[False].accuracy)
        )
    cv = spark.createDataFrame(
        scores,
        "fold int, accuracy double, precision double, recall double, f1 double, "
        "auc double, train_accuracy double",
    )
    importance = _wald(model, dealt, scaler, names, significance_level)
    return LogisticFit(model, scaler, importance, cv)


def _wald(
    model: LogisticRegressionModel,
    rows: DataFrame,
    scaler: Scaler,
    names: list[str],
    significance_level: float,
) -> DataFrame:
    """Coefficients, odds ratios and two-sided normal p-values, from the plain rows of the fit.

    The chance is an expression, as a model's own column would be made anew for each product.
    """
    plain = [f"__f{i}" for i in range(len(names))]
    margin = F.lit(float(model.intercept))
    for n, b in zip(plain, model.coefficients.toArray().tolist()):
        margin = margin + F.col(n) * F.lit(b)
    chance = rows.select(*plain, (1 / (1 + F.exp(-margin))).alias("p"))
    weighted = chance.select(*plain, F.sqrt(F.col("p") * (1 - F.col("p"))).alias("w"))
    columns = {n: F.col(x) * F.col("w") for n, x in zip(names, plain)}
    inverse, redundant, _ = scaled_inverse(gram_matrix(weighted, columns).products)
    spark = rows.sparkSession
    widths = np.array([scaler.width[n] for n in names])
    coefs = model.coefficients.toArray() / widths
    errors = np.sqrt(np.clip(np.diag(inverse), 0, None)) / widths
    if redundant.any():  # a singular matrix has no Wald covariance
        errors = np.full(len(names), math.nan)
    rows = []
    for name, b, se in zip(names, coefs, errors):
        z = float(b / se) if se > 0 else math.nan
        value = math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan
        ratio = math.exp(b) if b < 700 else math.inf
        rows.append(
            (name, float(b), ratio, float(se), z, value, value < significance_level, abs(float(b)))
        )
    schema = (
        "feature string, lr_coefficient double, lr_odds_ratio double, lr_std_error double, "
        "lr_z_stat double, lr_p_value double, lr_significant boolean, lr_importance double"
    )
    return spark.createDataFrame(rows, schema).orderBy(
        F.col("lr_importance").desc(), "feature"
    )
