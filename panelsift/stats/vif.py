"""Variance inflation factors and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.columns import c, existing
from panelsift.stats.gram import Gram, gram_matrix, scaled_inverse

# Flag and recommendation from the severest down.
SEVERITY = (
    ("🚨 INFINITE", "MUST REMOVE"),
    ("⚠️ HIGH", "Consider removing"),
    ("⚡ MODERATE", "Monitor"),
    ("✓ OK", "Keep"),
)


def vif_values(gram: Gram) -> list[float]:
    """VIF per column, regressing each on the others without an added constant.

    Where the other columns already span a constant (a full one-hot set), the
    variation around the mean is explained, otherwise the raw sum of squares.
    """
    inverse, redundant, _ = scaled_inverse(gram.products)
    beta = inverse @ gram.sums
    unexplained = gram.n - float(gram.sums @ beta)
    result = []
    for i in range(len(gram.names)):
        if redundant[i] or inverse[i, i] <= 0:
            result.append(math.inf)
            continue
        total = gram.products[i, i]
        without = unexplained + beta[i] ** 2 / inverse[i, i]
        if without < 1e-8 * max(gram.n, 1.0):
            total -= gram.sums[i] ** 2 / gram.n
        result.append(float(total * inverse[i, i]))
    return result


def _gram(df: DataFrame, features: Sequence[str]) -> Gram:
    return gram_matrix(df, {n: c(n) for n in features})


def vif_table(
    spark: SparkSession, gram: Gram, high: float = 10.0, moderate: float = 5.0
) -> DataFrame:
    rows = list(zip(gram.names, vif_values(gram)))
    table = spark.createDataFrame(rows, "feature string, VIF double")
    level = (
        F.when(F.col("VIF") == float("inf"), 0)
        .when(F.col("VIF") > high, 1)
        .when(F.col("VIF") > moderate, 2)
        .otherwise(3)
    )
    words = [F.array(*[F.lit(pair[i]) for pair in SEVERITY]) for i in (0, 1)]
    return table.select(
        "feature",
        "VIF",
        F.element_at(words[0], level + 1).alias("vif_flag"),
        F.element_at(words[1], level + 1).alias("recommendation"),
    ).orderBy(F.col("VIF").desc(), "feature")


def calculate_vif_detailed(
    df: DataFrame,
    feature_cols: Sequence[str],
    vif_threshold_high: float = 10.0,
    vif_threshold_moderate: float = 5.0,
) -> DataFrame:
    gram = _gram(df, feature_cols)
    return vif_table(df.sparkSession, gram, vif_threshold_high, vif_threshold_moderate)


def iterative_vif_removal(
    df: DataFrame,
    feature_cols: Sequence[str],
    vif_threshold: float = 10.0,
    max_iterations: int = 50,
) -> tuple[list[str], list[tuple[str, float]], DataFrame]:
    """Drop the feature with the largest VIF until none exceeds the threshold.

    The data is read once; a removal only deletes a row and column of the matrix.
    Returns the remaining features, the removed ones and the log.
    """
    gram = _gram(df, feature_cols)
    current = list(feature_cols)
    removed: list[tuple[str, float]] = []
    log = []
    for step in range(1, max_iterations + 1):
        if len(current) <= 1:
            break
        values = vif_values(gram.keep(current))
        worst = int(np.argmax(values))
        log.append((step, len(current), current[worst], values[worst]))
        if values[worst] <= vif_threshold:
            break
        removed.append((current.pop(worst), values[worst]))
    schema = "iteration int, n_features int, max_vif_feature string, max_vif double"
    return current, removed, df.sparkSession.createDataFrame(log, schema)


def get_feature_removal_candidates(vif_df: DataFrame, vif_threshold: float = 10.0) -> DataFrame:
    return vif_df.where(F.col("VIF") > vif_threshold).select("feature", "VIF")


def correlated_features(
    df: DataFrame, feature_cols: Sequence[str], threshold: float = 0.8
) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Features kept when the later of each strongly correlated pair is dropped."""
    names = existing(df, feature_cols)
    matrix = _gram(df, names).correlations()
    dropped: dict[str, tuple[str, str, float]] = {}
    for j, later in enumerate(names):
        for i, earlier in enumerate(names[:j]):
            if earlier not in dropped and abs(matrix[i, j]) > threshold:
                dropped[later] = (earlier, later, float(matrix[i, j]))
                break
    return [n for n in names if n not in dropped], list(dropped.values())
