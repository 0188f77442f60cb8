"""Multi-feature least squares from one cross-product matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.stats.gram import gram_matrix, scaled_inverse
from panelsift.stats.tests import f_p_value, student_t_p_value
from panelsift.stats.vif import vif_table


@dataclass
class LinearModel:
    intercept: float
    coefficients: dict[str, float]
    n: int
    r2: float
    r2_adjusted: float
    f_statistic: float
    f_p_value: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        fitted = F.lit(self.intercept)
        for feature, b in self.coefficients.items():
            fitted = fitted + c(feature) * F.lit(b)
        return df.withColumn(name, fitted)


def _f_statistic(r2: float, rank: int, freedom: int) -> float:
    """Explained against remaining variance, each per degree of freedom."""
    if math.isnan(r2) or rank < 1 or freedom < 1:
        return math.nan
    return float(r2 / rank / ((1 - r2) / freedom)) if r2 < 1 else math.inf


def build_linear_baseline(
    df: DataFrame,
    feature_cols: Sequence[str],
    outcome_var: str,
    user_id_var: str | None = None,
    calculate_vif: bool = True,
) -> tuple[LinearModel, DataFrame, DataFrame]:
    """Model, coefficient table and VIF table, all from one pass over complete rows.

    Exactly collinear features share their coefficient (minimum-norm solution).
    """
    names = list(feature_cols)
    full = gram_matrix(df, {**{n: c(n) for n in names}, "__y": c(outcome_var)})
    n = full.n
    means = full.sums / n
    centred = full.centred
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    inverse, _, rank = scaled_inverse(xx)
    beta = inverse @ xy
    residual = max(float(yy - beta @ xy), 0.0)
    freedom = n - rank - 1
    variance = residual / freedom if freedom > 0 else math.nan
    errors = np.sqrt(np.clip(np.diag(inverse), 0, None) * variance)
    r2 = 1 - residual / yy if yy > 0 else math.nan
    adjusted = 1 - (1 - r2) * (n - 1) / freedom if freedom > 0 else math.nan
    f = _f_statistic(r2, rank, freedom)
    rows = []
    for name, b, se in zip(names, beta, errors):
        t = float(b / se) if se > 0 else math.nan
        rows.append((name, float(b), float(se), student_t_p_value(t, freedom), t, abs(float(b))))
    schema = (
        "feature string, coefficient double, std_error double, p_value double, "
        "t_stat double, importance double"
    )
    importance = df.sparkSession.createDataFrame(rows, schema).orderBy(
        F.col("importance").desc(), "feature"
    )
    model = LinearModel(
        float(means[-1] - beta @ means[:-1]),
        dict(zip(names, map(float, beta))),
        int(n),
        float(r2),
        float(adjusted),
        f,
        f_p_value(f, rank, freedom),
    )
    if calculate_vif:
        vif = vif_table(df.sparkSession, full.keep(names)).select("feature", "VIF")
    else:
        empty = [(f, None) for f in names]
        vif = df.sparkSession.createDataFrame(empty, "feature string, VIF double")
    return model, importance, vif
