"""Effect-size labels, plain-language odds and normal p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lower limits of the small, medium and large labels.
COHENS_D_LIMITS = (0.2, 0.5, 0.8)
ODDS_RATIO_LIMITS = (1.5, 2.5, 4.0)
# Fixed value: 97.5 % point of the normal distribution.
Z_95 = 1.959963984540054


def _label(size: Column, limits: tuple[float, float, float]) -> Column:
    small, medium, large = limits
    return (
        F.when(size < small, "negligible")
        .when(size < medium, "small")
        .when(size < large, "medium")
        .otherwise("large")
    )


def cohens_d_label(d: Column) -> Column:
    return F.when(d.isNull() | F.isnan(d), "undefined").otherwise(_label(F.abs(d), COHENS_D_LIMITS))


def odds_ratio_label(ratio: Column) -> Column:
    """Label of the larger of the ratio and its inverse."""
    size = F.greatest(ratio, F.try_divide(F.lit(1.0), ratio))
    valid = ratio.isNotNull() & ~F.isnan(ratio) & (ratio > 0)
    return F.when(valid, _label(size, ODDS_RATIO_LIMITS)).otherwise("undefined")


def interpret_odds_ratio(ratio: Column) -> Column:
    more = (ratio - 1) * 100
    less = (1 - ratio) * 100
    return (
        F.when(ratio.isNull() | F.isnan(ratio) | (ratio <= 0), "Invalid")
        .when((ratio > 100) | (ratio < 0.01), "⚠️ Extreme")
        .when(F.abs(ratio - 1) < 0.05, "No effect")
        .when(more > 100, F.format_string("↑ %.1fx more likely", ratio))
        .when(ratio > 1, F.format_string("↑ %.0f%% more likely", more))
        .otherwise(F.format_string("↓ %.0f%% less likely", less))
    )


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p-value; applied to result tables with one row per feature."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))
