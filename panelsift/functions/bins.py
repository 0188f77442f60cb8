"""Threshold, bin and score flags; every flag is 0 for a missing value unless said."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, flag

COMPARISONS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}
# Right-closed task-count bins, the first one closed at 0 as well.
TASK_AMOUNT_BINS = (
    ("total_tasks_1_10", 0, 10),
    ("total_tasks_11_25", 10, 25),
    ("total_tasks_26_75", 25, 75),
    ("total_tasks_76_125", 75, 125),
    ("total_tasks_126_175", 125, 175),
    ("total_tasks_176_225", 175, 225),
    ("total_tasks_226_plus", 225, None),
)
# Tenure bins of the feature pipeline and of the older variant.
TENURE_BINS = (2, 10, 20, 30, 50, 75, 100, 125, 150, 200, 250)
OLDER_TENURE_BINS = (2, 7, 14, 21, 28, 31, 50)


def create_threshold_features(
    df: DataFrame, column: str, thresholds: Sequence[tuple[str, str, float]]
) -> DataFrame:
    """One flag per (name, comparison, value); ``!=`` is 1 for a missing value."""
    flags = {}
    for name, op, value in thresholds:
        if op not in COMPARISONS:
            raise ValueError(f"unknown comparison {op!r}, use one of {list(COMPARISONS)}")
        test = COMPARISONS[op](c(column), F.lit(value))
        flags[name] = flag(test | c(column).isNull()) if op == "!=" else flag(test)
    return df.withColumns(flags) if flags else df


def create_score_features(
    df: DataFrame,
    column: str,
    perfect_value: float = 100,
    thresholds: Sequence[float] = (90, 75, 50, 30),
) -> DataFrame:
    wanted = [(f"{column}={int(perfect_value)}", "==", perfect_value)]
    wanted += [(f"{column}<{t}", "<", t) for t in thresholds]
    return create_threshold_features(df, column, wanted)


def create_delta_category_features(
    df: DataFrame, delta_column: str, prefix: str | None = None, large_threshold: float = 50
) -> DataFrame:
    """Overlapping sign and size flags of a change."""
    p = f"{delta_column}_" if prefix is None else prefix
    return create_threshold_features(
        df,
        delta_column,
        [
            (f"{p}LargePositive", ">", large_threshold),
            (f"{p}Positive", ">", 0),
            (f"{p}Neutral", "==", 0),
            (f"{p}LargeNegative", "<", -large_threshold),
            (f"{p}Negative", "<", 0),
        ],
    )


def binned_flags(
    column: str,
    bins: Sequence[float],
    prefix: str,
    include_ge_last: bool = True,
    include_mutually_exclusive: bool = False,
) -> dict[str, Column]:
    value = c(column)
    flags = {f"{prefix}<{b}": flag(value < b) for b in bins}
    if include_ge_last and bins:
        flags[f"{prefix}>={bins[-1]}"] = flag(value >= bins[-1])
    if include_mutually_exclusive:
        # made for whole numbers: a bin starts one above the previous bound
        low = 0
        for high in bins:
            flags[f"{prefix}{low}_to_{high}"] = flag(value.between(low, high))
            low = high + 1
        if bins:
            flags[f"{prefix}{low}_plus"] = flag(value >= low)
        else:
            flags[f"{prefix}1_plus"] = flag(value >= 1)
    return flags


def create_binned_features(
    df: DataFrame,
    column: str,
    bins: Sequence[float],
    prefix: str | None = None,
    include_ge_last: bool = True,
    include_mutually_exclusive: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Cumulative ``<b`` flags, a ``>=last`` flag and, on request, disjoint bins."""
    p = f"{column}_" if prefix is None else prefix
    flags = binned_flags(column, bins, p, include_ge_last, include_mutually_exclusive)
    return (df.withColumns(flags) if flags else df), list(flags)


def create_task_amount_features(
    df: DataFrame, task_col: str = "task_completed"
) -> tuple[DataFrame, list[str]]:
    """Seven disjoint flags of the task count."""
    value = c(task_col)
    flags = {}
    for label, low, high in TASK_AMOUNT_BINS:
        test = (value >= low) if low == 0 else (value > low)
        flags[label] = flag(test if high is None else test & (value <= high))
    return df.withColumns(flags), list(flags)


def round_to_tens(column: str) -> Column:
    """Nearest ten as an integer, halves to the even ten."""
    return F.bround(c(column), -1).cast("int")


def cap_at_one(column: str) -> Column:
    """Upper cap at 1 that keeps a missing value missing."""
    return F.when(c(column).isNotNull(), F.least(c(column), F.lit(1.0)))
