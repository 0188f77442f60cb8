"""Contingency, proportion, rank and paired tests from one aggregate each."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsift.columns import c, existing
from panelsift.operators.ordered import running_total
from panelsift.operators.profile import feature_sums, long_metrics
from panelsift.stats.effects import normal_p_value


def contingency(
    df: DataFrame,
    feature_set: Sequence[str],
    group_var: str = "wonky_study_count",
    sparse: str | None = None,
) -> DataFrame:
    """2x2 counts per flag against a positive group value (missing counts as 0).

    ``n11`` counts flag 1 in the group, ``n01`` flag 0 in the group, and so on; a row
    with a missing flag is left out for that flag. One pass for all flags, those of a
    ``sparse`` column included.
    """
    names = existing(df, feature_set)
    inside = F.coalesce(c(group_var) > 0, F.lit(False))
    sums = feature_sums(df, names, inside, sparse)

    def cell(side: bool, count: Column) -> Column:
        return F.sum(F.when(F.col("state") == side, count).otherwise(0)).cast("double")

    on, off = F.col("n1"), F.col("n") - F.col("m") - F.col("n1")
    return sums.groupBy("feature").agg(
        cell(True, on).alias("n11"), cell(False, on).alias("n10"),
        cell(True, off).alias("n01"), cell(False, off).alias("n00"),
    )


def chi_square_tests(
    df: DataFrame,
    feature_set: Sequence[str],
    group_var: str = "wonky_study_count",
    significance_level: float = 0.01,
    sparse: str | None = None,
) -> DataFrame:
    """Pearson chi-square with one degree of freedom, without continuity correction."""
    t = contingency(df, feature_set, group_var, sparse)
    a, b, d, e = (F.col(n) for n in ("n11", "n10", "n01", "n00"))
    margins = (a + b) * (d + e) * (a + d) * (b + e)
    cross = a * e - b * d
    chi = F.try_divide((a + b + d + e) * cross * cross, margins)
    tested = t.withColumn("chi2", chi).withColumn("chi_p_value", normal_p_value(F.sqrt("chi2")))
    return tested.select(
        "feature", "chi2", "chi_p_value",
        F.coalesce(F.col("chi_p_value") < significance_level, F.lit(False)).alias("significant"),
    ).orderBy(F.col("chi2").desc_nulls_last(), "feature")


def two_proportion_z_tests(
    df: DataFrame,
    feature_set: Sequence[str],
    group_var: str = "wonky_study_count",
    significance_level: float = 0.05,
    sparse: str | None = None,
) -> DataFrame:
    """Pooled z-test of the flag's share in the group against the rest."""
    t = contingency(df, feature_set, group_var, sparse)
    inside, outside = F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00")
    p1, p0 = F.try_divide(F.col("n11"), inside), F.try_divide(F.col("n10"), outside)
    pooled = F.try_divide(F.col("n11") + F.col("n10"), inside + outside)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), inside) + F.try_divide(F.lit(1.0), outside)))
    tested = t.select(
        "feature",
        p1.alias("prop_group"),
        p0.alias("prop_rest"),
        (p1 - p0).alias("proportion_diff"),
        F.try_divide(p1 - p0, se).alias("z_statistic"),
    ).withColumn("p_value", normal_p_value("z_statistic"))
    significant = F.coalesce(F.col("p_value") < significance_level, F.lit(False))
    return tested.withColumn("significant", significant).orderBy(
        F.abs(F.col("z_statistic")).desc_nulls_last(), "feature"
    )


def mann_whitney_tests(
    df: DataFrame,
    features: Sequence[str],
    group_var: str = "wonky_study_count",
    significance_level: float = 0.05,
) -> DataFrame:
    """Mann-Whitney U with tie-corrected normal z.

    Ranks are needed per distinct value only, so values are counted first and the
    counts accumulated in value order across partitions.
    """
    grouped = F.coalesce(c(group_var) > 0, F.lit(False)).alias("inside")
    long = long_metrics(df, existing(df, features), [grouped])
    counts = long.groupBy("metric", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n1")
    )
    ranked = running_total(counts, {"cum": F.col("n")}, [F.col("value")], ["metric"])
    n = F.col("n").cast("double")
    rank = F.col("cum") - (n - 1) / 2
    sums = ranked.groupBy("metric").agg(
        F.sum(n).alias("total"),
        F.sum(F.col("n1").cast("double")).alias("m"),
        F.sum(F.col("n1") * rank).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    m, k, total = F.col("m"), F.col("total") - F.col("m"), F.col("total")
    u = F.col("rank_sum") - m * (m + 1) / 2
    variance = m * k / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1)))
    z = F.try_divide(u - m * k / 2, F.sqrt(variance))
    tested = sums.select(F.col("metric").alias("feature"), u.alias("u_statistic"), z.alias("z_statistic"))
    tested = tested.withColumn("p_value", normal_p_value("z_statistic"))
    significant = F.coalesce(F.col("p_value") < significance_level, F.lit(False))
    return tested.withColumn("significant", significant).orderBy(
        F.abs(F.col("z_statistic")).desc_nulls_last(), "feature"
    )


def student_t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t through the incomplete beta function."""
    if math.isnan(t):
        return math.nan
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution; 0 for an infinite statistic."""
    if math.isnan(f):
        return math.nan
    return 0.0 if math.isinf(f) else _incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    f = num = 1.0
    den = 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        den = 1 + term * den
        den = 1 / (den if abs(den) > tiny else tiny)
        num = 1 + term / num
        num = num if abs(num) > tiny else tiny
        change = num * den
        f *= change
        if abs(1 - change) < 1e-14:
            break
    return front * (f - 1) / a


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else student_t_p_value(a, b) for a, b in zip(t, df)],
        dtype="float64",
    )


def selection_bias(
    df: DataFrame,
    safe_col: str = "is_monday",
    risky_col: str = "is_friday",
    min_tasks: int = 5,
    group_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
) -> DataFrame:
    """Paired t-test of users' flagged rates on a safe against a risky day.

    Users need ``min_tasks`` tasks and at least one on each kind of day.
    """
    flagged = F.when(c(group_var) > 0, 1.0).otherwise(0.0)
    users = (
        df.where(c(user_id_var).isNotNull())
        .groupBy(c(user_id_var))
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.avg(F.when(c(safe_col) == 1, flagged)).alias("safe"),
            F.avg(F.when(c(risky_col) == 1, flagged)).alias("risky"),
        )
        .where((F.col("tasks") >= min_tasks) & F.col("safe").isNotNull() & F.col("risky").isNotNull())
    )
    change = F.col("risky") - F.col("safe")
    one = users.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("safe").alias("safe_rate"),
        F.avg("risky").alias("risky_rate"),
        F.avg(change).alias("mean_difference"),
        F.stddev_samp(change).alias("sd"),
    )
    t = F.try_divide(F.col("mean_difference"), F.col("sd") / F.sqrt("n_users"))
    one = one.withColumn("t_statistic", t)
    return one.withColumn(
        "p_value", t_p_value(F.col("t_statistic"), (F.col("n_users") - 1).cast("double"))
    ).drop("sd")


def trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r squared, points."""
    return df.agg(
        F.regr_slope(c(y), c(x)).alias("slope"),
        F.regr_intercept(c(y), c(x)).alias("intercept"),
        F.regr_r2(c(y), c(x)).alias("r2"),
        F.regr_count(c(y), c(x)).alias("points"),
    )


def ordered_by_size(df: DataFrame, statistic: Column | str) -> DataFrame:
    """Largest absolute statistic first."""
    return df.orderBy(F.abs(F.col(statistic) if isinstance(statistic, str) else statistic).desc_nulls_last())
