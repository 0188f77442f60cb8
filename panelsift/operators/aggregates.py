"""Respondent- and study-level aggregates. Null keys form no group unless asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, existing
from panelsift.config import STUDY_GROUP_KEYS, SUMMARY_CATEGORIES
from panelsift.operators.skew import salted_join


def aggregate_studies(
    study_map: DataFrame,
    group_cols: Sequence[str] = STUDY_GROUP_KEYS,
    keep_nulls: bool = False,
) -> DataFrame:
    """Study rows per key group: their number and the sum of the study flag."""
    keys = existing(study_map, group_cols)
    rows = study_map if keep_nulls else study_map.dropna(subset=keys)
    return (
        rows.groupBy(*[c(k) for k in keys])
        .agg(
            F.count("uuid").alias("balance_study_count"),
            F.sum("wonky_study_count").alias("wonky_study_count"),
        )
        .withColumnRenamed("respondent_pk", "balance_respondentPk")
    )


def create_study_respondent_summary(
    study_df: DataFrame,
    respondent_id_col: str = "respondent_pk",
    categorical_cols: Sequence[str] | None = None,
    keep_nulls: bool = False,
) -> DataFrame:
    """Tasks and flagged studies per respondent and category combination."""
    cats = existing(study_df, SUMMARY_CATEGORIES if categorical_cols is None else categorical_cols)
    keys = [respondent_id_col, *cats]
    rows = study_df if keep_nulls else study_df.dropna(subset=keys)
    measures = [
        F.count("task_pk").alias("task_pk_count"),
        F.count_distinct("task_pk").alias("task_pk_nunique"),
    ]
    if "uuid" in study_df.columns:
        measures.append(F.count_distinct("uuid").alias("total_wonky_studies"))
    elif "wonky_study_count" in study_df.columns:
        measures.append(F.sum("wonky_study_count").alias("total_wonky_studies"))
    return (
        rows.groupBy(*[c(k) for k in keys])
        .agg(*measures)
        .withColumnRenamed(respondent_id_col, "balance_respondentPk")
    )


def calculate_task_ratio(
    task_completed_df: DataFrame,
    summary_df: DataFrame,
    task_completed_col: str = "task_completed",
    instances_col: str = "total_wonky_studies",
    respondent_id_col: str = "respondentPk_tc",
) -> DataFrame:
    """Share of a respondent's tasks that were in flagged studies, and it capped at 1."""
    totals = task_completed_df.withColumn("__respondent", c(respondent_id_col))
    keyed = summary_df.withColumn("__respondent", F.col("balance_respondentPk"))
    joined = salted_join(keyed, totals, ["__respondent"], "inner").drop("__respondent")
    ratio = F.try_divide(c(instances_col), c(task_completed_col))
    return joined.withColumn("wonky_task_ratio", ratio).withColumn(
        "wonky_task_ratio_cap",
        F.when(
            F.col("wonky_task_ratio").isNotNull(), F.least(F.col("wonky_task_ratio"), F.lit(1.0))
        ),
    )


def distinct_per_key(
    df: DataFrame, key: str, value: str, name: str, approximate: bool = False
) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.where(c(key).isNotNull()).groupBy(c(key)).agg(count(c(value)).alias(name))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row with the number of distinct non-null values of each column."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c(n)).alias(n) for n in columns])
    return df.agg(*[F.count_distinct(c(n)).alias(n) for n in columns])


def aggregate_user_level_proportions(
    df: DataFrame,
    feature_set: Sequence[str],
    group_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
) -> DataFrame:
    """Per user: mean of every flag, share of flagged tasks, and the task count."""
    flagged = F.when(c(group_var) > 0, 1).otherwise(0)
    return (
        df.where(c(user_id_var).isNotNull())
        .groupBy(c(user_id_var))
        .agg(
            F.avg(flagged).alias("group_binary"),
            *[F.avg(c(f)).alias(f) for f in existing(df, feature_set)],
            F.count(F.lit(1)).alias("n_tasks"),
        )
    )


def tasks_and_flags_per_respondent(
    completions: DataFrame, study_map: DataFrame
) -> DataFrame:
    """Completion rows and summed study flags per respondent.

    A completion matched by several study rows counts once per match, as a left
    join would count it. Both sides are combined per (respondent, task) first, so
    the copies are multiplied, not materialised.
    """
    done = completions.groupBy("respondentPk", "taskPk").agg(F.count(F.lit(1)).alias("__rows"))
    study = (
        study_map.where(F.col("respondent_pk").isNotNull() & F.col("task_pk").isNotNull())
        .groupBy(F.col("respondent_pk").alias("respondentPk"), F.col("task_pk").alias("taskPk"))
        .agg(
            F.count(F.lit(1)).alias("__matches"),
            F.sum("wonky_study_count").alias("__flags"),
        )
    )
    joined = done.join(study, ["respondentPk", "taskPk"], "left")
    rows = F.col("__rows") * F.coalesce(F.col("__matches"), F.lit(1))
    return (
        joined.where(F.col("respondentPk").isNotNull())
        .groupBy("respondentPk")
        .agg(
            F.sum(F.when(F.col("taskPk").isNotNull(), rows).otherwise(0)).alias(
                "tasks_completed"
            ),
            F.sum(F.col("__rows") * F.coalesce(F.col("__flags"), F.lit(0))).alias(
                "wonky_study_count"
            ),
        )
    )


def daily_task_counts(
    df: DataFrame,
    respondent,
    respondent_col: str = "respondentPk",
    date_col: str = "date_completed",
    task_col: str = "taskPk",
) -> DataFrame:
    """Tasks per calendar day of one respondent."""
    return (
        df.where(c(respondent_col) == respondent)
        .groupBy(F.to_date(c(date_col)).alias("day"))
        .agg(F.count(c(task_col)).alias("tasks"))
    )


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k largest rows by a column; the limit is the report's size."""
    return df.orderBy(c(by).desc_nulls_last(), *[c(t) for t in ties]).limit(k)


def hash_sample(df: DataFrame, n: int, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Sample of at most n rows by hash order.

    With keys that identify a row the sample does not depend on the partitioning.
    Without keys every row gets a number first, so copies are drawn independently.
    """
    picked = df if keys else df.withColumn("__row", F.monotonically_increasing_id())
    identity = [c(k) for k in keys] or [F.col("__row")]
    order = [F.xxhash64(*identity, F.lit(seed)), *identity]
    return picked.orderBy(*order).limit(n).select(*[c(k) for k in df.columns])


def exposure_and_gender_counts(
    summary: DataFrame,
    user_info_df: DataFrame,
    labels: Sequence[str],
    summary_key: str = "respondentPk",
) -> DataFrame:
    """Distinct respondents per label, exposure band and gender, with their share.

    Only which (respondent, gender, label) and (respondent, band) pairs exist
    matters, so both sides are reduced to those before they meet.
    """
    tagged = F.filter(
        F.array(*[F.when(c(n) == 1, F.lit(n)) for n in labels]), lambda x: x.isNotNull()
    )
    people = user_info_df.select(
        "respondentPk", "gender", F.explode(tagged).alias("label_tags")
    ).distinct()
    bands = summary.select(c(summary_key).alias("respondentPk"), "exposure_band").distinct()
    pairs = bands.join(people, "respondentPk", "inner").dropna(
        subset=["exposure_band", "gender"]
    )
    counts = pairs.groupBy("label_tags", "exposure_band", "gender").agg(
        F.count_distinct("respondentPk").alias("n")
    )
    # labels x bands x genders rows: a handful
    totals = counts.groupBy("exposure_band", "gender").agg(F.sum("n").alias("group_total"))
    return counts.join(totals, ["exposure_band", "gender"]).select(
        "label_tags",
        "exposure_band",
        "gender",
        "n",
        "group_total",
        (F.col("n") / F.col("group_total") * 100).alias("pct"),
    )


def add_study_rows(completions: DataFrame, study_map: DataFrame) -> DataFrame:
    """Completions with the flag of every study row on the same respondent and task."""
    study = study_map.select(
        F.col("respondent_pk").alias("respondentPk"),
        F.col("task_pk").alias("taskPk"),
        "wonky_study_count",
    )
    return salted_join(completions, study, ["respondentPk", "taskPk"], "left")
