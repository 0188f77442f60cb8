"""Per-respondent history: newest record, first activity, counts, rating change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.operators.ordered import lagged
from panelsift.operators.skew import HotKeys, attach_per_key

MICROS_PER_DAY = 86_400_000_000


def latest_per_key(df: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """Newest row per key, ties broken by the remaining columns.

    ``max_by`` combines before the shuffle, so neither a sort nor a whole key in
    one task is needed; a null date sorts oldest.
    """
    rest = [n for n in df.columns if n not in keys]
    later = F.struct(c(date_col), *[c(n) for n in rest if n != date_col])
    picked = df.groupBy(*[c(k) for k in keys]).agg(F.max(later).alias("__latest"))
    return picked.select(
        *[(c(n) if n in keys else F.col("__latest").getField(n).alias(n)) for n in df.columns]
    )


def task_seconds(completed: str, created: str):
    """Whole seconds between two timestamps; negative when they are swapped."""
    return F.unix_timestamp(c(completed)) - F.unix_timestamp(c(created))


def enrich_with_task_counts(
    df: DataFrame,
    respondent_col: str = "respondentPk",
    task_col: str = "taskPk",
    completed_col: str = "date_completed",
    created_col: str = "date_created",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``task_time_taken_s`` and the respondent's ``task_completed`` count."""
    timed = df.withColumn("task_time_taken_s", task_seconds(completed_col, created_col))
    return attach_per_key(
        timed, [respondent_col], F.count(c(task_col)).alias("task_completed"), hot=hot
    )


def whole_days(later, earlier):
    """Floored day difference: one hour before counts as -1, not 0."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / MICROS_PER_DAY)


def add_days_active(
    df: DataFrame,
    respondent_col: str = "respondentPk",
    date_col: str = "date_completed",
    first_date_col: str = "date_created",
    first_name: str = "first_task_created",
    name: str = "days_active_before_task",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Days between a respondent's first date and each completion.

    Pass ``first_date_col=date_col`` for the variant counting from the first
    completion.
    """
    first = F.min(c(first_date_col)).alias(first_name)
    dated = attach_per_key(df, [respondent_col], first, hot=hot)
    return dated.withColumn(name, whole_days(c(date_col), c(first_name)))


def add_distinct_count(
    df: DataFrame,
    key: str,
    value: str,
    name: str = "ip_address_count",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Distinct non-null values per key on every row of the key."""
    return attach_per_key(df, [key], F.count_distinct(c(value)).alias(name), hot=hot)


def add_rating_delta(
    df: DataFrame,
    feature: str,
    delta_period: int | str = "max",
    respondent_col: str = "respondentPk",
    date_col: str = "date_completed",
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Change of a rating against ``delta_period`` rows earlier, or the first row.

    Adds ``<feature>_delta``. ``'max'`` compares with the respondent's earliest
    row, which is an aggregate; a row distance needs numbered rows.
    """
    name = f"{feature}_delta"
    order = [date_col, *tie_cols]
    if delta_period == "max":
        earliest = F.min(F.struct(*[c(n) for n in order], c(feature))).getField(feature)
        first = attach_per_key(df, [respondent_col], earliest.alias("__first"))
        return first.withColumn(name, c(feature) - F.col("__first")).drop("__first")
    if not isinstance(delta_period, int) or delta_period < 1:
        raise ValueError("delta_period must be a positive number of rows or 'max'")
    before = lagged(df, feature, delta_period, [respondent_col], [c(n) for n in order], "__before")
    return before.withColumn(name, c(feature) - F.col("__before")).drop("__before")
