"""Task speed flags against percentile thresholds, overall or per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, flag
from panelsift.operators.ordered import quantiles
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise

# Percentiles standing in for one and two standard deviations.
SPEED_PERCENTILES = {
    "suspiciously_fast": 0.025,
    "fast": 0.16,
    "slow": 0.84,
    "suspiciously_slow": 0.975,
}
# Thresholds in seconds of the older, percentile-free flags.
LEGACY_SUSPICIOUSLY_FAST = 30.0
LEGACY_VERY_FAST = 180.0
LEGACY_VERY_SLOW = 3600.0
DEFAULT_GROUP = "task_length_of_task"


def create_task_speed_features(
    df: DataFrame,
    task_time_col: str = "task_time_taken_s",
    use_std_dev: bool = True,
    group_by_col: str | None = None,
    min_group_size: int = 10,
    approximate: bool = False,
) -> DataFrame:
    """Add minutes, speed flags and, where points exist, points per minute.

    Groups smaller than ``min_group_size`` use the overall thresholds; a group whose
    times are all equal is normal speed throughout. A named group column that does
    not exist means overall thresholds; without a name the task length is used if
    present.
    """
    if task_time_col not in df.columns:
        raise ValueError(f"no column {task_time_col!r}")
    timed = df.withColumn("task_time_minutes", c(task_time_col) / 60)
    if use_std_dev:
        timed = _percentile_flags(timed, task_time_col, group_by_col, min_group_size, approximate)
    else:
        time = c(task_time_col)
        timed = timed.withColumns(
            {
                "is_suspiciously_fast": flag(time < LEGACY_SUSPICIOUSLY_FAST),
                "is_very_fast": flag(time < LEGACY_VERY_FAST),
                "is_very_slow": flag(F.col("task_time_minutes") > LEGACY_VERY_SLOW / 60),
            }
        )
    if "task_points" in df.columns:
        minutes = F.nullif(F.col("task_time_minutes"), F.lit(0.0))
        timed = timed.withColumn("task_points_perMinute", F.col("task_points") / minutes)
    return timed


def _percentile_flags(df, time_col, group_by_col, min_group_size, approximate):
    group = group_by_col or DEFAULT_GROUP
    labelled, levels = df, [F.struct(F.lit(True).alias("all"), F.lit("").alias("group"))]
    grouped = group in df.columns
    if grouped:
        label = F.coalesce(c(group).cast("string"), F.lit("unknown"))
        labelled = df.withColumn("__group", label)
        levels.append(F.struct(F.lit(False).alias("all"), F.col("__group").alias("group")))
    # overall and per-group thresholds from the same pass; the end points tell whether
    # all times of a group are equal
    wanted = {**SPEED_PERCENTILES, "__first": 0.0, "__last": 1.0}
    rows = labelled.select(c(time_col), F.inline(F.array(*levels)))
    cuts = materialise(quantiles(rows, time_col, wanted, ["all", "group"], approximate))
    overall = cuts.where("all").first()
    if overall is None:
        raise ValueError(f"no valid values in {time_col!r}")
    if overall["__first"] == overall["__last"]:
        fixed = {f"is_{name}": F.lit(0) for name in (*SPEED_PERCENTILES, "very_fast")}
        return df.withColumns({**fixed, "is_normal_speed": F.lit(1)})

    everywhere = {name: F.lit(overall[name]) for name in SPEED_PERCENTILES}
    time = c(time_col)
    if not grouped:
        return df.withColumns(_flags(time, everywhere, F.lit(False)))
    limits = cuts.where(~F.col("all")).select(
        F.col("group").alias("__group"),
        F.col("n").alias("__size"),
        (F.col("__first") == F.col("__last")).alias("__constant"),
        *[F.col(name).alias(f"__{name}") for name in SPEED_PERCENTILES],
    )
    joined = lookup_join(labelled, limits, ["__group"], "left")
    small = F.coalesce(F.col("__size"), F.lit(0)) < min_group_size
    own = {
        name: F.when(small, everywhere[name]).otherwise(F.col(f"__{name}"))
        for name in SPEED_PERCENTILES
    }
    constant = ~small & F.col("__constant")
    extra = [n for n in joined.columns if n not in df.columns]
    return joined.withColumns(_flags(time, own, constant)).drop(*extra)


def _flags(time, cut, constant):
    """Strict comparisons outside, a closed interval for normal speed."""
    normal = constant | ((time >= cut["fast"]) & (time <= cut["slow"]))
    return {
        "is_fast": flag(~constant & (time < cut["fast"])),
        "is_suspiciously_fast": flag(~constant & (time < cut["suspiciously_fast"])),
        "is_slow": flag(~constant & (time > cut["slow"])),
        "is_suspiciously_slow": flag(~constant & (time > cut["suspiciously_slow"])),
        "is_normal_speed": flag(time.isNotNull() & normal),
        "is_very_fast": flag(~constant & (time < cut["fast"])),
    }
