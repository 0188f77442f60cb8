"""Profiles of flagged against other rows. Text is made from the small results only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, existing, numeric_columns
from panelsift.functions.sparse import TYPE
from panelsift.operators.ordered import quantiles, running_total, value_counts
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise

# Features and display names of the speed breakdown, and chart names.
SPEED_LABELS = {
    "is_suspiciously_fast": "Suspiciously fast tasks (2 std dev below mean)",
    "is_fast": "Fast tasks (1 std dev below mean)",
    "is_normal_speed": "Normal speed tasks (within 1 std dev of mean)",
    "is_slow": "Slow tasks (1 std dev above mean)",
    "is_suspiciously_slow": "Suspiciously slow tasks (2 std dev above mean)",
}
CHART_LABELS = {
    "is_weekend": "Weekend tasks",
    "is_night": "Night tasks (10 PM - 6 AM)",
    "is_business_hour": "Business hour tasks (9 AM - 5 PM)",
    "is_business_hour_weekday": "Business hour tasks weekday",
    "is_business_hour_weekend": "Business hour tasks weekend",
}


def display_name(feature: str, labels: Mapping[str, str] | None = None) -> str:
    return (labels or {}).get(feature, feature.replace("_", " ").title())


def sparse_entries(features: Sequence[str], sparse: str | None = None) -> Column:
    """Array of (``i``, ``x``): a base entry, then each feature that is missing or not 0.

    The values go into one array and the rest is done on its elements, which keeps
    the plan small for hundreds of features. ``i`` is the feature's position, -1 for the
    base; with a ``sparse`` column, whose entries follow, it is its name, empty for the
    base.
    """
    nothing = F.lit(None).cast("double")
    values = F.array(*[c(n).cast("double") for n in features]).cast("array<double>")
    names = F.array(*[F.lit(n) for n in features])

    def numbered(x: Column, i: Column) -> Column:
        key = i if sparse is None else F.element_at(names, i + 1)
        return F.struct(key.alias("i"), F.nanvl(x, nothing).alias("x"))

    entries = [F.transform(values, numbered)] if features or sparse is None else []
    if sparse is not None:
        listed = F.coalesce(c(sparse), F.array().cast(TYPE))
        entries.append(
            F.transform(listed, lambda e: F.struct(e["feature"].alias("i"), F.nanvl(e["x"], nothing).alias("x")))
        )
    kept = [F.filter(es, lambda e: e["x"].isNull() | (e["x"] != 0)) for es in entries]
    base = F.struct(F.lit(-1 if sparse is None else "").alias("i"), F.lit(0.0).alias("x"))
    return F.concat(F.array(base), *kept)


def feature_sums(
    df: DataFrame, features: Sequence[str], state: Column, sparse: str | None = None
) -> DataFrame:
    """Per feature and row state: rows, missing values, sum and number of ones.

    Flags are mostly 0, so a row yields one base entry and one entry per feature
    that is missing or not 0. They are combined per (feature, state) before the
    shuffle; a wide aggregate over hundreds of features would leave generated code.
    The few sums are stored, so the rows are read once.
    Columns: ``feature``, ``i`` (its position, null for one of the ``sparse`` column,
    all of which follow the named ones), ``state``, ``n``, ``m``, ``s``, ``n1``.
    """
    found = materialise(
        df.select(state.alias("state"), F.inline(sparse_entries(features, sparse)))
        .groupBy("i", "state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("x").isNull()).alias("m"),
            F.sum("x").alias("s"),
            F.count_if(F.col("x") == 1).alias("n1"),
        )
    )
    at_base = F.col("i") == (F.lit(-1) if sparse is None else F.lit(""))
    # the states of the rows are few; each feature gets a row for each of them
    states = found.where(at_base).agg(F.collect_list(F.struct("state", "n")).alias("all")).select("all").scalar()
    sums = found.where(~at_base).groupBy("i").agg(
        F.collect_list(F.struct("state", "m", "s", "n1")).alias("own")
    )
    names = [(n, k) for k, n in enumerate(features)]
    listed = df.sparkSession.createDataFrame(names, "feature string, position int")
    if sparse is None:
        sums = listed.join(sums, listed.position == sums.i, "left").drop("i")
    else:
        # named columns that are 0 everywhere are there too
        sums = listed.join(sums, F.col("feature") == F.col("i"), "full_outer")
        sums = sums.withColumn("feature", F.coalesce("feature", "i")).drop("i")
    every = sums.select("feature", F.col("position").alias("i"), "own", F.explode(states).alias("base"))
    own = F.get(F.filter("own", lambda e: e["state"].eqNullSafe(F.col("base.state"))), F.lit(0))
    return every.withColumn("o", own).select(
        "feature",
        "i",
        F.col("base.state").alias("state"),
        F.col("base.n").alias("n"),
        *[F.coalesce(F.col(f"o.{n}"), F.lit(0)).alias(n) for n in ("m", "n1")],
        F.coalesce(F.col("o.s"), F.lit(0.0)).alias("s"),
    )


def breakdown(
    df: DataFrame,
    features: Sequence[str],
    group_col: str = "wonky_study_count",
    group_threshold: float = 0,
    labels: Mapping[str, str] | None = None,
    sparse: str | None = None,
) -> DataFrame:
    """Percentage of 1s per feature: all rows, flagged rows, other rows, difference.

    "Other" means a missing group value if any is missing, else a value of 0. One
    pass over the data whatever the number of features. An empty side counts as 0
    percent; a side whose values are all missing stays null. With a ``sparse`` column
    all its features are profiled as well; they have no position.
    """
    names = existing(df, features)
    if group_col not in df.columns:
        raise ValueError(f"no column {group_col!r}")
    if not names and sparse is None:
        raise ValueError("none of the features exist")
    group = c(group_col)
    # a value can be flagged and zero at once when the threshold is negative
    bits = {1: group > group_threshold, 2: group == 0, 4: group.isNull()}
    state = sum((F.when(test, bit).otherwise(0) for bit, test in bits.items()), F.lit(0))
    sums = feature_sums(df, names, state, sparse)

    def within(bit: int, value: Column) -> Column:
        return F.sum(F.when(F.col("state").bitwiseAND(bit) > 0, value))

    known = F.col("n") - F.col("m")
    totals = sums.groupBy("feature", "i").agg(
        F.try_divide(F.sum("s"), F.sum(known)).alias("all"),
        *[F.coalesce(within(bit, F.col("n")), F.lit(0)).alias(f"n{bit}") for bit in bits],
        *[F.try_divide(within(bit, F.col("s")), within(bit, known)).alias(f"p{bit}") for bit in bits],
    )
    missing = F.col("n4") > 0
    group_share = F.when(F.col("n1") > 0, F.col("p1")).otherwise(0.0)
    other = F.when(missing, F.col("p4")).when(F.col("n2") > 0, F.col("p2")).otherwise(0.0)

    spelled = F.initcap(F.translate("feature", "_", " "))
    shown = [F.lit(display_name(n, labels)) for n in names]
    label = F.coalesce(F.get(F.array(*shown), F.col("i")), spelled) if shown else spelled
    return totals.select(
        F.col("i").alias("position"),
        "feature",
        label.alias("label"),
        (F.col("all") * 100).alias("all_pct"),
        (group_share * 100).alias("group_pct"),
        (other * 100).alias("other_pct"),
        ((group_share - other) * 100).alias("delta_pct"),
        F.when(missing, "missing").otherwise("zero").alias("other_means"),
    )


def create_breakdown_summary(
    df: DataFrame,
    features: Sequence[str],
    group_col: str = "wonky_study_count",
    group_threshold: float = 0,
) -> str:
    return _as_text("features created:", breakdown(df, features, group_col, group_threshold),
                    group_col, group_threshold)


def create_task_speed_breakdown_summary(
    df: DataFrame, group_col: str = "wonky_study_count", group_threshold: float = 0
) -> str:
    rows = breakdown(df, list(SPEED_LABELS), group_col, group_threshold, SPEED_LABELS)
    return _as_text("Task speed features breakdown:", rows, group_col, group_threshold)


def _as_text(title: str, rows: DataFrame, group_col: str, threshold: float) -> str:
    lines = [title]
    for r in rows.orderBy("position").collect():  # one row per requested feature
        other = f"{group_col} is NaN" if r.other_means == "missing" else f"{group_col} = 0"
        lines += [
            f"  - {r.label}: {r.all_pct:.1f}%",
            f"    * All tasks: {r.all_pct:.1f}%",
            f"    * Wonky study tasks ({group_col} > {threshold}): {r.group_pct:.1f}%",
            f"    * Non-wonky study tasks ({other}): {r.other_pct:.1f}%",
            f"    * Delta (wonky - non-wonky): {r.delta_pct:+.1f}%",
        ]
    return "\n".join(lines)


def task_speed_breakdown(
    df: DataFrame, group_col: str = "wonky_study_count", group_threshold: float = 0
) -> DataFrame:
    return breakdown(df, list(SPEED_LABELS), group_col, group_threshold, SPEED_LABELS)


def calculate_temporal_feature_deltas(
    df: DataFrame,
    temporal_features: Sequence[str],
    group_col: str = "wonky_study_count",
    group_threshold: float = 0,
) -> DataFrame:
    return breakdown(df, temporal_features, group_col, group_threshold).select(
        "feature", "delta_pct"
    )


def breakdown_chart_data(
    df: DataFrame,
    features: Sequence[str],
    group_col: str = "wonky_study_count",
    group_threshold: float = 0,
) -> DataFrame:
    """Label, difference and both percentages, smallest difference first."""
    rows = breakdown(df, features, group_col, group_threshold, CHART_LABELS)
    return rows.select(
        F.col("label").alias("feature"),
        F.col("delta_pct").alias("delta"),
        F.col("group_pct").alias("wonky_pct"),
        F.col("other_pct").alias("non_wonky_pct"),
    ).orderBy("delta", "feature")


def long_metrics(df: DataFrame, metrics: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """(kept columns, ``metric``, ``value``) for the non-missing values of the metrics."""
    if not metrics:
        raise ValueError("no metrics")
    values = F.array(*[c(m).cast("double") for m in metrics])
    long = df.select(*keep, F.posexplode(values).alias("__i", "value"))
    known = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    name = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("__i") + 1)
    kept = [n for n in long.columns if n not in ("__i", "value")]
    return known.select(*[c(n) for n in kept], name.alias("metric"), "value")


def create_feature_breakdown_table(
    df: DataFrame,
    feature_col: str,
    group_col: str,
    group1_value=1,
    group2_value=0,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Mean, median, deviation and count of metrics in two groups, and differences.

    Without ``metrics`` every numeric column but the two named ones is used. A
    metric with no values in one of the groups is left out. Moments and medians
    come from the same value counts.
    """
    if metrics is None:
        metrics = [m for m in numeric_columns(df) if m not in (feature_col, group_col)]
    names = existing(df, metrics)
    side = F.when(c(group_col) == group1_value, 1).when(c(group_col) == group2_value, 2)
    long = long_metrics(df, names, [side.alias("side")]).where(F.col("side").isNotNull())
    moments = long.groupBy("metric", "side").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count("value").alias("count"),
    )
    medians = quantiles(long, "value", {"median": 0.5}, ["metric", "side"]).drop("n")
    both = moments.join(medians, ["metric", "side"])
    pivoted = both.groupBy("metric").pivot("side", [1, 2]).agg(
        F.first("mean").alias("mean"),
        F.first("median").alias("median"),
        F.first("std").alias("std"),
        F.first("count").alias("count"),
    )
    return pivoted.where(F.col("1_count").isNotNull() & F.col("2_count").isNotNull()).select(
        "metric",
        *[F.col(f"1_{m}").alias(f"wonky_{m}") for m in ("mean", "median", "std", "count")],
        *[F.col(f"2_{m}").alias(f"non_wonky_{m}") for m in ("mean", "median", "std", "count")],
        (F.col("1_mean") - F.col("2_mean")).alias("mean_difference"),
        (F.col("1_median") - F.col("2_median")).alias("median_difference"),
    )


def winsorise_upper(
    df: DataFrame, column: str, probability: float = 0.95, name: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Replace values not below the overall quantile by it; missing values too."""
    cut = quantiles(df, column, {"q": probability}, approximate=approximate).select("q").scalar()
    value = c(column).cast("double")
    capped = F.when(value < cut, value).otherwise(cut)
    return df.withColumn(name or f"{column}_capped", capped)


def trimmed_moments(
    df: DataFrame, column: str, low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Mean and deviation after pulling values in to two quantiles."""
    cut = quantiles(df, column, {"low": low, "high": high})
    bounds = cut.select(F.struct("low", "high")).scalar()
    clipped = F.greatest(
        F.least(c(column).cast("double"), bounds.getField("high")), bounds.getField("low")
    )
    return (
        df.where(c(column).isNotNull())
        .agg(F.avg(clipped).alias("trimmed_mean"), F.stddev_samp(clipped).alias("trimmed_std"))
    )


def distribution(
    df: DataFrame, column: str, missing_label: str | None = None, cumulative: bool = True
) -> DataFrame:
    """Rows per value, their share of all rows and the running share by value.

    Without a label missing values form no row but still count in the total.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df
    if missing_label is not None:
        rows = df.withColumn(column, F.coalesce(c(column).cast("string"), F.lit(missing_label)))
    counts = value_counts(rows, column)
    if cumulative:
        counts = running_total(counts, {"__cum": F.col("n")}, [c(column)])
    shares = [(F.col("n") / total).alias("share")]
    if cumulative:
        shares.append((F.col("__cum") / total).alias("cumulative_share"))
    return counts.select(c(column), "n", *shares)


def compare_distributions(
    df: DataFrame, column: str, groups: Mapping[str, Column], base: str, other: str
) -> DataFrame:
    """Percent of each group's rows per value, 0 where absent, and other - base."""
    tested = df.select(c(column), *[F.coalesce(w, F.lit(False)).alias(f"__{g}") for g, w in groups.items()])
    sizes = tested.agg(*[F.count_if(F.col(f"__{g}")).alias(g) for g in groups])
    size = sizes.select(F.struct(*[c(g) for g in groups])).scalar()
    counts = (
        tested.where(c(column).isNotNull())
        .groupBy(c(column))
        .agg(*[F.count_if(F.col(f"__{g}")).alias(f"__n_{g}") for g in groups])
    )
    shares = {
        g: F.coalesce(
            F.try_divide(F.col(f"__n_{g}") * 100, size.getField(g)), F.lit(0.0)
        )
        for g in groups
    }
    present = F.greatest(*[F.col(f"__n_{g}") for g in groups], F.lit(0)) > 0
    return (
        counts.where(present)
        .select(c(column), *[s.alias(g) for g, s in shares.items()])
        .withColumn("delta", c(other) - c(base))
    )


def distribution_by_group(df: DataFrame, column: str, groups: Sequence[str]) -> DataFrame:
    """Percent per value within each combination of the grouping columns."""
    rows = df.dropna(subset=list(groups))
    counts = rows.groupBy(*[c(g) for g in groups], c(column)).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*[c(g) for g in groups]).agg(F.sum("n").alias("group_rows"))
    return (
        lookup_join(counts.where(c(column).isNotNull()), sizes, groups, "inner")
        .withColumn("percent", F.col("n") / F.col("group_rows") * 100)
    )


def equal_width_histogram(
    df: DataFrame, column: str, flag_col: str, bins: int = 120
) -> DataFrame:
    """Right-closed bins from 0 to the maximum: rows, any flag, percent, centre.

    The first bin also holds 0. All bins are listed, those without rows with count 0 and
    no flag; where every value is 0, all rows are in the first.
    """
    top = df.agg(F.max(c(column)).cast("double")).scalar()
    known = df.where(c(column).isNotNull() & (c(column) >= 0)).withColumn("__top", top)
    width = F.col("__top") / bins
    index = F.greatest(F.coalesce(F.ceil(F.try_divide(c(column), width)).cast("int"), F.lit(1)), F.lit(1))
    counted = known.groupBy(F.least(index, F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.max(c(flag_col)).alias("wonky_any"), F.max("__top").alias("__top")
    )
    # one row per bin from here on
    facts = counted.agg(F.sum("count").alias("__total"), F.max("__top").alias("__top"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    listed = every.join(F.broadcast(counted.drop("__top")), "bin", "left").crossJoin(F.broadcast(facts))
    count = F.coalesce("count", F.lit(0).cast("bigint"))
    return listed.select(
        "bin",
        count.alias("count"),
        "wonky_any",
        (F.try_divide(count, F.col("__total")) * 100).alias("percent"),
        ((F.col("bin") - 0.5) * F.col("__top") / bins).alias("bin_center"),
    )


def exposure_share(
    df: DataFrame, features: Sequence[str], exposure_col: str = "exposure_band",
    exposed: str = "exposed", control: str = "control",
) -> DataFrame:
    """Per flag: its sum in both exposure bands over all rows, and the difference."""
    names = existing(df, features)
    band = c(exposure_col)
    side = F.when(band == exposed, "exposed").when(band == control, "control").otherwise("none")
    totals = feature_sums(df, names, side).groupBy("feature").agg(
        F.sum("n").alias("rows"),
        *[F.sum(F.when(F.col("state") == n, F.col("s")).otherwise(0.0)).alias(n) for n in ("exposed", "control")],
    )
    return totals.select(
        "feature",
        (F.col("control") / F.col("rows")).alias("control"),
        (F.col("exposed") / F.col("rows")).alias("exposed"),
        ((F.col("exposed") - F.col("control")) / F.col("rows")).alias("delta"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values and coverage per column, in one pass."""
    names = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.col(f"m{i}").alias("null_count"),
                (1 - F.try_divide(F.col(f"m{i}"), F.col("rows"))).alias("coverage"),
            )
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.inline(rows))


def describe(
    df: DataFrame, columns: Sequence[str], by: str | None = None
) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per column."""
    keep = [c(by).alias("group")] if by else []
    keys = ["metric", "group"] if by else ["metric"]
    rows = df.where(c(by).isNotNull()) if by else df
    long = long_metrics(rows, existing(df, columns), keep)
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cuts = quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys).drop("n")
    return moments.join(cuts, keys)


def task_time_diagnostics(df: DataFrame, time_col: str = "task_time_taken_s") -> DataFrame:
    """One row: spread of the task time and how many values look wrong."""
    t = c(time_col)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(t).alias("count"),
        F.avg(t).alias("mean"),
        F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        F.count_if(t.isNull()).alias("null_count"),
        F.count_if(t < 0).alias("negative_count"),
        F.count_if(t > 3600).alias("over_1_hour"),
        F.count_if(t > 86400).alias("over_1_day"),
        F.count_if(t > 604800).alias("over_1_week"),
    )
    cuts = quantiles(df, time_col, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99})
    packed = cuts.select(F.struct("q25", "median", "q75", "q95", "q99")).scalar()
    return counted.withColumn("__q", packed).select(
        *counted.columns, *[F.col("__q").getField(n).alias(n) for n in ("q25", "median", "q75", "q95", "q99")]
    )


def date_diagnostics(df: DataFrame, created: str, completed: str) -> DataFrame:
    """One row: missing dates, their range and how often the order is wrong."""
    a, b = c(created), c(completed)
    return df.agg(
        F.count_if(a.isNull()).alias("created_null"),
        F.count_if(b.isNull()).alias("completed_null"),
        F.min(a).alias("created_min"),
        F.max(a).alias("created_max"),
        F.min(b).alias("completed_min"),
        F.max(b).alias("completed_max"),
        F.count_if(a > b).alias("created_after_completed"),
    )
