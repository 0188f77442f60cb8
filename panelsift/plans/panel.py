"""The whole analysis as composed plans: pull, features, tests, models.

Every step takes and returns DataFrames; nothing is collected between them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift import config
from panelsift.columns import c, drop_duplicate_columns, exclude, existing, placed_last, starting_with
from panelsift.functions import bins, device, onehot, sparse, speed, temporal
from panelsift.models.compare import ModelResults, run_all_models
from panelsift.operators import aggregates, joins, profile, select, windows
from panelsift.operators.skew import attach_per_key, find_hot_keys
from panelsift.session import materialise, materialise_by
from panelsift.sources import sinks, tables
from panelsift.stats import cluster

# Columns taken over unchanged besides the engineered ones.
CARRIED_COLUMNS = (
    "risk", "quality", "age_YOB", "days_active", "task_time_minutes", "task_completed",
    "exposure_band", "days_active_before_task",
)
# Profile codes mapped to labels, then encoded.
PROFILE_LABELS = {
    "fulcrum_household_income": config.INCOME_LABELS,
    "employer_industry": config.INDUSTRY_LABELS,
    "employer_department": config.DEPARTMENT_LABELS,
    "fulcrum_region": config.REGION_LABELS,
}
# Columns encoded as categories; those encoded through their text.
ENCODED_COLUMNS = (
    "device", "hardware_category", "manufacturer_category", "ditr_os", "email_verified",
    "employee_title", "employer_department", "employer_industry", "entryPoint",
    "exposure_band", "fulcrum_region", "gambling_participation_mc", "gender",
    "notify_new_task", "notify_task_payout", "quality_round10", "risk_round10",
    "share_location_data", "taskTitle", "task_length_of_task", "ip_address_count",
)
TEXT_COLUMNS = (
    "email_verified", "ip_address_count", "notify_new_task", "notify_task_payout",
    "quality_round10", "risk_round10", "share_location_data", "task_length_of_task",
)
# Of these, the ones whose categories grow with the data; the others are code lists.
OPEN_COLUMNS = ("device", "employee_title", "ip_address_count", "taskTitle", "task_length_of_task")


@dataclass
class PulledPanel:
    """Outputs of the data pull, by the names of their configured paths."""

    user_info_df: DataFrame
    wonky_map: DataFrame
    wonky_respondent_df: DataFrame
    wonky_respondent_summary: DataFrame
    wonky_user_counts: DataFrame
    failed_studies: list[str]

    def write(self, paths: Mapping[str, str]) -> None:
        names = (
            "user_info_df", "wonky_map", "wonky_respondent_df", "wonky_respondent_summary",
            "wonky_user_counts",
        )
        sinks.write_outputs({n: getattr(self, n) for n in names if n in paths}, paths)


def pull_panel(
    spark: SparkSession,
    paths: config.PathSettings,
    studies: config.StudySettings,
    dedupe: bool = False,
) -> PulledPanel:
    """Load, join and enrich completions, and merge the study exposure into them."""
    users = tables.load_user_table(spark, paths.silver_path, paths.country, paths.fmt)
    done = tables.load_task_complete_table(
        spark, paths.silver_path, paths.min_date, paths.task_origin, paths.fmt
    )
    info = tables.load_respondent_info_table(
        spark, paths.silver_path, paths.country, studies.cols_to_exclude_respondent_info, paths.fmt
    )
    tasks = tables.load_task_table(spark, paths.silver_path, paths.task_origin, paths.fmt)
    devices = tables.load_device_table(spark, paths.silver_path, users, fmt=paths.fmt)

    loaded = tables.load_all_studies(
        spark, list(studies.study_labels), paths.project_repository_path,
        studies.cols_to_include_subset, paths.fmt,
    )
    if loaded.balance is None:
        raise ValueError(f"no study could be loaded: {loaded.failed}")
    balance = joins.label_studies(loaded.balance, studies.study_labels)
    study_map = joins.join_study_balance_with_task(balance, tasks)
    grouped = aggregates.aggregate_studies(study_map, studies.cols_to_group)
    grouped = exclude(grouped, studies.cols_to_drop)

    # one table of all respondent-level facts, stored by respondent: the completions meet it once
    respondents = joins.respondent_table(users, done, info, devices, grouped)
    respondents = materialise_by(respondents, "__respondent")
    merged = joins.join_panel(done, tasks, grouped, respondents, users.columns, dedupe)
    merged = drop_duplicate_columns(merged.drop("_merge"))
    summary = aggregates.create_study_respondent_summary(
        grouped, "balance_respondentPk", ("survey_pk", *config.SUMMARY_CATEGORIES)
    )
    # the totals do not need the merged rows, which repeat the same count per row
    active = respondents.where(F.col("__respondent").isNotNull())
    totals = joins.respondent_task_totals(active.withColumn("respondentPk", F.col("__respondent")))
    summary = joins.summary_with_task_totals(summary, totals)
    counts = aggregates.calculate_task_ratio(
        totals.withColumnsRenamed(
            {"task_completed": "tasks_completed", "respondentPk": "respondentPk_tc"}
        ),
        summary,
        "tasks_completed",
    )
    return PulledPanel(merged, study_map, grouped, summary, counts, loaded.failed)


def engineer_features(
    df: DataFrame,
    drop_from_load: Sequence[str] = (),
    speed_group: str | None = None,
    carried: Sequence[str] = CARRIED_COLUMNS,
    open_vocabulary: Sequence[str] = OPEN_COLUMNS,
) -> DataFrame:
    """All engineered features of the completions.

    Pass a stored table: the quantiles, the per-respondent facts and the features
    read it one after the other. Columns a data set lacks are left out along with what is
    made from them. Two small jobs run on the way: the time quantiles and the categories
    of the code lists, which become a column each. Categories of ``open_vocabulary``
    columns become entries of the column ``sparse_features``; see
    :mod:`panelsift.functions.sparse`. What takes a join or another pass is stored; features
    of a single row are made when they are read, and only those that are.
    """
    df = exclude(df, drop_from_load)
    original = set(df.columns)
    have = original.__contains__
    hot = find_hot_keys(df, ["respondentPk"])
    df = profile.winsorise_upper(df, "task_time_taken_s", 0.95)
    df = speed.create_task_speed_features(df, group_by_col=speed_group)
    facts = {"first_task_created": F.min("date_created")}
    if have("request-remote-addr"):
        facts["ip_address_count"] = F.count_distinct(c("request-remote-addr"))
    df = attach_per_key(df, ["respondentPk"], *[f.alias(n) for n, f in facts.items()], hot=hot)
    devices = have("ditr_hardware") and have("ditr_manufacturer")
    if devices:
        df = device.add_device_categories(df)
    # the joins and the long rules are done once; what follows looks at one row, where it is read
    df = materialise(df)
    df = temporal.create_all_temporal_features(df)
    for score in ("quality", "risk"):
        if have(score):
            df = bins.create_score_features(df, score)
    df = placed_last(df, [*facts])
    days = windows.whole_days(F.col("date_completed"), F.col("first_task_created"))
    df = df.withColumn("days_active_before_task", days)
    df, _ = bins.create_binned_features(
        df, "days_active_before_task", bins.TENURE_BINS, "days_active_",
        include_mutually_exclusive=True,
    )
    for code, labels in PROFILE_LABELS.items():
        if have(code):
            df = onehot.map_values(df, code, labels, f"{code}_mapped")
    if have("task_completed"):
        df, _ = bins.create_task_amount_features(df, "task_completed")
    if devices:
        df = placed_last(df, ["hardware_category", "manufacturer_category"])
    for score in ("risk", "quality"):
        if have(score):
            df = df.withColumn(f"{score}_round10", bins.round_to_tens(score))
    mapped = [f"{code}_mapped" for code in PROFILE_LABELS if have(code)]
    encoded = existing(df, [*ENCODED_COLUMNS, *mapped])
    text = {*TEXT_COLUMNS, *mapped}
    listed = [n for n in encoded if n in set(open_vocabulary)]
    df = onehot.batch_one_hot_encode(df, [n for n in encoded if n not in listed], sorted(text))
    if listed:
        df = sparse.encode(df, {n: n in text for n in listed})
    return select.filter_to_engineered_features(df, original, additional_columns=carried)


def test_features(
    df: DataFrame, feature_sets: Mapping[str, Sequence[str]], outcome: str = "wonky_study_count"
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Both regressions for every configured feature over the exposed and control rows.

    Configured names may be columns, features of the sparse column, or all of its features
    that start alike (``taskTitle_*``). Also returns the names the data does not have.
    """
    rows = select.keep_known(df, ["exposure_band"]) if "exposure_band" in df.columns else df
    listed: list[str] = []
    if sparse.COLUMN in rows.columns:
        asked = {n.strip().rstrip(",") for names in feature_sets.values() for n in names}
        listed = sparse.present(rows, sorted(asked - set(rows.columns)))
    known, unknown = config.clean_feature_sets(
        {k: list(v) for k, v in feature_sets.items()}, [*rows.columns, *listed]
    )
    known = {k: v for k, v in known.items() if v}
    column = sparse.COLUMN if listed else None
    return cluster.run_test_battery(rows, known, column, outcome_var=outcome), unknown


test_features.__test__ = False  # a step of the analysis, not a unit test


def model_features(
    df: DataFrame, results: DataFrame, extra: Sequence[str] = (), **settings
) -> ModelResults:
    """Models on the features significant in both tests, over rows with an outcome.

    Chosen features of the sparse column become columns of their own.
    """
    chosen = [r.feature for r in cluster.both_significant(results).select("feature").distinct().collect()]
    features = select.remove_collinear_features(
        [*sorted(chosen), *[n for n in extra if n not in chosen]], containing=("is_weekend",)
    )
    rows = select.keep_known(df, ["wonky_study_count"])
    if sparse.COLUMN in rows.columns:
        rows = sparse.with_columns(rows, sparse.present(rows, [n for n in features if n not in rows.columns]))
    return run_all_models(rows, existing(rows, features), **settings)


def feature_names(df: DataFrame, *prefixes: str) -> list[str]:
    return starting_with(df, *prefixes)


def with_configured_studies(raw: Mapping[str, object]) -> config.StudySettings:
    """Study settings from a parsed YAML file, whatever name its label map has."""
    labels = next(v for k, v in raw.items() if k.endswith("study_uuids"))
    settings = {k: v for k, v in raw.items() if not k.endswith("study_uuids")}
    return config.from_mapping(config.StudySettings, {**settings, "study_labels": labels})
