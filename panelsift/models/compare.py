"""All models on the same features, compared and reported. Tables have one row per feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models.attribution import shap_importance
from panelsift.models.forest import ForestFit, build_random_forest_model
from panelsift.models.linear import LinearModel, build_linear_baseline
from panelsift.models.logistic import LogisticFit, build_logistic_regression_model
from panelsift.operators.select import remove_collinear_features
from panelsift.session import materialise
from panelsift.stats.effects import interpret_odds_ratio

MODEL_RANKS = ("linear_rank", "rf_rank", "lr_rank", "shap_rank")


def with_rank(table: DataFrame, value: Column, name: str) -> DataFrame:
    """Rank from the largest value down, ties sharing their mean rank.

    For result tables only: one row per feature fits one window partition.
    """
    valued = table.withColumn("__v", value)
    one = Window.partitionBy(F.lit(0))
    place = F.rank().over(one.orderBy(F.col("__v").desc_nulls_last()))
    same = F.count(F.lit(1)).over(one.partitionBy(F.lit(0), "__v"))
    rank = F.when(F.col("__v").isNotNull(), place + (same - 1) / 2)
    return valued.withColumn(name, rank).drop("__v")


def average_rank(table: DataFrame) -> DataFrame:
    """Mean of the model ranks the table has, best first."""
    ranks = [c(n) for n in MODEL_RANKS if n in table.columns]
    total = ranks[0]
    for r in ranks[1:]:
        total = total + r
    return table.withColumn("avg_rank", total / len(ranks)).orderBy("avg_rank", "feature")


@dataclass
class ModelResults:
    linear_model: LinearModel
    linear_importance: DataFrame
    vif_data: DataFrame
    forest: ForestFit
    logistic: LogisticFit | None
    comparison: DataFrame
    feature_cols: list[str]
    shap: DataFrame | None = None


def compare_models(
    linear: DataFrame, forest: DataFrame, logistic: DataFrame | None, vif: DataFrame
) -> DataFrame:
    table = linear.select(
        "feature",
        F.col("coefficient").alias("linear_coef"),
        F.col("p_value").alias("linear_p_value"),
        F.col("t_stat").alias("linear_t_stat"),
    )
    table = table.join(forest.select("feature", "rf_importance", "rf_importance_pct"), "feature", "left")
    if logistic is not None:
        columns = ["lr_coefficient", "lr_odds_ratio", "lr_p_value", "lr_significant"]
        table = table.join(logistic.select("feature", *columns), "feature", "left")
    table = table.join(vif.select("feature", "VIF"), "feature", "left")
    table = with_rank(table, F.abs("linear_coef"), "linear_rank")
    table = with_rank(table, F.col("rf_importance"), "rf_rank")
    if logistic is not None:
        table = with_rank(table, F.abs("lr_coefficient"), "lr_rank")
    return average_rank(table)


def run_all_models(
    df: DataFrame,
    feature_cols: Sequence[str],
    outcome_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
    include_logistic: bool = True,
    include_vif: bool = True,
    rf_n_estimators: int = 100,
    lr_regularization_C: float = 1.0,
    rf_max_depth: int = 10,
    n_splits: int = 5,
) -> ModelResults:
    """Linear, forest and, on request, logistic model and their comparison.

    What the models read is stored first: each of them goes through it several times.
    """
    features = remove_collinear_features(feature_cols)
    df = materialise(df.select(*[c(n) for n in dict.fromkeys([*features, outcome_var, user_id_var])]))
    linear, importance, vif = build_linear_baseline(
        df, features, outcome_var, user_id_var, include_vif
    )
    forest = build_random_forest_model(
        df, features, outcome_var, user_id_var, rf_n_estimators, rf_max_depth, n_splits
    )
    logistic = None
    if include_logistic:
        logistic = build_logistic_regression_model(
            df, features, outcome_var, user_id_var,
            regularization_C=lr_regularization_C, n_splits=n_splits,
        )
    comparison = compare_models(
        importance, forest.importance, logistic.importance if logistic else None, vif
    )
    return ModelResults(linear, importance, vif, forest, logistic, comparison, features)


def run_shap_analysis(
    results: ModelResults, df: DataFrame, sample_size: int | None = None, random_state: int = 42
) -> ModelResults:
    """Add attributions of the forest and let them count in the average rank.

    All complete rows are explained unless ``sample_size`` asks for fewer.
    """
    shap = materialise(
        shap_importance(df, results.forest.model, results.feature_cols, sample_size, random_state)
    )
    results.shap = shap
    results.comparison = average_rank(results.comparison.join(shap, "feature", "left"))
    return results


def create_stakeholder_report(comparison: DataFrame) -> DataFrame:
    """Readable table: stars, short p-values, odds in words, flags, consensus rank."""
    p, vif = F.col("linear_p_value"), F.col("VIF")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    columns = {
        "Feature": F.col("feature"),
        "Linear Effect": F.concat(F.format_string("%+.4f", F.col("linear_coef")), stars),
        "Linear p-value": F.when(p >= 0.0001, F.format_string("%.4f", p)).otherwise(
            F.format_string("%.2e", p)
        ),
        "RF Importance %": F.format_string("%.2f%%", F.col("rf_importance_pct")),
    }
    if "lr_odds_ratio" in comparison.columns:
        ratio = F.col("lr_odds_ratio")
        columns["Odds Ratio"] = F.when(
            ratio.between(0.01, 100), F.format_string("%.3f", ratio)
        ).otherwise("⚠️")
        columns["OR Interpretation"] = interpret_odds_ratio(ratio)
    if "shap_direction" in comparison.columns:
        columns["SHAP Direction"] = F.col("shap_direction")
    columns["Consensus Rank"] = F.round("avg_rank", 1)
    columns["VIF"] = (
        F.when(vif.isNull() | F.isnan(vif), "N/A")
        .when(vif == float("inf"), "inf")
        .otherwise(F.format_string("%.1f", vif))
    )
    columns["VIF Flag"] = (
        F.when(vif.isNull() | F.isnan(vif), "✓").when(vif > 10, "⚠️").when(vif > 5, "⚡").otherwise("✓")
    )
    report = comparison.select(*[v.alias(n) for n, v in columns.items()])
    return report.orderBy("Consensus Rank", "Feature")


def get_significant_features(
    comparison: DataFrame, p_threshold: float = 0.05, min_rf_importance: float = 0.01
) -> DataFrame:
    """Features that pass every model's test."""
    kept = comparison.where(
        (F.col("linear_p_value") < p_threshold) & (F.col("rf_importance") >= min_rf_importance)
    )
    if "lr_significant" in comparison.columns:
        kept = kept.where(F.coalesce(F.col("lr_significant"), F.lit(False)))
    return kept.select("feature")
