"""Writing intermediate tables and the final comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.columns import c, drop_duplicate_columns, existing, select_existing

# Columns of the exported comparison, in order.
EXPORT_COLUMNS = (
    "feature",
    "linear_coef",
    "linear_p_value",
    "rf_importance",
    "rf_importance_pct",
    "avg_rank",
    "VIF",
    "lr_coefficient",
    "lr_odds_ratio",
    "lr_p_value",
    "shap_importance",
    "shap_mean",
    "shap_direction",
)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    writer = drop_duplicate_columns(df).write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_outputs(frames: Mapping[str, DataFrame], paths: Mapping[str, str]) -> None:
    """Write every frame to the path configured under its name."""
    for name, frame in frames.items():
        write_table(frame, paths[name])


def export_results(comparison: DataFrame, path: str) -> DataFrame:
    """Write the comparison's export columns as CSV with a header; returns them."""
    chosen = select_existing(comparison, EXPORT_COLUMNS)
    if "avg_rank" in existing(chosen, ["avg_rank"]):
        chosen = chosen.orderBy(c("avg_rank"), F.col("feature"))
    chosen.write.mode("overwrite").option("header", True).csv(path)
    return chosen
