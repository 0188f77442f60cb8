"""Row and column selection shared by the feature, test and model steps."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, existing

# Flags that are sums of other flags.
COLLINEAR_FEATURES = ("is_weekend", "is_business_hour")


def keep_known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({n: F.coalesce(c(n), F.lit(v)) for n, v in values.items()})


def complete_cases(
    df: DataFrame, features: Sequence[str], outcome: str, group: str | None = None
) -> DataFrame:
    """Rows without a missing feature, outcome or, if given, group."""
    needed = [*features, outcome, *([group] if group else [])]
    return df.dropna(subset=needed)


def filter_to_engineered_features(
    df: DataFrame,
    original_columns: Collection[str],
    id_column: str = "respondentPk",
    kpi_column: str = "wonky_study_count",
    additional_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Id, outcome, every column that was not there before, and extras that exist."""
    made = [n for n in df.columns if n not in original_columns]
    extras = existing(df, additional_columns or ())
    return df.select(*[c(n) for n in dict.fromkeys([id_column, kpi_column, *made, *extras])])


def remove_collinear_features(
    features: Sequence[str],
    additional_removals: Sequence[str] | None = None,
    containing: Sequence[str] = (),
) -> list[str]:
    """Feature list without known sums of others, extras and names holding a text."""
    unwanted = {*COLLINEAR_FEATURES, *(additional_removals or ())}
    return [
        f for f in features if f not in unwanted and not any(text in f for text in containing)
    ]
