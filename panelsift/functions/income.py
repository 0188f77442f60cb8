"""Household income labels: buckets, bounds, short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ANSWER = "Prefer not to answer"
# Upper bound (exclusive) of each bucket's lower income limit.
INCOME_BUCKETS = (
    (35000, "Less than £35k"),
    (50000, "£35k to £49k"),
    (80000, "£50k to £79k"),
    (100000, "£80k to £99k"),
)
TOP_BUCKET = "£100k or more"
# Text replacements of the short label, applied in this order.
SHORTENINGS = (
    ("prefer not to say", "no_answer"),
    ("Prefer not to answer", "no_answer"),
    (",000", "k"),
    (",999", "k"),
    (" and above", "+"),
    ("Less than ", "<"),
    ("female_", "F_"),
    ("male_", "M_"),
)
# Amounts as written in short labels, tried in this order. A range
# matches the first pattern too, so it yields its lower amount.
SALARY_PATTERNS = (r"£(\d+)\s*k\+?", r"£\d+\s*k\s*to\s*£(\d+)\s*k", r"<£(\d+)\s*k")


def income_bucket(label: Column) -> Column:
    amount = F.regexp_replace(F.regexp_extract(label, r"£([\d,]+)", 1), ",", "")
    amount = amount.try_cast("double")
    bucket = F.when(amount.isNotNull(), TOP_BUCKET).otherwise("Unknown")
    for below, name in reversed(INCOME_BUCKETS):
        bucket = F.when(amount < below, name).otherwise(bucket)
    return (
        F.when(label.isNull(), "unknown.")
        .when(label.contains(NO_ANSWER), NO_ANSWER)
        .otherwise(bucket)
    )


def income_lower_bound(label: Column) -> Column:
    """Lower limit in pounds; infinity where there is no answer or no amount."""
    plain = F.regexp_replace(label, "[£,]", "")
    infinity = F.lit(float("inf"))

    def amount(separator: str) -> Column:
        return F.split_part(plain, F.lit(separator), F.lit(1)).try_cast("double")

    return (
        F.when(label.contains("Less than"), F.lit(0.0))
        .when(label.contains("Prefer not"), infinity)
        .when(plain.contains("to"), amount("to"))
        .when(plain.contains("and above"), amount("and"))
        .otherwise(infinity)
    )


def extract_max_salary(label: Column) -> Column:
    amounts = [F.regexp_extract(label, p, 1).try_cast("double") * 1000 for p in SALARY_PATTERNS]
    return F.coalesce(*amounts)


def shorten_income_label(label: Column) -> Column:
    for old, new in SHORTENINGS:
        label = F.replace(label, F.lit(old), F.lit(new))
    return label


def joined_categories(*columns: Column) -> Column:
    """``a_b`` text of several categories; a missing one reads ``nan``."""
    texts = [F.coalesce(col.cast("string"), F.lit("nan")) for col in columns]
    return F.concat_ws("_", *texts)


def trailing_number(name: Column) -> Column:
    """Number after the last underscore of a feature name, null if it is none."""
    return F.element_at(F.split(name, "_"), -1).try_cast("double")
