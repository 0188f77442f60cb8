"""Calendar and clock features of a completion time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c, flag

# Weekday flags in Monday-first order.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# First hour of each period, up to the next one; night wraps round midnight.
HOUR_PERIODS = (
    (0, "night"),
    (6, "early_morning"),
    (9, "morning"),
    (12, "afternoon"),
    (17, "evening"),
    (22, "night"),
)
PERIOD_FLAGS = ("early_morning", "morning", "afternoon", "evening")


def clock_label(hour: int) -> str:
    """12-hour name of an hour: 0 is 12am, 13 is 1pm."""
    return f"{hour % 12 or 12}{'am' if hour < 12 else 'pm'}"


def hour_label(hour: Column) -> Column:
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    suffix = F.when(hour < 12, "am").otherwise("pm")
    return F.when(hour.isNotNull(), F.concat(twelve.cast("string"), suffix))


def hour_period(hour: Column) -> Column:
    period = F.lit(None).cast("string")
    for start, label in HOUR_PERIODS:
        period = F.when(hour >= start, label).otherwise(period)
    return period


def create_all_temporal_features(
    df: DataFrame, date_col: str = "date_completed", include_hourly: bool = True
) -> DataFrame:
    """Hour, weekday, business-time and period features.

    A missing date leaves hour, label and period null and sets every flag to 0.
    """
    date = c(date_col)
    basic = {
        "hour_of_day": F.hour(date),
        "day_of_week": F.weekday(date),
    }
    hour, day = F.col("hour_of_day"), F.col("day_of_week")
    business = hour.between(9, 17)
    weekend = day >= 5
    derived: dict[str, Column] = {
        "is_weekend": flag(weekend),
        "hour_of_day_label": hour_label(hour),
        **{f"is_{name}": flag(day == i) for i, name in enumerate(WEEKDAYS)},
        "is_night": flag((hour >= 22) | (hour <= 6)),
        "is_business_hour": flag(business),
        "is_business_hour_weekday": flag(business & ~weekend),
        "is_business_hour_weekend": flag(business & weekend),
    }
    if include_hourly:
        for h in range(24):
            derived[f"is_hour_{h}"] = flag(hour == h)
            derived[f"is_{clock_label(h)}"] = flag(hour == h)
    period = hour_period(hour)
    derived["hour_period"] = period
    for name in PERIOD_FLAGS:
        derived[f"is_{name}"] = flag(period == name)
    return df.withColumns(basic).withColumns(derived)
