"""Calendar columns of a date, shared by feature building and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_FEATURES = (
    "year", "month", "quarter", "week_of_year", "day_of_month",
    "day_of_week", "day_of_year", "is_weekend", "is_month_start",
    "is_month_end",
)


def calendar_columns(date: Column) -> dict[str, Column]:
    """ISO weeks, Monday = 0, weekend = Saturday and Sunday."""
    weekday = F.weekday(date)
    exprs = {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "week_of_year": F.weekofyear(date),
        "day_of_month": F.dayofmonth(date),
        "day_of_week": weekday,
        "day_of_year": F.dayofyear(date),
        "is_weekend": weekday >= 5,
        "is_month_start": F.dayofmonth(date) == 1,
        "is_month_end": date == F.last_day(date),
    }
    return {name: exprs[name].cast("int") for name in CALENDAR_FEATURES}
