"""Date and time expressions. All of them are free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar names in calendar order.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def parse_timestamp(text: Column) -> Column:
    """Timestamp without time zone; text that is no timestamp becomes null."""
    return text.try_cast("timestamp_ntz")


def day_of_week(moment: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(moment)


def is_weekend(moment: Column) -> Column:
    """False where there is no moment."""
    return F.coalesce(F.weekday(moment) >= 5, F.lit(False))


def day_name(moment: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.weekday(moment) + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), month)


def whole_days_between(start: Column, end: Column) -> Column:
    """Elapsed whole days, not midnights passed."""
    return F.extract(F.lit("DAY"), end - start).cast("int")


def week_ending_sunday(day: Column) -> Column:
    return F.date_add(day, 6 - F.weekday(day))


# The labels of the two ways to part a day.
def day_period(hour: Column) -> Column:
    """Bins closed on the left: 6 is morning, 12 afternoon, 18 evening."""
    return (
        F.when(hour < 6, "night")
        .when(hour < 12, "morning")
        .when(hour < 18, "afternoon")
        .when(hour >= 18, "evening")
        .otherwise("unknown")
    )


def day_part(hour: Column) -> Column:
    """Bins closed on the right: 6 is Night, 12 Morning, 18 Afternoon; null outside 0-24."""
    return (
        F.when(hour < 0, None)
        .when(hour <= 6, "Night")
        .when(hour <= 12, "Morning")
        .when(hour <= 18, "Afternoon")
        .when(hour <= 24, "Evening")
    )
