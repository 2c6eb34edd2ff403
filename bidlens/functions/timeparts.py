"""Time columns: 17-digit log times, (weekday, hour) cells and hour arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names in calendar order.
WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def parse_ts(text: Column) -> Column:
    """``yyyyMMddHHmmss`` plus an optional number of milliseconds, as TIMESTAMP_NTZ."""

    def digits(start: int, length: int) -> Column:
        return F.substring(text, start, length).cast("int")

    millis = F.coalesce(F.nullif(F.substring(text, 15, 9), F.lit("")), F.lit("0"))
    seconds = F.substring(text, 13, 2).cast("decimal(16,6)") + (
        millis.cast("decimal(16,6)") * F.lit("0.001").cast("decimal(4,3)")
    )
    return F.make_timestamp_ntz(
        digits(1, 4), digits(5, 2), digits(7, 2), digits(9, 2), digits(11, 2), seconds.cast("decimal(16,6)")
    )


def format_ts(ts: Column) -> Column:
    """The 17-digit text form of a time (milliseconds, rest cut off)."""
    return F.date_format(ts, "yyyyMMddHHmmssSSS")


def weekday_name(ts: Column) -> Column:
    """Uppercase English weekday; independent of locale and session time zone."""
    return F.elt(F.weekday(ts) + 1, *[F.lit(d) for d in WEEKDAYS])


def day_hour(ts: Column) -> tuple[Column, Column]:
    return weekday_name(ts), F.hour(ts)


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def shift_hour(ts: Column, hours: int) -> tuple[Column, Column]:
    """(weekday, hour) of the time moved by whole hours."""
    return day_hour(ts + F.make_dt_interval(F.lit(0), F.lit(hours)))


def shift_cell(weekday: Column, hour: Column, hours: int) -> tuple[Column, Column]:
    """Move a (weekday, hour) cell by whole hours, wrapping at the end of the week."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    position = F.pmod((F.array_position(names, weekday) - 1) * 24 + hour + hours, F.lit(168))
    return F.element_at(names, (F.floor(position / 24) + 1).cast("int")), F.pmod(position, F.lit(24)).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    """Started hours from ``start`` to ``end``: full hours plus one."""
    return F.timestamp_diff("HOUR", start, end) + 1


def hour_steps(start: Column, end: Column) -> Column:
    """Array of ``start`` and every full hour after it up to ``end``; NULL when start is later."""
    return F.when(start <= end, F.sequence(start, end, F.make_dt_interval(F.lit(0), F.lit(1))))


def hour_spine(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per hour bucket between two time columns, with its weekday and hour."""
    stepped = df.withColumn("step_ts", F.explode(hour_steps(F.col(start), F.col(end))))
    weekday, hour = day_hour(F.col("step_ts"))
    return stepped.withColumn("weekday", weekday).withColumn("hour", hour)


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 1) & (hour <= 6), "night")
        .when((hour > 6) & (hour <= 12), "morning")
        .when((hour > 12) & (hour <= 18), "afternoon")
        .otherwise("evening")
    )
