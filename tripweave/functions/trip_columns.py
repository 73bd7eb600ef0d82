"""Scalar expressions over trip columns; all built-ins, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave.schema import BOROUGH_ORDER


def duration_seconds(start: str = "pickup_datetime", end: str = "dropoff_datetime") -> Column:
    """Whole seconds between two timestamps, with or without time zone."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def duration_minutes(start: str = "pickup_datetime", end: str = "dropoff_datetime") -> Column:
    return duration_seconds(start, end) / 60


def speed(distance: str = "trip_distance", seconds: str = "duration") -> Column:
    """Distance units per hour; NULL when no time passed."""
    return F.try_divide(F.col(distance), F.col(seconds) / 3600)


def tip_share() -> Column:
    """Tip as a share of everything paid."""
    return F.try_divide(F.col("tip_amount"), F.col("total_amount"))


def before_tip() -> Column:
    return F.col("total_amount") - F.col("tip_amount")


def tip_ratio() -> Column:
    """Tip as a share of the bill before the tip."""
    return F.try_divide(F.col("tip_amount"), before_tip())


def tip_bucket(steps: int, top: int) -> Column:
    """``ceil(steps * tip ratio)``; everything above ``top`` shares the bucket ``top + 1``."""
    step = F.ceil(F.try_divide(steps * F.col("tip_amount"), before_tip())).cast("long")
    return F.when(step <= top, step).when(step > top, F.lit(top + 1).cast("long"))


def other_charges() -> Column:
    """What was charged besides fare and tip."""
    return F.col("total_amount") - F.col("tip_amount") - F.col("fare_amount")


def other_ratio(of_total: bool = False) -> Column:
    """Other charges over the bill before the tip, or over the whole bill."""
    return F.try_divide(other_charges(), F.col("total_amount") if of_total else before_tip())


def calendar_columns(source: str = "pickup_datetime") -> dict[str, Column]:
    """Calendar parts of a timestamp; weekday counts from Sunday = 1."""
    return {
        "year": F.year(source),
        "month": F.month(source),
        "monthday": F.dayofmonth(source),
        "weekday": F.dayofweek(source),
        "hour": F.hour(source),
        "date": F.to_date(source),
    }


def season(month: str = "month") -> Column:
    """1 = Mar-May, 2 = Jun-Aug, 3 = Sep-Nov, 4 = Dec-Feb."""
    quarter = F.floor((F.col(month) % 12) / 3).cast("int")
    return F.when(quarter == 0, 4).otherwise(quarter)


def borough_index(borough: str, order: Sequence[str] = BOROUGH_ORDER) -> Column:
    """Position of a borough in ``order``; names outside it share the next position."""
    position = F.array_position(F.array(*[F.lit(name) for name in order]), F.col(borough))
    return F.when(position > 0, position.cast("int") - 1).otherwise(len(order))


def pair_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def celsius(fahrenheit: str) -> Column:
    return (F.col(fahrenheit) - 32) / 1.8


def measured(column: str) -> Column:
    """True when a weather reading is neither zero nor a trace (``T``)."""
    return ~F.coalesce(F.col(column), F.lit("")).isin("0", "T")

