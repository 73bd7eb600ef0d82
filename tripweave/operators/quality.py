"""Row filters. Each takes a DataFrame and its bounds and returns a DataFrame.

Comparisons are on bare columns wherever possible, so that they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import trip_columns as tc
from tripweave.schema import FIRST_YEAR, LAST_YEAR, UNKNOWN_ZONES


def total_above(df: DataFrame, floor: float = 2.5) -> DataFrame:
    return df.filter(F.col("total_amount") > floor)


def distance_within(df: DataFrame, above: float = 0, below: float | None = None) -> DataFrame:
    df = df.filter(F.col("trip_distance") > above)
    return df if below is None else df.filter(F.col("trip_distance") < below)


def known_zones(
    df: DataFrame, unknown: Sequence[int] = UNKNOWN_ZONES, as_reference: bool = False
) -> DataFrame:
    """Drop trips that start or end in an unknown zone.

    ``as_reference`` tests only the first id at the start and only the last at the end.
    """
    if as_reference:
        return df.filter(
            (F.col("PULocationID") != unknown[0]) & (F.col("DOLocationID") != unknown[-1])
        )
    return df.filter(~F.col("PULocationID").isin(*unknown) & ~F.col("DOLocationID").isin(*unknown))


def zones_below(df: DataFrame, first_unknown: int = UNKNOWN_ZONES[0]) -> DataFrame:
    return df.filter(
        (F.col("PULocationID") < first_unknown) & (F.col("DOLocationID") < first_unknown)
    )


def same_zone(df: DataFrame) -> DataFrame:
    return df.filter(F.col("PULocationID") == F.col("DOLocationID"))


def _midnight(df: DataFrame, column: str, year: int) -> Column:
    kind = df.schema[column].dataType
    target = kind if isinstance(kind, T.TimestampType) else T.TimestampNTZType()
    return F.lit(f"{year:04d}-01-01 00:00:00").cast(target)


def years_within(
    df: DataFrame,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    columns: Sequence[str] = ("pickup_datetime", "dropoff_datetime"),
) -> DataFrame:
    """Keep whole years, as a timestamp range in the column's own type so that it is pushed down."""
    for column in columns:
        df = df.filter(
            (F.col(column) >= _midnight(df, column, first))
            & (F.col(column) < _midnight(df, column, last + 1))
        )
    return df


def filed_in_own_year(df: DataFrame) -> DataFrame:
    """Keep trips whose pickup year is the year of the file they came in."""
    return df.filter(F.year("pickup_datetime") == F.col("file_year"))


def duration_between(df: DataFrame, above: int = 0, below: int = 10800) -> DataFrame:
    """Bounds on the ``duration`` column, both exclusive."""
    return df.filter((F.col("duration") > above) & (F.col("duration") < below))


def at_most_minutes(df: DataFrame, minutes: int = 180, at_least: int | None = None) -> DataFrame:
    """Upper bound on the ride time; a lower bound only when asked for."""
    ride = tc.duration_seconds()
    df = df.filter(ride / 60 <= minutes)
    return df if at_least is None else df.filter(ride / 60 >= at_least)


def speed_between(df: DataFrame, above: float = 0, below: float = 100) -> DataFrame:
    """Bounds on the ``speed`` column, both exclusive."""
    return df.filter((F.col("speed") > above) & (F.col("speed") < below))


def paid_by(df: DataFrame, *types: int) -> DataFrame:
    return df.filter(F.col("payment_type").isin(*types))


def total_positive(df: DataFrame) -> DataFrame:
    return df.filter(F.col("total_amount") > 0)


def fare_in_band(
    df: DataFrame, start: float = 2.5, low_rate: float = 2, high_rate: float = 3.5
) -> DataFrame:
    """Keep trips whose fare is a plausible price for the distance."""
    distance = F.col("trip_distance")
    return df.filter(
        F.col("fare_amount").between(start + low_rate * distance, start + high_rate * distance)
    )


def fare_at_least(df: DataFrame, floor: float = 2.5) -> DataFrame:
    return df.filter(F.col("fare_amount") >= floor)


def main_vendors(df: DataFrame, below: int = 3) -> DataFrame:
    return df.filter(F.col("VendorID") < below)


def bill_caps(
    df: DataFrame, total: float = 120, distance: float = 20, other: float = 20
) -> DataFrame:
    """Upper bounds, inclusive, on the bill, the distance and the charges besides fare and tip."""
    return df.filter(
        (F.col("total_amount") <= total)
        & (F.col("trip_distance") <= distance)
        & (tc.other_charges() <= other)
    )


def count_above(df: DataFrame, floor: int, column: str = "count") -> DataFrame:
    return df.filter(F.col(column) > floor)
