"""Cleaning jobs: raw trips in, analysis-ready trips out. All are one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc
from tripweave.operators import quality
from tripweave.schema import FIRST_YEAR, LAST_YEAR, TIP_INPUT_COLUMNS
from tripweave.sources.tripdata import TAG_COLUMNS, normalise, union_trips

# Columns the time table does not keep.
TIME_DROPS = (
    "trip_type",
    "congestion_surcharge",
    "airport_fee",
    "RatecodeID",
    "PULocationID",
    "DOLocationID",
    "fare_amount",
    "extra",
    "total_amount",
    "trip_distance",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "speed",
    "payment_type",
    "improvement_surcharge",
)


def clean_general(parts: Sequence[DataFrame]) -> DataFrame:
    """Card-paid trips with a distance and a bill, in ten columns and the tags of their file."""
    rides = union_trips(parts)
    rides = quality.paid_by(rides, 1)
    rides = quality.total_positive(quality.distance_within(rides))
    tags = [name for name in TAG_COLUMNS if name in rides.columns]
    return rides.select(*TIP_INPUT_COLUMNS, *tags).withColumn(
        "payment_type", F.col("payment_type").cast("int")
    )


def _without_fee_columns(part: DataFrame) -> DataFrame:
    """Sources that carry ``ehail_fee`` lose it and their congestion surcharge."""
    part = part.drop("VendorID", "store_and_fwd_flag")
    return part.drop("ehail_fee", "congestion_surcharge") if "ehail_fee" in part.columns else part


def clean_by_payment(parts: Sequence[DataFrame]) -> DataFrame:
    """Trips paid by card or cash with a distance and a bill; all other columns are kept."""
    rides = union_trips(_without_fee_columns(part) for part in parts)
    rides = quality.paid_by(rides, 1, 2)
    return quality.total_positive(quality.distance_within(rides))


def clean_time(
    parts: Sequence[DataFrame],
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    max_seconds: int = 6000,
    as_reference: bool = False,
) -> DataFrame:
    """Trips with calendar columns and a plausible ride, for the demand profiles."""
    rides = union_trips(parts)
    if "file_year" in rides.columns:
        rides = quality.filed_in_own_year(rides)
    rides = quality.years_within(rides, first, last, columns=("pickup_datetime",))
    rides = quality.total_above(rides)
    rides = quality.known_zones(rides, as_reference=as_reference)
    rides = rides.withColumns({**tc.calendar_columns(), "duration": tc.duration_seconds()})
    rides = quality.duration_between(rides, 0, max_seconds)
    rides = quality.speed_between(rides.withColumn("speed", tc.speed()))
    return rides.drop(*TIME_DROPS)


def clean_speed(
    trips: DataFrame,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    max_seconds: int = 10800,
    as_reference: bool = False,
) -> DataFrame:
    """Trips with duration, speed, tip share, hour and weekday, for the speed analyses."""
    rides = normalise(trips)
    rides = quality.distance_within(quality.total_above(rides))
    rides = quality.known_zones(rides, as_reference=as_reference)
    rides = quality.years_within(rides, first, last)
    rides = rides.withColumn("duration", tc.duration_seconds())
    rides = quality.duration_between(rides, 0, max_seconds)
    rides = quality.speed_between(rides.withColumn("speed", tc.speed()))
    return rides.withColumns(
        {
            "weekday": F.dayofweek("pickup_datetime"),
            "tip_percentage": tc.tip_share(),
            "hour": F.hour("pickup_datetime"),
        }
    )
