"""Pickups and dropoffs per zone, by color, season and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc
from tripweave.operators import quality
from tripweave.operators.trip_ends import with_direction
from tripweave.schema import FIRST_YEAR, LAST_YEAR


def counted_rides(trips: DataFrame) -> DataFrame:
    """Trips paid by card or cash with a distance and a bill, of the study years' files."""
    rides = quality.total_positive(quality.distance_within(quality.paid_by(trips, 1, 2)))
    if "file_year" in rides.columns:
        rides = rides.filter(F.col("file_year").between(FIRST_YEAR, LAST_YEAR))
        year, month = F.col("file_year"), F.col("file_month")
    else:
        rides = quality.years_within(rides, columns=("pickup_datetime",))
        year, month = F.year("pickup_datetime"), F.month("pickup_datetime")
    return rides.select(
        "color", year.alias("year"), month.alias("month"), "PULocationID", "DOLocationID"
    )


def _monthly(rides: DataFrame, zone: str, name: str) -> DataFrame:
    return (
        rides.groupBy("color", "year", "month", zone)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy("color", "year", "month", F.desc(name), zone)
    )


def pickup_counts(rides: DataFrame) -> DataFrame:
    return _monthly(rides, "PULocationID", "PUID_count")


def dropoff_counts(rides: DataFrame) -> DataFrame:
    return _monthly(rides, "DOLocationID", "DOID_count")


def monthly_zone_counts(rides: DataFrame) -> DataFrame:
    """Both directions in one pass; this is the table the reports below add up."""
    return (
        with_direction(rides)
        .groupBy("direction", "color", "year", "month", "LocationID")
        .agg(F.count(F.lit(1)).alias("trip_count"))
    )


def zone_counts_by(monthly: DataFrame, *keys: str) -> DataFrame:
    """Sum monthly counts over everything but direction, zone and ``keys``."""
    return (
        monthly.groupBy("direction", *keys, "LocationID")
        .agg(F.sum("trip_count").alias("trip_count"))
        .filter(F.col("trip_count") > 0)
        .orderBy("direction", *keys, F.desc("trip_count"), "LocationID")
    )


def zone_counts_by_color(monthly: DataFrame) -> DataFrame:
    return zone_counts_by(monthly, "color")


def zone_counts_by_season(monthly: DataFrame) -> DataFrame:
    return zone_counts_by(monthly.withColumn("season", tc.season()), "season")


def zone_counts_by_year(monthly: DataFrame) -> DataFrame:
    return zone_counts_by(monthly, "year")


def zone_counts_total(monthly: DataFrame) -> DataFrame:
    return zone_counts_by(monthly)


def zone_count_map(totals: DataFrame, zones: DataFrame) -> DataFrame:
    """Counts and their logarithm with the zone shapes; zones without a shape drop out."""
    return totals.join(zones.select("LocationID", "the_geom"), "LocationID").select(
        "direction",
        "LocationID",
        "trip_count",
        F.log("trip_count").alias("log_amount"),
        "the_geom",
    )
