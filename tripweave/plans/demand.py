"""Trips and passengers over the calendar, from the time table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_counts(rides: DataFrame) -> DataFrame:
    """Trips and passengers per hour of each date.

    Every report below is a sum of these few rows (24 per day), so a job that writes several reports
    scans the trips once.
    """
    return rides.groupBy("year", "month", "weekday", "date", "hour").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("passenger_count").alias("passengers"),
        F.count("passenger_count").alias("passenger_readings"),
    )


def trips_in(counts: DataFrame, *parts: str) -> DataFrame:
    """Trip count per calendar part, from ``calendar_counts``."""
    return counts.groupBy(*parts).agg(F.sum("trips").alias("count")).orderBy(*parts)


def passengers_in(counts: DataFrame, *parts: str) -> DataFrame:
    """Mean passengers per trip and calendar part, from ``calendar_counts``."""
    mean = F.try_divide(F.sum("passengers"), F.sum("passenger_readings"))
    return counts.groupBy(*parts).agg(mean.alias("passenger_avg")).orderBy(*parts)


def trips_per(rides: DataFrame, part: str) -> DataFrame:
    """Trip count per year, month, weekday, date or hour, in calendar order."""
    return rides.groupBy(part).agg(F.count(F.lit(1)).alias("count")).orderBy(part)


def yearly_series(rides: DataFrame, part: str) -> DataFrame:
    """Trip count per year and calendar part: one line per year of a chart."""
    return rides.groupBy("year", part).agg(F.count(F.lit(1)).alias("count")).orderBy("year", part)


def passengers_by_weekday(rides: DataFrame) -> DataFrame:
    return (
        rides.groupBy("weekday").agg(F.avg("passenger_count").alias("passenger_avg")).orderBy("weekday")
    )


def yearly_passengers_by_weekday(rides: DataFrame) -> DataFrame:
    return (
        rides.groupBy("year", "weekday")
        .agg(F.avg("passenger_count").alias("passenger_avg"))
        .orderBy("year", "weekday")
    )
