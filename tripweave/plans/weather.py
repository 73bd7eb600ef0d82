"""Daily weather readings made ready for joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc


def daily_weather(readings: DataFrame) -> DataFrame:
    """Date, mean temperature in Celsius, and whether it snowed or rained."""
    return readings.select(
        F.to_date("date", "d/M/yy").alias("date"),
        tc.celsius("tavg").alias("tavg"),
        (tc.measured("new_snow") | tc.measured("snow_depth")).cast("int").alias("has_snow"),
        tc.measured("precipitation").cast("int").alias("has_rain"),
    )
