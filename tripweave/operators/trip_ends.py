"""A trip belongs to the zone it starts in and to the zone it ends in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_both_ends(df: DataFrame, name: str = "LocationID", once: bool = False) -> DataFrame:
    """One row per trip and end; ``once`` counts a trip within one zone a single time."""
    ends = F.array("PULocationID", "DOLocationID")
    return df.withColumn(name, F.explode(F.array_distinct(ends) if once else ends))


def with_direction(df: DataFrame) -> DataFrame:
    """One row per trip and end, marked ``PU`` or ``DO``."""
    ends = F.array(
        F.struct(F.lit("PU").alias("direction"), F.col("PULocationID").alias("LocationID")),
        F.struct(F.lit("DO").alias("direction"), F.col("DOLocationID").alias("LocationID")),
    )
    return df.select("*", F.inline(ends))
