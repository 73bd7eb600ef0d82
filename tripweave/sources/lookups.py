"""Small lookup tables read from CSV, each with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import geometry as geo
from tripweave.schema import FLOW_SCHEMA, TIP_RANGE_LABELS, WEATHER_SCHEMA, ZONE_LOOKUP_SCHEMA


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ZONE_LOOKUP_SCHEMA)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """Trips per hour, weekday and zone pair."""
    return _csv(spark, path, FLOW_SCHEMA)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, WEATHER_SCHEMA)


def read_geometry_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a WKT column; quoted text may hold commas and line breaks."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )


def parse_shapes(df: DataFrame, wkt: str = "the_geom") -> DataFrame:
    """Replace WKT by parsed shapes and say what is wrong with those that have none.

    ``point`` or ``shape`` holds the coordinates. ``problem`` is ``missing`` (null or blank), ``empty``
    (EMPTY, or polygons without three corners) or ``unparsable``; else null. Such rows stay.
    """
    text = F.trim(F.col(wkt))
    pair = geo.wkt_point(text)
    numbers = F.transform(pair, lambda t: t.try_cast("double"))
    parsed = df.withColumns({"point": F.when(F.size(pair) == 2, numbers), "shape": geo.wkt_polygons(text)})
    rings = F.flatten("shape")
    corners = F.aggregate(rings, F.lit(0), lambda most, ring: F.greatest(most, F.size(ring)))
    problem = (
        F.when(text.isNull() | (text == ""), "missing")
        .when(F.col("point").isNotNull(), None)
        .when(text.rlike(r"(?i)^\s*(MULTI)?[A-Z]+\s*[ZM]*\s*EMPTY$"), "empty")
        .when(F.col("shape").isNull(), "unparsable")
        .when(corners < 3, "empty")
    )
    kept = {name: F.when(F.col("problem").isNull(), F.col(name)) for name in ("point", "shape")}
    return parsed.withColumn("problem", problem).withColumns(kept).drop(wkt)


def tip_ranges(spark: SparkSession) -> DataFrame:
    """Text of each tip bucket: a fixed list of ten."""
    return spark.createDataFrame(
        list(enumerate(TIP_RANGE_LABELS)), "tip_range_index bigint, range string"
    )
