"""Bus stops, subway stations and parking lots by zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators.ranking import first_and_last, half_flag
from tripweave.operators.zone_match import ZoneIndex, match_areas, match_points

# Columns of the parking lot table that no report uses.
LOT_DROPS = ("the_geom", "FEAT_CODE", "SUB_CODE", "STATUS", "SHAPE_Leng")


def _zone_columns(matched: DataFrame) -> DataFrame:
    return matched.withColumnRenamed("LocationID", "ID")


def point_zones(points: DataFrame, zones: DataFrame | ZoneIndex) -> DataFrame:
    """Each stop with the first zone that contains it; stops outside all zones stay."""
    return _zone_columns(match_points(points, zones)).drop("the_geom")


def lot_zones(lots: DataFrame, zones: DataFrame | ZoneIndex) -> DataFrame:
    """Each lot with the first zone it touches; lots outside all zones stay."""
    return _zone_columns(match_areas(lots, zones)).drop(*LOT_DROPS)


def count_per_zone(placed: DataFrame, name: str) -> DataFrame:
    """Facilities per zone; those outside all zones are one group without an id."""
    return placed.groupBy("ID").agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), "ID")


def area_per_zone(placed: DataFrame, area: str = "SHAPE_Area") -> DataFrame:
    return placed.groupBy("ID").agg(F.sum(area).alias("lot_area")).orderBy(F.desc("lot_area"), "ID")


def lot_figures(placed: DataFrame, area: str = "SHAPE_Area") -> DataFrame:
    """Lots and their area per zone, from one pass."""
    return placed.groupBy("ID").agg(
        F.count(F.lit(1)).alias("lot_nums"), F.sum(area).alias("lot_area")
    )


def facility_figures(area: str = "SHAPE_Area", **placed: DataFrame) -> DataFrame:
    """Facilities per zone and kind, long: ``ID``, ``measure``, ``value``; lots also by their area.

    Each keyword names the count of the placed facilities passed for it. One aggregate serves all.
    """
    parts = []
    for name, table in placed.items():
        figures = [F.struct(F.lit(name).alias("measure"), F.lit(1.0).alias("value"))]
        if area in table.columns:
            figures.append(F.struct(F.lit("lot_area").alias("measure"), F.col(area).alias("value")))
        parts.append(table.select("ID", F.inline(F.array(*figures))))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("ID", "measure").agg(F.sum("value").alias("value"))


def facility_map(zones: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures per zone and measure with the zone's shape, for those that have one."""
    shapes = zones.select("LocationID", "the_geom")
    shown = figures.join(shapes, figures["ID"] == shapes["LocationID"])
    return shown.select("measure", "LocationID", "value", "the_geom")


def parking_counterexamples(
    totals: DataFrame, lots: DataFrame, zones: DataFrame, each: int = 5
) -> DataFrame:
    """Zones where traffic and parking rank alike, against the idea that parking replaces trips.

    Zones are halved by trip count (per direction) and by lot count or lot area; a zone whose
    halves agree is a counterexample. The busiest and the quietest few of every comparison count.
    The four comparisons are groups of one plan, and both inputs have a row per zone.
    """
    traffic = half_flag(
        totals.select("direction", "LocationID", "trip_count"),
        "trip_count",
        "LocationID",
        "traffic_half",
        within=["direction"],
    )
    measures = [
        F.struct(F.lit(name).alias("kind"), F.col(name).cast("double").alias("amount"))
        for name in ("lot_nums", "lot_area")
    ]
    parking = half_flag(
        lots.select(F.col("ID").alias("LocationID"), F.inline(F.array(*measures))),
        "amount",
        "LocationID",
        "parking_half",
        within=["kind"],
    )
    both = traffic.join(parking, "LocationID")
    agree = both.filter(F.col("traffic_half").bitwiseXOR(F.col("parking_half")) == 0)
    chosen = first_and_last(agree, "trip_count", "LocationID", each, within=["direction", "kind"])
    return zones.join(chosen.select("LocationID").distinct(), "LocationID", "left_semi")
