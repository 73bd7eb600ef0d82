"""The zone dimension: one row per location id, with the middle of its bounding box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import geometry as geo
from tripweave.session import broadcast_if_small

# A generous size for one zone's id, names and centre.
ZONE_BYTES = 256


def zone_dimension(zones: DataFrame, wkt: str = "the_geom") -> DataFrame:
    """Zones with longitude and latitude of their centre.

    An id that appears on several rows (a zone of several parts) becomes one row around all of
    them, so that joining trips to zones never multiplies trips.
    """
    box = geo.bounding_box(geo.wkt_polygons(F.col(wkt)))
    boxed = zones.select("LocationID", "zone", "borough", box.alias("box"))
    return boxed.groupBy("LocationID").agg(
        F.min("zone").alias("zone"),
        F.min("borough").alias("borough"),
        ((F.min("box.min_x") + F.max("box.max_x")) / 2).alias("longitude"),
        ((F.min("box.min_y") + F.max("box.max_y")) / 2).alias("latitude"),
    )


def with_both_zones(trips: DataFrame, zones: DataFrame, *columns: str) -> DataFrame:
    """Add zone columns for both ends, prefixed ``PU`` and ``DO``; unknown zones drop out.

    The zones are measured once; both joins are broadcasts unless the zone table is large.
    """
    zones = broadcast_if_small(zones.select("LocationID", *columns), ZONE_BYTES)
    for end in ("PU", "DO"):
        side = zones.select(
            F.col("LocationID").alias(f"{end}LocationID"),
            *[F.col(column).alias(f"{end}{column}") for column in columns],
        )
        trips = trips.join(side, f"{end}LocationID")
    return trips
