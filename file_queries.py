"""Queries that write files by the library's sinks and read them back by its sources.

What comes back is compared with SQL over the tables: contents, and the order in which reports were
written. Files go to a new folder under the session's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators import quantile_sketches as sketches
from tripweave.plans import cleaning, demand, facilities, speed, tips, weather, zone_counts, zones
from tripweave.session import shared_folder
from tripweave.sources import lookups, sample_tables, sinks, tripdata, views

# Ranks of stored sketches may be off by this share of a zone's trips: several times the usual error.
SKETCH_ERROR = 0.03

Query = Callable[[SparkSession, str], DataFrame]


def _written_months(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "months")
    for color, raw in zip(("yellow", "green"), sample_tables.raw_colors(spark, sf_dir)):
        sinks.write_months(raw.drop("color"), root, color)
    return root


def _files_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months under their file names, read back with the tags that the names give."""
    trips = tripdata.read_trip_files(spark, _written_months(spark, sf_dir), years=None)
    return trips.groupBy("color", "file_year", "file_month").agg(
        F.count(F.lit(1)).alias("trips"),
        F.round(F.sum(F.col("total_amount").cast("decimal(18,2)")), 2).cast("double").alias("total"),
        F.min("pickup_datetime").cast("string").alias("first_pickup"),
    )


def _files_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both colors merged from their files."""
    parts = tripdata.read_trip_parts(spark, _written_months(spark, sf_dir), years=None)
    return tripdata.trips_union(parts)


def _files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-cleaned trips as a table by color, year and month; a second run replaces the first."""
    path = shared_folder(spark, "table")
    rides = cleaning.clean_time(sample_tables.raw_colors(spark, sf_dir))
    for _ in range(2):
        sinks.write_table(rides, path, *tripdata.TAG_COLUMNS)
    return demand.trips_per(tripdata.read_trips(spark, path), "month")


def _files_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counts written by direction, color, year and month, summed after reading."""
    path = shared_folder(spark, "counts")
    monthly = zone_counts.monthly_zone_counts(
        zone_counts.counted_rides(sample_tables.trips(spark, sf_dir))
    )
    sinks.write_table(monthly, path, "direction", "color", "year", "month")
    return zone_counts.zone_counts_total(tripdata.read_zone_counts(spark, path))


def _files_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "lookup")
    sinks.write_report(sample_tables.zone_lookup(spark, sf_dir), path, ["LocationID"], "errorifexists")
    return lookups.read_zone_lookup(spark, path)


def _files_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "weather")
    readings = sample_tables.weather(spark, sf_dir)
    unread = [F.lit(None).cast("string").alias(name) for name in ("departure", "HDD", "CDD")]
    read = [F.col(name) for name in readings.columns]
    sinks.write_report(readings.select(*read[:4], *unread, *read[4:]), path)
    daily = weather.daily_weather(lookups.read_weather(spark, path))
    return daily.withColumns({"date": F.col("date").cast("string"), "tavg": F.round("tavg", 6)})


def _files_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops and zones as CSV with quoted WKT; matched stops as Parquet."""
    root = shared_folder(spark, "stops")
    sinks.write_report(sample_tables.bus_stops(spark, sf_dir), f"{root}/stops")
    sinks.write_report(sample_tables.zones(spark, sf_dir), f"{root}/zones")
    shapes = lookups.read_geometry_csv(spark, f"{root}/zones")
    shapes = shapes.withColumn("LocationID", F.col("LocationID").cast("long"))
    stops = lookups.read_geometry_csv(spark, f"{root}/stops")
    sinks.write_table(facilities.point_zones(stops, shapes), f"{root}/with_location")
    return spark.read.parquet(f"{root}/with_location").withColumn(
        "stop_id", F.col("stop_id").cast("long")
    )


def _view_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered view read by SQL."""
    views.register(speed_rides=cleaning.clean_speed(sample_tables.trips(spark, sf_dir)))
    return spark.sql("SELECT hour, weekday, count(*) AS count FROM speed_rides GROUP BY hour, weekday")


def _report(df: DataFrame, name: str, order: list, schema: str, **options) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    sinks.write_report(df, path, order, **options)
    return sinks.read_report(df.sparkSession, path, schema, "position")


def _report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file in calendar order."""
    rides = cleaning.clean_time(sample_tables.raw_colors(spark, sf_dir))
    days = demand.trips_per(rides, "date")
    return _report(days, "days", ["date"], "date string, count bigint")


def _report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files, ranges of the order: by direction, busiest zones first."""
    monthly = zone_counts.monthly_zone_counts(
        zone_counts.counted_rides(sample_tables.trips(spark, sf_dir))
    )
    order = ["direction", F.desc("trip_count"), "LocationID"]
    schema = "direction string, LocationID bigint, trip_count bigint"
    return _report(zone_counts.zone_counts_total(monthly), "counts", order, schema, single_file=False)


def _report_petty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column ascending, one descending."""
    petty = tips.petty_by_location(tips.tip_locations(sample_tables.trips(spark, sf_dir)))
    petty = petty.withColumn("petty_ratio", F.round("petty_ratio", 6))
    order = ["petty_ratio", F.desc("count"), "locationID"]
    return _report(petty, "petty", order, "locationID bigint, count bigint, petty_ratio double")


def _report_boroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow pairs first."""
    rides = cleaning.clean_speed(sample_tables.trips(spark, sf_dir))
    dim = zones.zone_dimension(sample_tables.zones(spark, sf_dir))
    ranked = speed.borough_pair_ranked(
        speed.borough_pair_speed(rides, dim), sample_tables.REGION_ORDER
    ).withColumn("avg_speed", F.round("avg_speed", 6))
    schema = "PUborough string, DOborough string, avg_speed double, start_end string"
    return _report(ranked, "boroughs", ["avg_speed", "start_end"], schema)


def _report_tip_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per year."""
    path = shared_folder(spark, "tip-days")
    daily = tips.tip_daily(tips.tip_overview(sample_tables.trips(spark, sf_dir)))
    sinks.write_report_by(daily, path, "year", order=["date"])
    # The partition column is read from the folders' names.
    kinds = [f"{name} {kind}" for name, kind in daily.dtypes if name != "year"] + ["year int"]
    rows = sinks.read_report(spark, path, ", ".join(kinds))
    rounded = {name: F.round(name, 6) for name in ("mean_percent", "median_percent")}
    return rows.withColumns({**rounded, "date": F.col("date").cast("string")})


def _sketch_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sketches, stored, merged for all months and for 2019; are their ranks near the true ones?"""
    path = shared_folder(spark, "sketches")
    rides = cleaning.clean_speed(sample_tables.trips(spark, sf_dir))
    sinks.write_table(speed.monthly_speed_sketches(rides), path, "year")
    monthly = spark.read.parquet(path)
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rides = rides.withColumn("LocationID", F.col("PULocationID"))
    parts = []
    for name, window, rows in (
        ("all", F.lit(True), rides),
        ("2019", F.col("year") == 2019, rides.where(F.year("pickup_datetime") == 2019)),
    ):
        answers = speed.zone_speed_from_sketches(monthly, wanted, window)
        errors = sketches.rank_errors(rows, ["LocationID"], "speed", answers, wanted)
        near = [(F.col(q) <= SKETCH_ERROR).alias(f"{q}_near") for q in wanted]
        parts.append(errors.select(F.lit(name).alias("months"), "LocationID", F.col("n").alias("trips"), *near))
    return parts[0].unionByName(parts[1])


def queries() -> dict[str, Query]:
    return {
        "files_months": _files_months,
        "files_union": _files_union,
        "files_table": _files_table,
        "files_zone_counts": _files_zone_counts,
        "files_lookup": _files_lookup,
        "files_weather": _files_weather,
        "files_stops": _files_stops,
        "view_hours": _view_hours,
        "report_days": _report_days,
        "report_counts": _report_counts,
        "report_petty": _report_petty,
        "report_boroughs": _report_boroughs,
        "report_tip_days": _report_tip_days,
        "sketch_quartiles": _sketch_quartiles,
    }
