"""Speed by zone, hour, weekday and borough pair, from the speed-cleaned trips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc
from tripweave.operators import distributions as dist
from tripweave.operators import quantile_sketches as sketches
from tripweave.operators.quantiles import grouped_median, grouped_quantiles
from tripweave.operators.sampling import sample_with_replacement
from tripweave.operators.trip_ends import at_both_ends
from tripweave.plans.zones import with_both_zones
from tripweave.schema import BOROUGH_ORDER
from tripweave.session import cut_and_measure

PAIR_HOUR = ("hour", "weekday", "PULocationID", "DOLocationID")


def zone_speed_box(
    trips: DataFrame, as_reference: bool = False, accuracy: int | None = None
) -> DataFrame:
    """Smallest, largest and quartile speeds per zone, over trips that start or end there.

    ``as_reference`` counts a trip at its pickup zone only.
    """
    if as_reference:
        rides = trips.select(F.col("PULocationID").alias("LocationID"), "speed")
    else:
        rides = at_both_ends(trips.select("PULocationID", "DOLocationID", "speed"))
    return grouped_quantiles(
        rides,
        ["LocationID"],
        "speed",
        {"median": 0.5, "Q2": 0.25, "Q4": 0.75},
        {"min": ("min", "speed"), "max": ("max", "speed")},
        accuracy=accuracy,
    )


def monthly_speed_sketches(trips: DataFrame) -> DataFrame:
    """Sketches of speed per pickup zone, year and month: stored once, merged for any window."""
    months = trips.select(
        F.col("PULocationID").alias("LocationID"),
        F.year("pickup_datetime").alias("year"),
        F.month("pickup_datetime").alias("month"),
        "speed",
    )
    return sketches.sketch_groups(months, ["LocationID", "year", "month"], "speed")


def zone_speed_from_sketches(
    monthly: DataFrame, quantiles: Mapping[str, float], window: Column | None = None
) -> DataFrame:
    """Quantiles per zone over the months of a window, without a trip being read."""
    chosen = monthly if window is None else monthly.where(window)
    return sketches.quantiles_of(
        sketches.merge_sketches(chosen, ["LocationID"]), ["LocationID"], quantiles
    )


def zone_speed_median(trips: DataFrame) -> DataFrame:
    """Median speed per pickup zone to two digits."""
    return grouped_median(trips, ["PULocationID"], "speed")


def speed_by_hour_weekday(trips: DataFrame) -> DataFrame:
    return (
        trips.groupBy("hour", "weekday")
        .agg(F.avg("speed").alias("average"))
        .orderBy("average", "hour", "weekday")
    )


def destination_medians(trips: DataFrame, accuracy: int | None = None) -> DataFrame:
    return grouped_quantiles(trips, ["DOLocationID"], "speed", {"median": 0.5}, accuracy=accuracy)


def slowest_of(medians: DataFrame, top: int = 10) -> DataFrame:
    return medians.orderBy("median", "DOLocationID").limit(top)


def fastest_of(medians: DataFrame, top: int = 10) -> DataFrame:
    return medians.orderBy(F.desc("median"), "DOLocationID").limit(top)


def slowest_destinations(trips: DataFrame, top: int = 10, accuracy: int | None = None) -> DataFrame:
    return slowest_of(destination_medians(trips, accuracy), top)


def fastest_destinations(trips: DataFrame, top: int = 10, accuracy: int | None = None) -> DataFrame:
    return fastest_of(destination_medians(trips, accuracy), top)


def borough_pair_figures(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Mean speed and number of trips per borough pair, from one pass."""
    pairs = with_both_zones(trips, zones, "borough")
    return pairs.groupBy("PUborough", "DOborough").agg(
        F.avg("speed").alias("avg_speed"), F.count(F.lit(1)).alias("count")
    )


def borough_pair_speed(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return borough_pair_figures(trips, zones).drop("count")


def borough_pair_count(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return borough_pair_figures(trips, zones).drop("avg_speed")


def borough_pair_ranked(
    pair_speed: DataFrame, order: Sequence[str] = BOROUGH_ORDER
) -> DataFrame:
    """Borough pairs from slow to fast, each labelled with the two borough indexes."""
    label = tc.pair_label(tc.borough_index("PUborough", order), tc.borough_index("DOborough", order))
    return pair_speed.withColumn("start_end", label).orderBy("avg_speed", "start_end")


def borough_chord_links(pair_speed: DataFrame, order: Sequence[str] = BOROUGH_ORDER) -> DataFrame:
    """Borough pairs as (source, target, value) links."""
    return pair_speed.select(
        tc.borough_index("PUborough", order).alias("source"),
        tc.borough_index("DOborough", order).alias("target"),
        F.col("avg_speed").alias("value"),
    )


def zone_pair_hour_speed(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*PAIR_HOUR).agg(F.avg("speed").alias("average_speed"))


def trip_count_by(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def zone_pair_hour_count(trips: DataFrame) -> DataFrame:
    """The flow table: trips per hour, weekday and zone pair."""
    return trip_count_by(trips, *PAIR_HOUR)


def hour_weekday_count(trips: DataFrame) -> DataFrame:
    return trip_count_by(trips, "hour", "weekday")


def zone_pair_count(trips: DataFrame) -> DataFrame:
    return trip_count_by(trips, "PULocationID", "DOLocationID")


def speed_and_flow(trips: DataFrame) -> DataFrame:
    """Average speed and trip count per hour, weekday and zone pair, in one aggregate."""
    return trips.groupBy(*PAIR_HOUR).agg(
        F.avg("speed").alias("average_speed"), F.count(F.lit(1)).cast("double").alias("count")
    )


def speed_flow_correlation(trips: DataFrame) -> DataFrame:
    return dist.correlation_matrix(speed_and_flow(trips), "average_speed", "count")


def speed_correlation(
    trips: DataFrame, feature: str, fraction: float | None = None, seed: int = 17
) -> DataFrame:
    """Correlation matrix of speed and one feature; over all trips unless a fraction is given."""
    return speed_correlations(trips, [feature], fraction, seed)


def speed_correlations(
    trips: DataFrame, features: Sequence[str], fraction: float | None = None, seed: int = 17
) -> DataFrame:
    """Correlation matrix of speed and several features from one pass."""
    rides = trips if fraction is None else sample_with_replacement(trips, fraction, seed)
    return dist.correlation_matrix(rides, "speed", *features)


def speed_histogram(trips: DataFrame, bins: int = 200) -> DataFrame:
    return dist.histogram(trips.filter(F.col("speed") > 0), "speed", bins)


def duration_histogram(trips: DataFrame, bins: int = 200, below: float = 600) -> DataFrame:
    minutes = trips.select((F.col("duration") / 60).alias("minutes"))
    return dist.histogram(
        minutes.filter((F.col("minutes") > 0) & (F.col("minutes") < below)), "minutes", bins
    )


# What the speed report reads of a trip.
REPORT_COLUMNS = (
    "pickup_datetime",
    "dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "hour",
    "weekday",
    "speed",
    "duration",
    "tip_percentage",
)


@dataclass
class ReportRides:
    """The columns of a report written once, and the bounds of its histograms, seen on the way."""

    rides: DataFrame
    bounds: dict[str, tuple[float | None, float | None]]


def _charted(below: float) -> dict[str, Column]:
    """Values that the histograms count; null for those they leave out."""
    minutes = F.col("duration") / 60
    return {
        "speed": F.when(F.col("speed") > 0, F.col("speed")),
        "minutes": F.when((minutes > 0) & (minutes < below), minutes),
    }


def report_rides(trips: DataFrame, below: float = 600) -> ReportRides:
    """One pass over the trips, from which all parts of the report are made."""
    values = _charted(below)
    measures = {f"{name}_low": F.min(value) for name, value in values.items()}
    measures |= {f"{name}_high": F.max(value) for name, value in values.items()}
    rides, seen = cut_and_measure(trips.select(*REPORT_COLUMNS), **measures)
    return ReportRides(rides, {n: (seen.get(f"{n}_low"), seen.get(f"{n}_high")) for n in values})


def chart_figures(report: ReportRides, bins: int = 200, below: float = 600) -> DataFrame:
    """Mean speed and trips per (hour, weekday), and trips per bin of both histograms, in one aggregate."""
    placed = {}
    for name, value in _charted(below).items():
        low, high = report.bounds[name]
        if low is None:
            at = F.lit(None)
        elif low == high:
            at = F.when(value.isNotNull(), 0)
        else:
            position = F.floor((value - F.lit(low)) * bins / (F.lit(high) - F.lit(low)))
            at = F.when(value.isNotNull(), F.least(position, F.lit(bins - 1)))
        placed[f"{name}_bin"] = at.cast("bigint")
    sets = [["hour", "weekday"], ["speed_bin"], ["minutes_bin"]]
    keys = [key for group in sets for key in group]
    return (
        report.rides.select("hour", "weekday", "speed", *[c.alias(n) for n, c in placed.items()])
        .groupingSets(sets, *keys)
        .agg(
            F.grouping_id().alias("part"), F.avg("speed").alias("average"), F.count(F.lit(1)).alias("count")
        )
    )


# Bits of ``grouping_id``: which of hour, weekday, speed_bin, minutes_bin a row does not have.
_HOURS, _BINS = 0b0011, {"speed": 0b1101, "minutes": 0b1110}


def hour_weekday_of(figures: DataFrame) -> DataFrame:
    hours = figures.where(F.col("part") == _HOURS).select("hour", "weekday", "average")
    return hours.orderBy("average", "hour", "weekday")


def histogram_of(figures: DataFrame, report: ReportRides, name: str, bins: int = 200) -> DataFrame:
    """A histogram with its empty bins, as ``speed_histogram`` and ``duration_histogram`` have it."""
    low, high = report.bounds[name]
    counted = figures.where(F.col("part") == _BINS[name]).select(
        F.col(f"{name}_bin").alias("bin"), F.col("count").alias("_n")
    )
    start, step = F.lit(low).cast("double"), F.lit(None if low is None else (high - low) / bins).cast("double")
    every = figures.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted.where("bin IS NOT NULL"), "bin", "left").select(
        "bin",
        (start + F.col("bin") * step).alias("bin_start"),
        (start + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def speed_weekday_hour_pivot(hour_weekday_speed: DataFrame) -> DataFrame:
    """Whole-number average speed, one row per weekday and one column per hour."""
    whole = hour_weekday_speed.withColumn("average", F.col("average").cast("int"))
    return dist.pivot_mean(whole, "weekday", "hour", "average", range(24), "hour_").orderBy("weekday")


# What tells one trip from another in samples and splits.
TRIP_KEY = ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID")


def tip_speed_points(trips: DataFrame, fraction: float = 0.005, seed: int = 17) -> DataFrame:
    """A sample of (speed, tip share) points of tipped trips."""
    drawn = sample_with_replacement(trips, fraction, seed, by=TRIP_KEY)
    return drawn.filter(F.col("tip_percentage") > 0).select("speed", "tip_percentage")


def zone_speed_map(zones: DataFrame, box: DataFrame) -> DataFrame:
    """Every zone shape with its speed figures, NULL where no trip was seen."""
    return zones.join(box, "LocationID", "left")
