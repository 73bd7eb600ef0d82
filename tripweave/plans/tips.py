"""Tip analyses: by vendor, over time, by distribution and by location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc
from tripweave.operators import distributions as dist
from tripweave.operators import quality
from tripweave.operators.quantiles import grouped_quantiles
from tripweave.operators.trip_ends import at_both_ends, with_direction
from tripweave.schema import FIRST_YEAR, LAST_YEAR, TIP_INPUT_COLUMNS


def plausible_rides(
    trips: DataFrame,
    max_distance: float | None = 180,
    known_zones_only: bool = False,
    min_minutes: int | None = None,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
) -> DataFrame:
    """Card-paid trips of the main vendors whose fare fits the distance."""
    rides = trips.select(*TIP_INPUT_COLUMNS)
    rides = quality.main_vendors(quality.paid_by(rides, 1))
    rides = quality.distance_within(rides, 0, max_distance)
    rides = quality.years_within(rides, first, last, columns=("pickup_datetime",))
    if known_zones_only:
        rides = quality.zones_below(rides)
    rides = quality.at_most_minutes(rides, 180, min_minutes)
    return quality.fare_in_band(rides)


def tip_features(trips: DataFrame) -> DataFrame:
    """Tip ratio, its bucket in ten-percent steps, and day and hour, for the first look."""
    return plausible_rides(trips, max_distance=None).select(
        "VendorID",
        tc.tip_ratio().alias("tip_ratio"),
        "tip_amount",
        tc.other_ratio().alias("other_fare_ratio"),
        "trip_distance",
        "fare_amount",
        "total_amount",
        F.dayofweek("pickup_datetime").alias("day"),
        F.hour("pickup_datetime").alias("hour"),
        tc.tip_bucket(10, 2).alias("tip_range_index"),
    )


def tip_by_vendor(features: DataFrame, accuracy: int | None = None) -> DataFrame:
    return grouped_quantiles(
        features,
        ["VendorID"],
        "tip_ratio",
        {"median": 0.5},
        {"mean": ("avg", "tip_ratio")},
        accuracy=accuracy,
    )


def tip_day_hour(features: DataFrame) -> DataFrame:
    """Mean tip percentage, one row per weekday and one column per hour."""
    percent = features.withColumn("percent", F.col("tip_ratio") * 100)
    return dist.pivot_mean(percent, "day", "hour", "percent", range(24), "hour_").orderBy("day")


def tip_feature_points(features: DataFrame) -> DataFrame:
    """The points of the tip charts: tipped trips without extreme charges."""
    shown = features.filter(
        (F.col("tip_ratio") > 0)
        & (F.col("tip_ratio") <= 1)
        & (F.col("fare_amount") <= 80)
        & (tc.other_charges() <= 40)
    )
    return shown.select(
        "tip_range_index",
        "tip_ratio",
        "fare_amount",
        "trip_distance",
        tc.before_tip().alias("total_fare"),
        tc.other_charges().alias("other_amount"),
    )


def tip_histograms(points: DataFrame, bins: int = 10) -> DataFrame:
    """Histograms of tip ratio and other charges, told apart by ``feature``."""
    return dist.histograms(points, ["tip_ratio", "other_amount"], bins)


def tip_overview(trips: DataFrame) -> DataFrame:
    """Tip ratio and its bucket in five-percent steps, with the calendar, for the overview."""
    return plausible_rides(trips).select(
        tc.tip_ratio().alias("tip_ratio"),
        "tip_amount",
        tc.other_ratio().alias("other_fare_ratio"),
        F.year("pickup_datetime").alias("year"),
        F.month("pickup_datetime").alias("month"),
        F.to_date("pickup_datetime").alias("date"),
        tc.duration_minutes().alias("duration"),
        "trip_distance",
        "PULocationID",
        "DOLocationID",
        tc.tip_bucket(20, 8).alias("tip_range_index"),
    )


def _in_percent(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({column: F.col(column) * 100 for column in columns})


def tip_by_year(overview: DataFrame, accuracy: int | None = None) -> DataFrame:
    yearly = grouped_quantiles(
        overview,
        ["year"],
        "tip_ratio",
        {"median_percent": 0.5},
        {"mean_percent": ("avg", "tip_ratio")},
        accuracy=accuracy,
    )
    return _in_percent(yearly, "mean_percent", "median_percent").orderBy("year")


def tip_distribution(overview: DataFrame) -> DataFrame:
    """Trips per year and tip bucket, with the bucket's share of its year."""
    counted = overview.groupBy("year", "tip_range_index").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("ratio_of_year", dist.share_within(counted, "year")).orderBy(
        "year", "tip_range_index"
    )


def tip_distribution_labeled(distribution: DataFrame, ranges: DataFrame) -> DataFrame:
    """The distribution with the text of each bucket in place of its number."""
    return (
        distribution.join(ranges, "tip_range_index")
        .orderBy("year", "tip_range_index")
        .select("year", "range", "count", "ratio_of_year")
    )


def tip_daily(overview: DataFrame, accuracy: int | None = None) -> DataFrame:
    daily = grouped_quantiles(
        overview,
        ["year", "date"],
        "tip_ratio",
        {"median_percent": 0.5},
        {
            "mean_percent": ("avg", "tip_ratio"),
            "max_amount": ("max", "tip_amount"),
            "count": ("count", None),
        },
        accuracy=accuracy,
    )
    return _in_percent(daily, "mean_percent", "median_percent").orderBy("year", "date")


def tip_locations(trips: DataFrame) -> DataFrame:
    """Tip ratio, year and month of trips between known zones."""
    return plausible_rides(trips, known_zones_only=True).select(
        "PULocationID",
        "DOLocationID",
        "tip_amount",
        tc.tip_ratio().alias("tip_ratio"),
        F.year("pickup_datetime").alias("year"),
        F.month("pickup_datetime").alias("month"),
    )


def _tip_by_end(located: DataFrame, end: str, accuracy: int | None) -> DataFrame:
    by_zone = grouped_quantiles(
        located,
        [end],
        "tip_ratio",
        {"median": 0.5},
        {"avg": ("avg", "tip_ratio"), "count": ("count", None)},
        accuracy=accuracy,
    )
    return by_zone.select(end, "avg", "median", "count").orderBy(F.desc("avg"), end)


def tip_by_pickup(located: DataFrame, accuracy: int | None = None) -> DataFrame:
    return _tip_by_end(located, "PULocationID", accuracy)


def tip_by_dropoff(located: DataFrame, accuracy: int | None = None) -> DataFrame:
    return _tip_by_end(located, "DOLocationID", accuracy)


def is_petty() -> Column:
    return F.col("tip_amount") == 0


def is_generous(threshold: float = 0.4) -> Column:
    return F.col("tip_ratio") >= threshold


def _monthly_with_inner_trips(located: DataFrame) -> DataFrame:
    """Zone figures per month by inclusion and exclusion, for months with a trip inside the zone.

    Both ends of a trip are aggregated in one pass; a trip within one zone is counted at its pickup
    end only when the overlap is taken off again.
    """
    ends = with_direction(located)
    sides = _sides()
    monthly = ends.groupBy("year", "month", F.col("LocationID").alias("locationID")).agg(
        *[F.count_if(side).alias(f"{name}_n") for name, side in sides.items()],
        *[F.avg(F.when(side, F.col("tip_ratio"))).alias(f"{name}_avg") for name, side in sides.items()],
        F.max("tip_amount").alias("max"),
    )
    present = monthly.filter(
        (F.col("pu_n") > 0) & (F.col("do_n") > 0) & (F.col("same_n") > 0)
    )
    n = F.col("pu_n") + F.col("do_n") - F.col("same_n")
    weighted = (
        F.col("pu_avg") * F.col("pu_n")
        + F.col("do_avg") * F.col("do_n")
        - F.col("same_n") * F.col("same_avg")
    )
    return present.select(
        "year", "month", "locationID", (weighted / n).alias("avg"), n.alias("count"), "max"
    )


def tip_by_location(located: DataFrame, as_reference: bool = False) -> DataFrame:
    """Tips per zone over the trips that start or end there, each trip once.

    ``as_reference`` leaves out a zone's months without any trip inside the zone.
    """
    if as_reference:
        zones = (
            _monthly_with_inner_trips(located)
            .groupBy("locationID")
            .agg(
                (F.sum(F.col("avg") * F.col("count")) / F.sum("count")).alias("avg"),
                F.max("max").alias("max"),
                F.sum("count").alias("count"),
            )
        )
    else:
        zones = (
            at_both_ends(located, "locationID", once=True)
            .groupBy("locationID")
            .agg(
                F.avg("tip_ratio").alias("avg"),
                F.max("tip_amount").alias("max"),
                F.count(F.lit(1)).alias("count"),
            )
        )
    return zones.orderBy(F.desc("avg"), "locationID")


def _sides() -> dict[str, Column]:
    """A row of a trip's end: at its start, at its end, or at the start of a trip within one zone."""
    at_start, at_end = F.col("direction") == "PU", F.col("direction") == "DO"
    inner = at_start & (F.col("PULocationID") == F.col("DOLocationID"))
    return {"pu": at_start, "do": at_end, "same": inner}


def _monthly_counts_with_inner_trips(located: DataFrame, subset: Column) -> DataFrame:
    """Trips of the subset and all trips per zone, each over its months with a trip inside the zone.

    Both counts come from one pass over the trips.
    """
    ends = with_direction(located.withColumn("_in", subset))
    counts = []
    for name, rows in (("part", F.col("_in")), ("all", F.lit(True))):
        counts += [F.count_if(rows & side).alias(f"{name}_{key}") for key, side in _sides().items()]
    monthly = ends.groupBy("year", "month", F.col("LocationID").alias("locationID")).agg(*counts)

    def trips(name: str) -> Column:
        pu, do, same = (F.col(f"{name}_{key}") for key in ("pu", "do", "same"))
        return F.sum(F.when((pu > 0) & (do > 0) & (same > 0), pu + do - same))

    return (
        monthly.groupBy("locationID")
        .agg(trips("part").alias("count"), trips("all").alias("all_count"))
        .filter("count IS NOT NULL")
    )


def subset_by_location(
    located: DataFrame, subset: Column, ratio: str, as_reference: bool = False
) -> DataFrame:
    """How many of a zone's trips belong to ``subset``, and their share; zones without any are left out."""
    if as_reference:
        both = _monthly_counts_with_inner_trips(located, subset)
    else:
        both = (
            at_both_ends(located.withColumn("_in", subset), "locationID", once=True)
            .groupBy("locationID")
            .agg(F.count_if("_in").alias("count"), F.count(F.lit(1)).alias("all_count"))
            .filter(F.col("count") > 0)
        )
    return both.select(
        "locationID", "count", (F.col("count") / F.col("all_count")).alias(ratio)
    ).orderBy(ratio, F.desc("count"), "locationID")


def petty_by_location(located: DataFrame, as_reference: bool = False) -> DataFrame:
    """Trips without a tip."""
    return subset_by_location(located, is_petty(), "petty_ratio", as_reference)


def generous_by_location(
    located: DataFrame, threshold: float = 0.4, as_reference: bool = False
) -> DataFrame:
    """Trips tipped at least ``threshold`` of the bill before the tip."""
    return subset_by_location(located, is_generous(threshold), "generous_ratio", as_reference)


def location_report(
    lookup: DataFrame,
    result: DataFrame,
    order: str,
    index: str = "locationID",
    above: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Every zone of the lookup with its result, best first.

    ``above`` keeps zones with more trips than that; ``top`` keeps the first so many.
    """
    named = lookup.withColumnRenamed("LocationID", index).join(result, index, "left")
    if above is not None:
        named = quality.count_above(named, above)
    named = named.orderBy(F.col(order).desc_nulls_last(), index)
    return named if top is None else named.limit(top)


def location_map(zones: DataFrame, result: DataFrame, index: str = "locationID") -> DataFrame:
    """Every zone shape with its result."""
    return zones.join(result.withColumnRenamed(index, "LocationID"), "LocationID", "left")
