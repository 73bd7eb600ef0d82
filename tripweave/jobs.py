"""Command line jobs that read tables and write reports.

    python -m tripweave.jobs JOB --help
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.plans import (
    cleaning,
    demand,
    facilities,
    models,
    speed,
    tips,
    weather,
    zone_counts,
    zones,
)
from tripweave.operators.zone_match import ZoneIndex
from tripweave.schema import BOROUGH_ORDER
from tripweave.session import cut_lineage
from tripweave.sources import lookups, sinks, tripdata

# Kinds of cleaning that take every file of the folder unless --years says otherwise.
ALL_YEARS = ("speed", "union")


def _wanted(args: argparse.Namespace, study_years: bool) -> dict:
    """The months to read: --years and --colors, else the study years or all years."""
    chosen = {"colors": args.colors} if args.colors else {}
    if args.years:
        chosen["years"] = args.years
    elif not study_years:
        chosen["years"] = None
    return chosen


def _zone_shapes(spark: SparkSession, path: str) -> DataFrame:
    shapes = lookups.read_geometry_csv(spark, path)
    return shapes.withColumn("LocationID", F.col("LocationID").cast("long"))


def _speed_rides(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return cleaning.clean_speed(tripdata.read_trips(spark, args.trips))


def clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Clean the monthly trip files under --raw; --kind names the rules."""
    # The parts keep their own columns, which the payment rules look at.
    parts = tripdata.read_trip_parts(spark, args.raw, **_wanted(args, args.kind not in ALL_YEARS))
    rules = {
        "general": lambda: cleaning.clean_general(parts),
        "payment": lambda: cleaning.clean_by_payment(parts),
        "time": lambda: cleaning.clean_time(parts),
        "speed": lambda: cleaning.clean_speed(tripdata.union_trips(parts)),
        "union": lambda: tripdata.trips_union(parts),
    }
    cleaned = rules[args.kind]()
    sinks.write_table(cleaned, args.out, *[c for c in tripdata.TAG_COLUMNS if c in cleaned.columns])


def time_report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Trips per year, month, weekday, date and hour, and mean passengers, from the time table."""
    counts = cut_lineage(demand.calendar_counts(tripdata.read_trips(spark, args.trips)))
    for part in ("year", "month", "weekday", "date", "hour"):
        sinks.write_report(demand.trips_in(counts, part), f"{args.out}/{part}", [part])
    for part in ("month", "weekday", "date", "hour"):
        sinks.write_report_by(
            demand.trips_in(counts, "year", part), f"{args.out}/{part}_by_year", "year", order=[part]
        )
    sinks.write_report(demand.passengers_in(counts, "weekday"), f"{args.out}/passenger", ["weekday"])
    sinks.write_report_by(
        demand.passengers_in(counts, "year", "weekday"),
        f"{args.out}/passenger_by_year",
        "year",
        order=["weekday"],
    )


def speed_report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Speed per zone, hour, weekday and zone pair, and the speed charts."""
    report = speed.report_rides(_speed_rides(spark, args))
    rides = report.rides
    figures = cut_lineage(speed.chart_figures(report))
    by_hour = speed.hour_weekday_of(figures)
    medians = cut_lineage(speed.destination_medians(rides))
    sinks.write_report(speed.zone_speed_box(rides), f"{args.out}/box_plot", ["LocationID"])
    sinks.write_report(by_hour, f"{args.out}/24hour_speed", ["average"])
    sinks.write_report(speed.slowest_of(medians), f"{args.out}/worst10", ["median"])
    sinks.write_report(speed.fastest_of(medians), f"{args.out}/best10", [F.desc("median")])
    sinks.write_report(speed.speed_weekday_hour_pivot(by_hour), f"{args.out}/24hour_pivot", ["weekday"])
    for name, folder in (("speed", "speed_distribution"), ("minutes", "duration_distribution")):
        sinks.write_report(speed.histogram_of(figures, report, name), f"{args.out}/{folder}", ["bin"])
    sinks.write_report(speed.tip_speed_points(rides), f"{args.out}/tip_speed", single_file=False)


def flow_report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Trip counts and speeds per hour, weekday and zone pair, and their correlation."""
    rides = _speed_rides(spark, args)
    flow = cut_lineage(
        rides.groupBy(*speed.PAIR_HOUR).agg(
            F.avg("speed").alias("average_speed"), F.count(F.lit(1)).alias("count")
        )
    )
    sinks.write_report(
        flow.drop("count"), f"{args.out}/hour_day_zone_avgspeed", single_file=False
    )
    sinks.write_report(
        flow.drop("average_speed"), f"{args.out}/hour_day_zone_freq", single_file=False
    )
    for name, keys in (
        ("hour_day_commute_freq", ("hour", "weekday")),
        ("zone_commute_freq", ("PULocationID", "DOLocationID")),
    ):
        summed = flow.groupBy(*keys).agg(F.sum("count").alias("count"))
        sinks.write_report(summed, f"{args.out}/{name}", keys)
    pairs = flow.withColumn("count", F.col("count").cast("double"))
    matrix = speed.dist.correlation_matrix(pairs, "average_speed", "count")
    sinks.write_report(matrix, f"{args.out}/speed_flow_correlation")
    features = ("hour", "weekday", "tip_percentage")
    every = cut_lineage(speed.speed_correlations(rides, features, args.fraction))
    for feature in features:
        matrix = every.where(F.col("feature").isin("speed", feature)).select("feature", "speed", feature)
        sinks.write_report(matrix, f"{args.out}/speed_{feature}_correlation")


def borough_report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Speed and trip count per borough pair, ranked and as chord links."""
    rides = _speed_rides(spark, args)
    dim = zones.zone_dimension(_zone_shapes(spark, args.zones))
    figures = cut_lineage(speed.borough_pair_figures(rides, dim))
    pairs, keys = figures.drop("count"), ["PUborough", "DOborough"]
    sinks.write_report(pairs, f"{args.out}/borough_speed", keys)
    sinks.write_report(figures.drop("avg_speed"), f"{args.out}/borough_count", keys)
    sinks.write_report(
        speed.borough_pair_ranked(pairs, BOROUGH_ORDER), f"{args.out}/borough_rank", ["avg_speed"]
    )
    sinks.write_report(
        speed.borough_chord_links(pairs, BOROUGH_ORDER), f"{args.out}/borough_links"
    )


def tips_general(spark: SparkSession, args: argparse.Namespace) -> None:
    """First look at tips: by vendor, by day and hour, and the chart points."""
    features = cut_lineage(tips.tip_features(tripdata.read_trips(spark, args.trips)))
    points = tips.tip_feature_points(features)
    sinks.write_report(tips.tip_by_vendor(features), f"{args.out}/vendor", ["VendorID"])
    sinks.write_report(tips.tip_day_hour(features), f"{args.out}/day_hour", ["day"])
    sinks.write_report(tips.tip_histograms(points), f"{args.out}/histograms", ["feature", "bin"])
    sinks.write_report(points, f"{args.out}/points", single_file=False)


def tips_overview(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tips by year, their distribution, and the daily figures."""
    overview = cut_lineage(tips.tip_overview(tripdata.read_trips(spark, args.trips)))
    distribution = cut_lineage(tips.tip_distribution(overview))
    sinks.write_report(tips.tip_by_year(overview), f"{args.out}/yearly", ["year"])
    sinks.write_report(distribution, f"{args.out}/distribution", ["year", "tip_range_index"])
    labeled = tips.tip_distribution_labeled(distribution, lookups.tip_ranges(spark))
    sinks.write_report(labeled, f"{args.out}/distribution-rangemapped", ["year"], single_file=False)
    sinks.write_report_by(tips.tip_daily(overview), f"{args.out}/daily", "year", order=["date"])


def tips_location(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tips per pickup zone, dropoff zone and zone; with --lookup also the named reports."""
    located = cut_lineage(tips.tip_locations(tripdata.read_trips(spark, args.trips)))
    results = {
        "pickup": (tips.tip_by_pickup(located), "PULocationID", "avg"),
        "dropoff": (tips.tip_by_dropoff(located), "DOLocationID", "avg"),
        "total": (tips.tip_by_location(located, args.as_reference), "locationID", "avg"),
        "petty": (
            tips.petty_by_location(located, args.as_reference),
            "locationID",
            "petty_ratio",
        ),
        "generous": (
            tips.generous_by_location(located, as_reference=args.as_reference),
            "locationID",
            "count",
        ),
    }
    for name, (result, index, order) in results.items():
        result = cut_lineage(result)
        sinks.write_report(result, f"{args.out}/{name}", [F.desc(order), index])
        if args.lookup:
            lookup = lookups.read_zone_lookup(spark, args.lookup)
            for part, options in (
                ("full", {}),
                (f"above_{args.above}", {"above": args.above}),
                ("top20", {"above": args.above, "top": 20}),
            ):
                report = tips.location_report(lookup, result, order, index, **options)
                sinks.write_report(
                    report, f"{args.out}/{name}_{part}", [F.col(order).desc_nulls_last(), index]
                )


def count_zones(spark: SparkSession, args: argparse.Namespace) -> None:
    """Monthly pickups and dropoffs per zone from the trip files under --raw, and their sums."""
    raw = tripdata.read_trip_files(spark, args.raw, **_wanted(args, study_years=True))
    monthly = zone_counts.monthly_zone_counts(zone_counts.counted_rides(raw))
    table = f"{args.out}/monthly"
    sinks.write_table(monthly, table, "direction", "color", "year", "month")
    monthly = tripdata.read_zone_counts(spark, table)
    for name, report in (
        ("color", zone_counts.zone_counts_by_color(monthly)),
        ("season", zone_counts.zone_counts_by_season(monthly)),
        ("year", zone_counts.zone_counts_by_year(monthly)),
        ("total", zone_counts.zone_counts_total(monthly)),
    ):
        sinks.write_table(report.repartition(1), f"{args.out}/{name}", "direction")


def convert_shapes(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parse a CSV with WKT once: shapes as Parquet, and how many rows have none and why.

    A CSV whose quoted text holds line breaks is read by one task; what is made of it by many.
    """
    parsed = lookups.parse_shapes(lookups.read_geometry_csv(spark, args.csv))
    sinks.write_table(parsed.hint("rebalance"), f"{args.out}/shapes")
    shapes = spark.read.parquet(f"{args.out}/shapes")
    counted = shapes.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    sinks.write_report(counted, f"{args.out}/problems", ["problem"])


def match_facilities(spark: SparkSession, args: argparse.Namespace) -> None:
    """Give bus stops, subway stations or parking lots their zone, and count them per zone."""
    index = ZoneIndex(_zone_shapes(spark, args.zones), cell=args.cell)
    if args.converted:
        form = "shape" if args.kind == "lots" else "point"
        table = spark.read.parquet(f"{args.facilities}/shapes")
        # Rows without a shape lie outside all zones; the conversion has reported them.
        table = table.withColumn("the_geom", F.col(form)).drop("shape", "point", "problem")
    else:
        table = lookups.read_geometry_csv(spark, args.facilities)
    if args.kind == "lots":
        area = F.col("SHAPE_Area").cast("double")
        placed = facilities.lot_zones(table.withColumn("SHAPE_Area", area), index)
    else:
        placed = facilities.point_zones(table, index)
    sinks.write_table(placed, f"{args.out}/with_location")
    placed = spark.read.parquet(f"{args.out}/with_location")
    name = {"bus": "bus_stop_nums", "subway": "sub_stn_nums", "lots": "lot_nums"}[args.kind]
    sinks.write_table(facilities.count_per_zone(placed, name).repartition(1), f"{args.out}/{name}")
    if args.kind == "lots":
        sizes = facilities.area_per_zone(placed).repartition(1)
        sinks.write_table(sizes, f"{args.out}/lot_area")
        sinks.write_table(facilities.lot_figures(placed).repartition(1), f"{args.out}/figures")


def parking_counterexamples(spark: SparkSession, args: argparse.Namespace) -> None:
    """Zones where traffic and parking rank alike, from the outputs of the two jobs above."""
    chosen = facilities.parking_counterexamples(
        spark.read.parquet(f"{args.counts}/total"),
        spark.read.parquet(f"{args.lots}/figures"),
        _zone_shapes(spark, args.zones),
    )
    sinks.write_report(chosen, args.out, ["LocationID"])


def clean_weather(spark: SparkSession, args: argparse.Namespace) -> None:
    """Daily weather from the raw readings."""
    daily = weather.daily_weather(lookups.read_weather(spark, args.weather))
    sinks.write_report(daily, args.out, ["date"])


def train_speed(spark: SparkSession, args: argparse.Namespace) -> None:
    """Search the speed model grid; --flow or --weather add their features."""
    rides = _speed_rides(spark, args)
    dim = zones.zone_dimension(_zone_shapes(spark, args.zones))
    rides_in = models.place_features(rides, dim, args.fraction)
    features = models.PLACE_FEATURES
    if args.flow:
        rides_in = models.add_flow(rides_in, lookups.read_flow(spark, args.flow))
        features = models.FLOW_FEATURES
    elif args.weather:
        daily = weather.daily_weather(lookups.read_weather(spark, args.weather))
        rides_in = models.add_weather(rides_in, daily)
        features = models.WEATHER_FEATURES
    searched = models.search_speed_model(rides_in, features, args.step_sizes, args.depths)
    for point in searched.points:
        sinks.save_model(point.model, f"{args.out}/models/{point.step_size}-{point.depth}")
    best = searched.best()
    sinks.save_model(best.model, f"{args.out}/model")
    sinks.save_sql(spark, models.model_sql(best.model, features), f"{args.out}/model_sql")
    sinks.write_report(searched.table(), f"{args.out}/grid", ["rmse"])
    weights = models.feature_importances(best.model, features, rides_in)
    sinks.write_report(weights, f"{args.out}/importances", [F.desc("value")])


def train_tip(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fit the tip regressor or classifier."""
    trips = tripdata.read_trips(spark, args.trips)
    fit = {"regressor": models.fit_tip_regressor, "classifier": models.fit_tip_classifier}
    fitted = fit[args.kind](trips)
    sinks.save_model(fitted.model, f"{args.out}/model")
    features = {"regressor": models.TIP_REGRESSION_FEATURES, "classifier": models.TIP_CLASS_FEATURES}
    sinks.save_sql(spark, models.model_sql(fitted.model, features[args.kind]), f"{args.out}/model_sql")
    sinks.write_report(fitted.report(), f"{args.out}/report", ["kind", "name"])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tripweave.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(run: Callable, *paths: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for path in (*paths, "out"):
            sub.add_argument(f"--{path}", required=True)
        sub.set_defaults(run=run)
        return sub

    kinds = ["general", "payment", "time", "speed", "union"]
    def raw_job(run: Callable) -> argparse.ArgumentParser:
        sub = job(run, "raw")
        sub.add_argument("--years", type=int, nargs="+", help="years of files to read")
        sub.add_argument("--colors", nargs="+", choices=["yellow", "green"])
        return sub

    raw_job(clean).add_argument("--kind", choices=kinds, required=True)
    job(time_report, "trips")
    job(speed_report, "trips")
    job(flow_report, "trips").add_argument("--fraction", type=float)
    job(borough_report, "trips", "zones")
    job(tips_general, "trips")
    job(tips_overview, "trips")
    location = job(tips_location, "trips")
    location.add_argument("--lookup")
    location.add_argument("--above", type=int, default=1000)
    location.add_argument("--as-reference", action="store_true")
    raw_job(count_zones)
    job(convert_shapes, "csv")
    match = job(match_facilities, "facilities", "zones")
    match.add_argument("--kind", choices=["bus", "subway", "lots"], required=True)
    match.add_argument(
        "--converted", action="store_true", help="--facilities is the output of convert-shapes"
    )
    match.add_argument("--cell", type=float, help="grid width, in map units (default: measured)")
    job(parking_counterexamples, "counts", "lots", "zones")
    job(clean_weather, "weather")
    train = job(train_speed, "trips", "zones")
    extra = train.add_mutually_exclusive_group()
    extra.add_argument("--flow")
    extra.add_argument("--weather")
    train.add_argument(
        "--fraction", type=float, help="train on a with-replacement sample of this share (default: all rows)"
    )
    train.add_argument("--step-sizes", type=float, nargs="+", help="default: those of the features' grid")
    train.add_argument("--depths", type=int, nargs="+", help="default: those of the features' grid")
    tip = job(train_tip, "trips")
    tip.add_argument("--kind", choices=["regressor", "classifier"], required=True)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tripweave {args.job}").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
