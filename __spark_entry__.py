"""Registered queries over the sample tables and the SQL that checks them."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import file_queries  # noqa: E402
import oracle_queries  # noqa: E402
from tripweave.operators.zone_match import ZoneIndex  # noqa: E402
from tripweave.plans import (  # noqa: E402
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
from tripweave.sources import lookups, sample_tables  # noqa: E402
from tripweave.sources.tripdata import trips_union  # noqa: E402

try:  # the training-text operators are optional: the library works without them
    import corpus_pipeline
    from tripweave.llm import queries as text_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tripweave.llm"):
        raise
    text_queries = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

# Location reports keep zones with more trips than this, as in the published ">100" reports.
REPORT_THRESHOLD = 100

# Sample areas are multiples of 0.00000025, so six digits would round at exact halves.
AREA_DIGITS = 9


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floating numbers depend on their order, so averages are compared after rounding."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def _speed_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_speed(sample_tables.trips(spark, sf_dir))


def _time_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_time(sample_tables.raw_colors(spark, sf_dir))


def _zone_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_dimension(sample_tables.zones(spark, sf_dir))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.tip_overview(sample_tables.trips(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.tip_features(sample_tables.trips(spark, sf_dir))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.tip_locations(sample_tables.trips(spark, sf_dir))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_counts.counted_rides(sample_tables.trips(spark, sf_dir))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_counts.monthly_zone_counts(_counted(spark, sf_dir))


def _on_speed(plan: Callable[..., DataFrame], *round_columns: str, **options) -> Query:
    return lambda spark, sf_dir: rounded(
        plan(_speed_rides(spark, sf_dir), **options), *round_columns
    )


def _trips_per(part: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = demand.trips_per(_time_rides(spark, sf_dir), part)
        return dates_as_text(counted) if part == "date" else counted

    return query


def _trips_per_year_and(part: str) -> Query:
    return lambda spark, sf_dir: demand.yearly_series(_time_rides(spark, sf_dir), part)


def _etl_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_general(sample_tables.raw_colors(spark, sf_dir))


def _etl_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_by_payment(sample_tables.raw_colors(spark, sf_dir))


def _etl_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates_as_text(_time_rides(spark, sf_dir))


def _etl_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_speed_rides(spark, sf_dir), "speed", "tip_percentage")


def _etl_speed_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = cleaning.clean_speed(sample_tables.trips(spark, sf_dir), as_reference=True)
    return rounded(rides, "speed", "tip_percentage")


def _trips_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_union(sample_tables.raw_colors(spark, sf_dir))


def _passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.passengers_by_weekday(_time_rides(spark, sf_dir)), "passenger_avg")


def _passengers_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.yearly_passengers_by_weekday(_time_rides(spark, sf_dir)), "passenger_avg")


def _pair_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speed.borough_pair_speed(_speed_rides(spark, sf_dir), _zone_dim(spark, sf_dir))


def _pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speed.borough_pair_count(_speed_rides(spark, sf_dir), _zone_dim(spark, sf_dir))


def _pair_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = speed.borough_pair_ranked(_pair_speed(spark, sf_dir), sample_tables.REGION_ORDER)
    return rounded(ranked, "avg_speed")


def _chord_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = speed.borough_chord_links(_pair_speed(spark, sf_dir), sample_tables.REGION_ORDER)
    return rounded(links, "value")


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speed.speed_weekday_hour_pivot(speed.speed_by_hour_weekday(_speed_rides(spark, sf_dir)))


def _zone_speed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = speed.zone_speed_box(_speed_rides(spark, sf_dir))
    return speed.zone_speed_map(sample_tables.zones(spark, sf_dir), box)


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = weather.daily_weather(sample_tables.weather(spark, sf_dir))
    return rounded(dates_as_text(daily), "tavg")


def _place_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.place_features(_speed_rides(spark, sf_dir), _zone_dim(spark, sf_dir))


def _speed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = _place_rides(spark, sf_dir).select(*models.PLACE_FEATURES, "speed")
    return rounded(rides, "speed")


def _flow_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _speed_rides(spark, sf_dir)
    rides = models.place_features(trips, _zone_dim(spark, sf_dir))
    return models.add_flow(rides, speed.zone_pair_hour_count(trips))


def _speed_features_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = _flow_rides(spark, sf_dir).select(*models.FLOW_FEATURES, "speed")
    return rounded(rides, "speed")


def _weather_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = weather.daily_weather(sample_tables.weather(spark, sf_dir))
    return models.add_weather(_place_rides(spark, sf_dir), daily)


def _speed_features_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = _weather_rides(spark, sf_dir).select(*models.WEATHER_FEATURES, "speed")
    return rounded(rides, "speed", "tavg")


def _tip_regression_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = models.tip_regression_rides(sample_tables.trips(spark, sf_dir))
    table = models.tip_features(rides, models.RATIO_LABEL, models.TIP_REGRESSION_FEATURES)
    return rounded(table, "tip_ratio", "duration", "other_amount")


def _tip_class_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = models.tip_class_rides(sample_tables.trips(spark, sf_dir))
    table = models.tip_features(rides, models.BUCKET_LABEL, models.TIP_CLASS_FEATURES, True)
    return rounded(table, "duration", "other_amount")


def _speed_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.search_speed_model(_place_rides(spark, sf_dir)).table()


def _speed_gbt_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.search_speed_model(_flow_rides(spark, sf_dir), models.FLOW_FEATURES).table()


def _speed_gbt_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.search_speed_model(_weather_rides(spark, sf_dir), models.WEATHER_FEATURES).table()


def _speed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.split_figures(_speed_rides(spark, sf_dir), "speed"), "mean")


def _tip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = models.tip_regression_rides(sample_tables.trips(spark, sf_dir))
    return rounded(models.split_figures(rides, "tip_amount"), "mean")


def _tip_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_tip_regressor(sample_tables.trips(spark, sf_dir)).report()


def _tip_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_tip_classifier(sample_tables.trips(spark, sf_dir)).report()


def _speed_gbt_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = _place_rides(spark, sf_dir)
    best = models.search_speed_model(rides, step_sizes=[0.3], depths=[5]).best()
    return models.sql_agreement(rides, best.model, models.PLACE_FEATURES, "speed")


def _prepared_tips(rides: DataFrame, label: str, features: tuple, other_of_total: bool = False) -> DataFrame:
    """Labels and features as plain columns, with the trip's key for the split."""
    stage = models.tip_feature_stage(label, other_of_total).transform(rides)
    return stage.select(*dict.fromkeys((label.rsplit(" ", 1)[-1], *features, *models.SPLIT_KEY)))


def _tip_gbt_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = sample_tables.trips(spark, sf_dir)
    features = models.TIP_REGRESSION_FEATURES
    rides = _prepared_tips(models.tip_regression_rides(trips), models.RATIO_LABEL, features)
    return models.sql_agreement(rides, models.fit_tip_regressor(trips).model, features, "tip_ratio")


def _tip_forest_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = sample_tables.trips(spark, sf_dir)
    features = models.TIP_CLASS_FEATURES
    rides = _prepared_tips(models.tip_class_rides(trips), models.BUCKET_LABEL, features)
    return models.sql_agreement(rides, models.fit_tip_classifier(trips).model, features, "tip_range_index")


def _tip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tips.tip_feature_points(_features(spark, sf_dir))
    return rounded(points, "tip_ratio", "total_fare", "other_amount")


def _tip_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tips.tip_feature_points(_features(spark, sf_dir))
    return rounded(tips.tip_histograms(points), "bin_start", "bin_end")


def _tip_day_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tips.tip_day_hour(_features(spark, sf_dir)), *[f"hour_{h}" for h in range(24)])


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.tip_distribution(_overview(spark, sf_dir))


def _distribution_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = tips.tip_distribution_labeled(_distribution(spark, sf_dir), lookups.tip_ranges(spark))
    return rounded(labeled, "ratio_of_year")


def _tip_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tips.tip_daily(_overview(spark, sf_dir))
    return rounded(dates_as_text(daily), "mean_percent", "median_percent")


def _on_located(plan: Callable[..., DataFrame], *round_columns: str, **options) -> Query:
    return lambda spark, sf_dir: rounded(plan(_located(spark, sf_dir), **options), *round_columns)


def _report(
    plan: Callable[..., DataFrame] = tips.tip_by_location,
    order: str = "avg",
    index: str = "locationID",
    ratio: str = "avg",
    **options,
) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = plan(_located(spark, sf_dir))
        lookup = sample_tables.zone_lookup(spark, sf_dir)
        return rounded(tips.location_report(lookup, result, order, index, **options), ratio)

    return query


def _location_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = tips.tip_by_location(_located(spark, sf_dir))
    return rounded(tips.location_map(sample_tables.zones(spark, sf_dir), result), "avg")


def _zone_count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = zone_counts.zone_counts_total(_monthly(spark, sf_dir))
    shown = zone_counts.zone_count_map(totals, sample_tables.zones(spark, sf_dir))
    return rounded(shown, "log_amount")


def _on_monthly(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(_monthly(spark, sf_dir))


def _bus_stops(spark: SparkSession, sf_dir: str, index: ZoneIndex | None = None) -> DataFrame:
    return facilities.point_zones(
        sample_tables.bus_stops(spark, sf_dir), index or sample_tables.zones(spark, sf_dir)
    )


def _subway(spark: SparkSession, sf_dir: str, index: ZoneIndex | None = None) -> DataFrame:
    return facilities.point_zones(
        sample_tables.subway_stations(spark, sf_dir), index or sample_tables.zones(spark, sf_dir)
    )


def _lots(spark: SparkSession, sf_dir: str, index: ZoneIndex | None = None) -> DataFrame:
    return facilities.lot_zones(
        sample_tables.parking_lots(spark, sf_dir), index or sample_tables.zones(spark, sf_dir)
    )


def _lot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.count_per_zone(_lots(spark, sf_dir), "lot_nums")


def _lot_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.area_per_zone(_lots(spark, sf_dir))


def _bus_stop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.count_per_zone(_bus_stops(spark, sf_dir), "bus_stop_nums")


def _subway_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.count_per_zone(_subway(spark, sf_dir), "sub_stn_nums")


def _lot_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.lot_figures(_lots(spark, sf_dir))


def _facility_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = sample_tables.zones(spark, sf_dir)
    index = ZoneIndex(shapes)
    measured = facilities.facility_figures(
        bus_stop_nums=_bus_stops(spark, sf_dir, index),
        sub_stn_nums=_subway(spark, sf_dir, index),
        lot_nums=_lots(spark, sf_dir, index),
    )
    return rounded(facilities.facility_map(shapes, measured), "value", digits=AREA_DIGITS)


def _parking_counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.parking_counterexamples(
        zone_counts.zone_counts_total(_monthly(spark, sf_dir)),
        _lot_figures(spark, sf_dir),
        sample_tables.zones(spark, sf_dir),
    )


def entry(spark: SparkSession) -> DataFrame:
    """Speed quartiles per zone on the smallest sample."""
    return queries()["zone_speed_box"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """One entry per named analysis; each takes (spark, sf_dir)."""
    found = trip_queries()
    if text_queries:
        found |= text_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def trip_queries() -> dict[str, Query]:
    return {
        # cleaning
        "etl_general": _etl_general,
        "etl_payment_clean": _etl_payment,
        "etl_time": _etl_time,
        "etl_speed": _etl_speed,
        "etl_speed_ref": _etl_speed_ref,
        "trips_union": _trips_union,
        "zone_dim": _zone_dim,
        "weather_daily": _weather,
        # demand over time
        "trips_per_year": _trips_per("year"),
        "trips_per_month": _trips_per("month"),
        "trips_per_weekday": _trips_per("weekday"),
        "trips_per_day": _trips_per("date"),
        "trips_per_hour": _trips_per("hour"),
        "trips_per_year_month": _trips_per_year_and("month"),
        "trips_per_year_weekday": _trips_per_year_and("weekday"),
        "trips_per_year_hour": _trips_per_year_and("hour"),
        "passenger_avg_by_weekday": _passengers,
        "passenger_avg_by_year_weekday": _passengers_yearly,
        # speed
        "zone_speed_box": _on_speed(speed.zone_speed_box),
        "zone_speed_box_ref": _on_speed(speed.zone_speed_box, as_reference=True),
        "zone_speed_median": _on_speed(speed.zone_speed_median),
        "speed_by_hour_weekday": _on_speed(speed.speed_by_hour_weekday, "average"),
        "slowest_destinations": _on_speed(speed.slowest_destinations),
        "fastest_destinations": _on_speed(speed.fastest_destinations),
        "borough_pair_speed": lambda s, d: rounded(_pair_speed(s, d), "avg_speed"),
        "borough_pair_count": _pair_count,
        "borough_pair_ranked": _pair_ranked,
        "borough_chord_links": _chord_links,
        "zone_pair_hour_speed": _on_speed(speed.zone_pair_hour_speed, "average_speed"),
        "zone_pair_hour_count": _on_speed(speed.zone_pair_hour_count),
        "hour_weekday_count": _on_speed(speed.hour_weekday_count),
        "zone_pair_count": _on_speed(speed.zone_pair_count),
        "speed_flow_corr": _on_speed(speed.speed_flow_correlation, "average_speed", "count"),
        "corr_speed_hour": _on_speed(speed.speed_correlation, "speed", "hour", feature="hour"),
        "corr_speed_weekday": _on_speed(
            speed.speed_correlation, "speed", "weekday", feature="weekday"
        ),
        "corr_speed_tip": _on_speed(
            speed.speed_correlation, "speed", "tip_percentage", feature="tip_percentage"
        ),
        "speed_histogram": _on_speed(speed.speed_histogram, "bin_start", "bin_end"),
        "duration_histogram": _on_speed(speed.duration_histogram, "bin_start", "bin_end"),
        "speed_weekday_hour_pivot": _pivot,
        "tip_speed_points": _on_speed(speed.tip_speed_points, "speed", "tip_percentage"),
        "zone_speed_map": _zone_speed_map,
        # tips
        "tip_by_vendor": lambda s, d: rounded(tips.tip_by_vendor(_features(s, d)), "mean"),
        "tip_day_hour": _tip_day_hour,
        "tip_feature_points": _tip_points,
        "tip_histograms": _tip_histograms,
        "tip_by_year": lambda s, d: rounded(
            tips.tip_by_year(_overview(s, d)), "mean_percent", "median_percent"
        ),
        "tip_distribution": lambda s, d: rounded(_distribution(s, d), "ratio_of_year"),
        "tip_distribution_labeled": _distribution_labeled,
        "tip_daily": _tip_daily,
        "tip_by_pickup": _on_located(tips.tip_by_pickup, "avg"),
        "tip_by_dropoff": _on_located(tips.tip_by_dropoff, "avg"),
        "tip_by_location": _on_located(tips.tip_by_location, "avg"),
        "tip_by_location_ref": _on_located(tips.tip_by_location, "avg", as_reference=True),
        "petty_by_location": _on_located(tips.petty_by_location, "petty_ratio"),
        "petty_by_location_ref": _on_located(
            tips.petty_by_location, "petty_ratio", as_reference=True
        ),
        "generous_by_location": _on_located(tips.generous_by_location, "generous_ratio"),
        "generous_by_location_ref": _on_located(
            tips.generous_by_location, "generous_ratio", as_reference=True
        ),
        "location_report_full": _report(),
        "location_report_min_count": _report(above=REPORT_THRESHOLD),
        "location_report_top20": _report(above=REPORT_THRESHOLD, top=20),
        "location_report_pickup": _report(tips.tip_by_pickup, index="PULocationID"),
        "location_report_dropoff": _report(tips.tip_by_dropoff, index="DOLocationID"),
        "location_report_petty": _report(
            tips.petty_by_location, order="petty_ratio", ratio="petty_ratio"
        ),
        "location_report_generous": _report(
            tips.generous_by_location, order="count", ratio="generous_ratio"
        ),
        "tip_location_map": _location_map,
        # pickups and dropoffs
        "pickup_counts": lambda s, d: zone_counts.pickup_counts(_counted(s, d)),
        "dropoff_counts": lambda s, d: zone_counts.dropoff_counts(_counted(s, d)),
        "zone_counts_by_color": _on_monthly(zone_counts.zone_counts_by_color),
        "zone_counts_by_season": _on_monthly(zone_counts.zone_counts_by_season),
        "zone_counts_by_year": _on_monthly(zone_counts.zone_counts_by_year),
        "zone_counts_total": _on_monthly(zone_counts.zone_counts_total),
        "zone_count_map": _zone_count_map,
        # facilities
        "bus_stop_zone": _bus_stops,
        "subway_zone": _subway,
        "parking_lot_zone": _lots,
        "bus_stops_per_zone": _bus_stop_counts,
        "subway_per_zone": _subway_counts,
        "lots_per_zone": _lot_counts,
        "lot_area_per_zone": lambda s, d: rounded(_lot_areas(s, d), "lot_area", digits=AREA_DIGITS),
        "facility_map": _facility_map,
        "parking_counterexamples": _parking_counterexamples,
        # models
        "speed_features": _speed_features,
        "speed_features_flow": _speed_features_flow,
        "speed_features_weather": _speed_features_weather,
        "tip_regression_features": _tip_regression_features,
        "tip_class_features": _tip_class_features,
        "speed_split": _speed_split,
        "tip_split": _tip_split,
        "speed_gbt": _speed_gbt,
        "speed_gbt_flow": _speed_gbt_flow,
        "speed_gbt_weather": _speed_gbt_weather,
        "tip_gbt_regressor": _tip_gbt,
        "tip_rf_classifier": _tip_forest,
        "speed_gbt_sql": _speed_gbt_sql,
        "tip_gbt_sql": _tip_gbt_sql,
        "tip_rf_sql": _tip_forest_sql,
        # files and the order of reports
        **file_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL; sampled and fitted results have none."""
    found = oracle_queries.all_queries()
    if text_queries:
        found |= text_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
