"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as registered
from tripweave.plans import cleaning, speed, tips
from tripweave.sources import sample_tables

FITTED = {"speed_gbt", "speed_gbt_flow", "speed_gbt_weather", "tip_gbt_regressor", "tip_rf_classifier"}
FITTED |= {"speed_gbt_sql", "tip_gbt_sql", "tip_rf_sql"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def trips(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "trips")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    sample_tables.trips(spark, small).write.partitionBy("color").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(registered.trip_queries()) - FITTED))
def test_no_cross_join_and_no_python(spark, small, name):
    plan = plan_of(registered.trip_queries()[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan, bad


def scan(plan):
    return "\n".join(line for line in plan.splitlines() if "FileScan" in line)


def test_speed_filters_reach_the_scan(trips):
    plan = scan(plan_of(speed.speed_by_hour_weekday(cleaning.clean_speed(trips))))
    for pushed in ("GreaterThan(total_amount,2.5)", "GreaterThan(trip_distance,0.0)",
                   "GreaterThanOrEqual(pickup_datetime,2017-01-01T00:00)",
                   "LessThan(dropoff_datetime,2022-01-01T00:00)"):
        assert pushed in plan, pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "fare_amount" not in read and "tip_amount" not in read and "VendorID" not in read


def test_tip_filters_reach_the_scan(trips):
    plan = scan(plan_of(tips.tip_distribution(tips.tip_overview(trips))))
    for pushed in ("EqualTo(payment_type,1)", "LessThan(VendorID,3)"):
        assert pushed in plan, pushed
    assert "passenger_count" not in re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)


def test_one_color_prunes_partitions(trips):
    plan = scan(plan_of(cleaning.clean_speed(trips.filter("color = 'green'"))))
    assert re.search(r"PartitionFilters: \[[^\]]*color", plan)


def test_cleaning_does_not_shuffle(trips):
    for job in (cleaning.clean_speed(trips), cleaning.clean_time([trips]),
                cleaning.clean_general([trips]), cleaning.clean_by_payment([trips])):
        assert "Exchange" not in plan_of(job)


def test_both_ends_are_counted_in_one_scan(trips):
    located = tips.tip_locations(trips)
    for plan in (tips.tip_by_location(located), tips.tip_by_location(located, as_reference=True),
                 tips.petty_by_location(located), tips.petty_by_location(located, as_reference=True)):
        assert plan_of(plan).count("FileScan") == 1
