"""Each filter exactly at its bounds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripweave.functions import trip_columns as tc
from tripweave.operators import quality

DAY = datetime(2019, 5, 1, 12)


def kept(df, column):
    return sorted(row[0] for row in df.select(column).collect())


def frame(spark, schema, *values):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


@pytest.mark.parametrize(
    ("rule", "schema", "values", "expected"),
    [
        (quality.total_above, "total_amount double", (2.49, 2.5, 2.51), [2.51]),
        (quality.total_positive, "total_amount double", (-1.0, 0.0, 0.01), [0.01]),
        (quality.distance_within, "trip_distance double", (-1.0, 0.0, 0.1), [0.1]),
        (lambda d: quality.distance_within(d, 0, 180), "trip_distance double",
         (179.9, 180.0, 0.0), [179.9]),
        (quality.duration_between, "duration long", (0, 1, 10799, 10800), [1, 10799]),
        (lambda d: quality.duration_between(d, 0, 6000), "duration long", (0, 5999, 6000), [5999]),
        (quality.speed_between, "speed double", (0.0, 0.1, 99.9, 100.0), [0.1, 99.9]),
        (lambda d: quality.paid_by(d, 1, 2), "payment_type long", (0, 1, 2, 3), [1, 2]),
        (quality.fare_at_least, "fare_amount double", (2.49, 2.5), [2.5]),
        (quality.main_vendors, "VendorID long", (1, 2, 3, None), [1, 2]),
        (lambda d: quality.count_above(d, 10), "count long", (9, 10, 11), [11]),
    ],
)
def test_one_column_bounds(spark, rule, schema, values, expected):
    df = frame(spark, schema, *values)
    assert kept(rule(df), df.columns[0]) == expected


def test_fare_band_includes_its_edges(spark):
    df = frame(spark, "trip_distance double, fare_amount double",
               (2.0, 6.49), (2.0, 6.5), (2.0, 9.5), (2.0, 9.51))
    assert kept(quality.fare_in_band(df), "fare_amount") == [6.5, 9.5]


def test_unknown_zones_at_both_ends(spark):
    pairs = [(1, 2), (264, 2), (265, 2), (1, 264), (1, 265)]
    df = frame(spark, "PULocationID long, DOLocationID long", *pairs)
    assert [tuple(r) for r in quality.known_zones(df).collect()] == [(1, 2)]
    as_reference = {tuple(r) for r in quality.known_zones(df, as_reference=True).collect()}
    assert as_reference == {(1, 2), (265, 2), (1, 264)}
    assert [tuple(r) for r in quality.zones_below(df).collect()] == [(1, 2)]
    same = frame(spark, "PULocationID long, DOLocationID long", (1, 1), (1, 2))
    assert quality.same_zone(same).count() == 1


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_years_are_whole_for_both_timestamp_kinds(spark, kind):
    texts = ["2016-12-31 23:59:59", "2017-01-01 00:00:00", "2021-12-31 23:59:59", "2022-01-01 00:00:00"]
    df = frame(spark, "t string", *texts).select(F.col("t").cast(kind).alias("pickup_datetime"))
    rows = quality.years_within(df, columns=("pickup_datetime",))
    assert [str(t) for t in kept(rows, "pickup_datetime")] == texts[1:3]


def test_ride_minutes(spark):
    df = frame(spark, "p string, d string",
               ("2019-01-01 10:00:00", "2019-01-01 13:00:00"),
               ("2019-01-01 10:00:00", "2019-01-01 13:00:01"),
               ("2019-01-01 10:00:00", "2019-01-01 09:59:00"))
    df = df.select(F.col("p").cast("timestamp_ntz").alias("pickup_datetime"),
                   F.col("d").cast("timestamp_ntz").alias("dropoff_datetime"))
    assert quality.at_most_minutes(df).count() == 2
    assert quality.at_most_minutes(df, 180, at_least=0).count() == 1


def test_bill_caps(spark):
    schema = "total_amount double, trip_distance double, tip_amount double, fare_amount double"
    df = frame(spark, schema, (120.0, 20.0, 10.0, 90.0), (120.5, 20.0, 10.0, 90.5),
               (120.0, 20.1, 10.0, 90.0), (120.0, 20.0, 10.0, 89.5))
    assert quality.bill_caps(df).count() == 1


def test_tip_buckets(spark):
    rows = [(0.0, 10.0), (0.5, 10.5), (1.0, 11.0), (1.01, 11.01), (2.0, 12.0), (2.01, 12.01),
            (9.0, 19.0), (1.0, 1.0)]
    df = frame(spark, "tip_amount double, total_amount double", *rows)
    found = [r[0] for r in df.select(tc.tip_bucket(10, 2)).collect()]
    assert found == [0, 1, 1, 2, 2, 3, 3, None]


def test_expressions(spark):
    one = spark.range(1).select(
        F.lit(DAY).cast("timestamp_ntz").alias("pickup_datetime"),
        F.lit(datetime(2019, 5, 1, 13, 30)).cast("timestamp_ntz").alias("dropoff_datetime"),
        F.lit(30.0).alias("trip_distance"),
        F.lit(5400).alias("duration"),
    )
    row = one.select(
        tc.duration_seconds().alias("s"), tc.duration_minutes().alias("m"), tc.speed().alias("v"),
        *[c.alias(n) for n, c in tc.calendar_columns().items()],
    ).first()
    assert (row.s, row.m, row.v) == (5400, 90.0, 20.0)
    assert (row.year, row.month, row.monthday, row.weekday, row.hour) == (2019, 5, 1, 4, 12)
    months = spark.range(1, 13).withColumnRenamed("id", "month")
    assert [r[0] for r in months.select(tc.season()).collect()] == [4, 4, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    names = frame(spark, "b string", "Brooklyn", "EWR", "Staten Island", None)
    assert [r[0] for r in names.select(tc.borough_index("b")).collect()] == [0, 4, 5, 5]
