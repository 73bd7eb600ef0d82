"""Column names, types and fixed values of the trip data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw trip columns after the two timestamp spellings are made one.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField("pickup_datetime", T.TimestampNTZType()),
        T.StructField("dropoff_datetime", T.TimestampNTZType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("RatecodeID", T.LongType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("passenger_count", T.LongType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("ehail_fee", T.IntegerType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("trip_type", T.LongType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
    ]
)

# Green files say lpep_*, yellow files say tpep_*.
TIMESTAMP_NAMES = {
    "lpep_pickup_datetime": "pickup_datetime",
    "lpep_dropoff_datetime": "dropoff_datetime",
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
}

# The columns the tip analyses read.
TIP_INPUT_COLUMNS = [
    "VendorID",
    "pickup_datetime",
    "dropoff_datetime",
    "trip_distance",
    "PULocationID",
    "DOLocationID",
    "fare_amount",
    "tip_amount",
    "total_amount",
    "payment_type",
]

# The columns of the two-color union.
UNION_COLUMNS = [
    "pickup_datetime",
    "dropoff_datetime",
    "payment_type",
    "PULocationID",
    "DOLocationID",
    "trip_distance",
    "total_amount",
    "tip_amount",
]

# Location ids that mean "unknown zone".
UNKNOWN_ZONES = (264, 265)

# Study window, both years included.
FIRST_YEAR, LAST_YEAR = 2017, 2021

# Boroughs in label order; any other name takes the next index.
BOROUGH_ORDER = ("Brooklyn", "Queens", "Manhattan", "Bronx", "EWR")

# Labels of the tip buckets, in steps of five percent of the bill.
TIP_RANGE_LABELS = (
    "=0",
    "0 - 5",
    "5 - 10",
    "10 - 15",
    "15 - 20",
    "20 - 25",
    "25 - 30",
    "30 - 35",
    "35 - 40",
    ">40",
)

ZONE_LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.LongType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("hour", T.IntegerType()),
        T.StructField("weekday", T.IntegerType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("count", T.LongType()),
    ]
)

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("tmax", T.LongType()),
        T.StructField("tmin", T.LongType()),
        T.StructField("tavg", T.DoubleType()),
        T.StructField("departure", T.DoubleType()),
        T.StructField("HDD", T.LongType()),
        T.StructField("CDD", T.LongType()),
        T.StructField("precipitation", T.StringType()),
        T.StructField("new_snow", T.StringType()),
        T.StructField("snow_depth", T.StringType()),
    ]
)
