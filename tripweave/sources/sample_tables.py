"""The library's inputs expressed over the TPC-H-like sample tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.schema import UNKNOWN_ZONES

# The sample's regions in place of the borough names.
REGION_ORDER = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(value: Column) -> Column:
    return F.round(value, 2)


def _with_columns_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator instead of a projection.

    Catalyst repeats a projected expression in every filter above it. The sample's date arithmetic
    and rounding are costly, so a generator makes them columns of their own, computed once per row.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def _zone_id(nation: str, unknown: int) -> Column:
    return F.when(F.col(nation) == 24, unknown).otherwise(F.col(nation) * 11 + 1).cast("long")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per line item; the customer's nation is the pickup zone, the supplier's the dropoff."""
    pickup_unknown, dropoff_unknown = UNKNOWN_ZONES
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            F.expr("o_orderdate + INTERVAL '20' YEAR").alias("order_day"),
            _zone_id("c_nationkey", pickup_unknown).alias("PULocationID"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", _zone_id("s_nationkey", dropoff_unknown).alias("DOLocationID")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        ((F.col("l_partkey") * 977 + F.col("l_suppkey") * 7919) % 86400).alias("day_second"),
        (
            (F.col("l_partkey") * 131 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 997) % 12000
            - 300
        ).alias("ride_seconds"),
        (F.col("l_quantity") / 5).alias("trip_distance"),
        "l_discount",
        "l_tax",
        (0.5 + F.col("l_linenumber") % 4).alias("extra"),
        (1 + F.col("l_linenumber") % 3).cast("long").alias("VendorID"),
        F.when(F.col("l_linestatus") == "O", "yellow").otherwise("green").alias("color"),
        (1 + F.col("l_linenumber") % 6).cast("long").alias("passenger_count"),
        F.when(F.col("l_returnflag") == "A", 1)
        .when(F.col("l_returnflag") == "N", 2)
        .otherwise(3)
        .cast("long")
        .alias("payment_type"),
    )
    lines = _with_columns_once(
        lines,
        fare_amount=_cents(2.5 + F.col("trip_distance") * (2 + 20 * F.col("l_discount"))),
    )
    lines = _with_columns_once(
        lines, tip_amount=_cents(F.col("fare_amount") * F.col("l_tax") * 6)
    )
    rides = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    rides = _with_columns_once(
        rides,
        pickup_datetime=F.timestamp_add("SECOND", F.col("day_second"), F.col("order_day")),
        dropoff_datetime=F.timestamp_add(
            "SECOND", F.col("day_second") + F.col("ride_seconds"), F.col("order_day")
        ),
    )
    return rides.select(
        "VendorID",
        "pickup_datetime",
        "dropoff_datetime",
        "passenger_count",
        "trip_distance",
        "PULocationID",
        "DOLocationID",
        "fare_amount",
        "extra",
        "tip_amount",
        (F.col("fare_amount") + F.col("extra") + F.col("tip_amount")).alias("total_amount"),
        "payment_type",
        "color",
    )


def raw_trips(rides: DataFrame, color: str) -> DataFrame:
    """One color's trips in the raw layout of its files, tagged with the file's year and month."""
    prefix = {"green": "lpep", "yellow": "tpep"}[color]
    rides = rides.filter(F.col("color") == color)
    raw = rides.select(
        "VendorID",
        F.col("pickup_datetime").alias(f"{prefix}_pickup_datetime"),
        F.col("dropoff_datetime").alias(f"{prefix}_dropoff_datetime"),
        F.lit("N").alias("store_and_fwd_flag"),
        F.lit(1).cast("long").alias("RatecodeID"),
        "PULocationID",
        "DOLocationID",
        "passenger_count",
        "trip_distance",
        "fare_amount",
        "extra",
        F.lit(0.0).alias("mta_tax"),
        "tip_amount",
        F.lit(0.0).alias("tolls_amount"),
        F.lit(0.0).alias("improvement_surcharge"),
        "total_amount",
        "payment_type",
        F.lit(0.0).alias("congestion_surcharge"),
        "color",
        # One trip in sixty lies in the file of the next year, as misdated trips do.
        (F.year("pickup_datetime") + (F.minute("pickup_datetime") == 7).cast("int")).alias("file_year"),
        F.month("pickup_datetime").alias("file_month"),
    )
    if color == "green":
        return raw.withColumns(
            {"ehail_fee": F.col("VendorID").cast("int"), "trip_type": F.lit(1).cast("long")}
        )
    return raw.withColumn("airport_fee", F.lit(0.0))


def raw_colors(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rides = trips(spark, sf_dir)
    return [raw_trips(rides, color) for color in ("yellow", "green")]


def _square(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    text = F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners])
    return F.concat(F.lit("MULTIPOLYGON ((("), text, F.lit(")))"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-four unit squares of a five by five board, the last cell left empty."""
    x0 = F.col("n_nationkey") % 5
    y0 = F.floor(F.col("n_nationkey") / 5)
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") < 24)
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("n_nationkey") * 11 + 1).cast("long").alias("LocationID"),
            F.col("n_name").alias("zone"),
            F.col("r_name").alias("borough"),
            _square(x0, y0, x0 + 1, y0 + 1).alias("the_geom"),
        )
    )


def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones' names plus the two unknown ids."""
    unknown = F.col("n_nationkey") == 24
    ids = F.when(
        unknown, F.array(*[F.lit(zone).cast("long") for zone in UNKNOWN_ZONES])
    ).otherwise(F.array((F.col("n_nationkey") * 11 + 1).cast("long")))
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.explode(ids).alias("LocationID"),
            F.when(unknown, "Unknown").otherwise(F.col("r_name")).alias("Borough"),
            F.when(unknown, "NV").otherwise(F.col("n_name")).alias("Zone"),
            F.when(unknown, "N/A").otherwise("Boro Zone").alias("service_zone"),
        )
    )


def _stop_points(spark: SparkSession, sf_dir: str, x_step: int, y_step: int) -> DataFrame:
    def coordinate(step: int) -> Column:
        return ((F.col("s_suppkey") * step) % 500 + 0.5) / 100

    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("stop_id"),
        F.concat(
            F.lit("POINT ("),
            F.concat_ws(" ", coordinate(x_step).cast("string"), coordinate(y_step).cast("string")),
            F.lit(")"),
        ).alias("the_geom"),
    )


def bus_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stop_points(spark, sf_dir, 37, 91)


def subway_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stop_points(spark, sf_dir, 53, 29)


def parking_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around points of the board; some straddle several zones."""
    x = ((F.col("p_partkey") * 53) % 490 + 5.5) / 100
    y = ((F.col("p_partkey") * 71) % 490 + 5.5) / 100
    half = (F.col("p_size") + 0.25) / 1000
    side = F.col("p_size") + 0.25
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("SOURCE_ID"),
        (4 * side * side / 1e6).alias("SHAPE_Area"),
        _square(x - half, y - half, x + half, y + half).alias("the_geom"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily readings, one row per calendar day that has an order."""
    days = (
        table(spark, sf_dir, "orders")
        .select(F.expr("cast(o_orderdate + INTERVAL '20' YEAR as date)").alias("day"))
        .distinct()
    )
    n = F.dayofyear("day")
    degrees = (30 + n % 60).cast("double")
    return days.select(
        F.date_format("day", "d/M/yy").alias("date"),
        (degrees + 8).cast("long").alias("tmax"),
        (degrees - 8).cast("long").alias("tmin"),
        degrees.alias("tavg"),
        F.when(n % 7 == 0, "T").when(n % 5 == 0, "0.2").otherwise("0").alias("precipitation"),
        F.when(n % 11 == 0, "1.5").when(n % 13 == 0, "T").otherwise("0").alias("new_snow"),
        F.when(n % 17 == 0, "3").otherwise("0").alias("snow_depth"),
    )
