"""DuckDB SQL for the registered queries, written against the sample tables directly."""

from __future__ import annotations

import math

from tripweave.schema import TIP_RANGE_LABELS

TRIP_KEY = "pickup_datetime::VARCHAR, dropoff_datetime::VARCHAR, PULocationID, DOLocationID"
TIP_REGRESSION = """trip_distance > 0 AND fare_amount >= 2.5
    AND tip_amount / (total_amount - tip_amount) < 0.5::DOUBLE"""
TIP_CLASS = "tip_amount / (total_amount - tip_amount) <= 0.4::DOUBLE"

# One trip in sixty lies in the file of the next year.
FILE_YEAR = "CAST(year(pickup_datetime) + CAST(minute(pickup_datetime) = 7 AS INTEGER) AS INTEGER)"

TRIPS = """
base AS (
  SELECT *,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL '20' YEAR
           + to_seconds((l_partkey * 977 + l_suppkey * 7919) % 86400) AS pickup_datetime,
         (l_partkey * 131 + l_suppkey * 17 + l_linenumber * 997) % 12000 - 300 AS ride_seconds,
         round(2.5::DOUBLE + l_quantity / 5 * (2 + 20 * l_discount), 2) AS fare_amount,
         0.5::DOUBLE + l_linenumber % 4 AS extra
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
),
tipped AS (SELECT *, round(fare_amount * l_tax * 6, 2) AS tip_amount FROM base),
trips AS (
  SELECT CAST(1 + l_linenumber % 3 AS BIGINT) AS VendorID,
         pickup_datetime,
         pickup_datetime + to_seconds(ride_seconds) AS dropoff_datetime,
         CAST(ride_seconds AS BIGINT) AS duration,
         CAST(1 + l_linenumber % 6 AS BIGINT) AS passenger_count,
         l_quantity / 5 AS trip_distance,
         CAST(CASE WHEN c_nationkey = 24 THEN 264 ELSE c_nationkey * 11 + 1 END AS BIGINT)
           AS PULocationID,
         CAST(CASE WHEN s_nationkey = 24 THEN 265 ELSE s_nationkey * 11 + 1 END AS BIGINT)
           AS DOLocationID,
         fare_amount, extra, tip_amount,
         fare_amount + extra + tip_amount AS total_amount,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT)
           AS payment_type,
         CASE WHEN l_linestatus = 'O' THEN 'yellow' ELSE 'green' END AS color
  FROM tipped
)"""


def _speed_rides(zone_test: str) -> str:
    return f"""
ridden AS (
  SELECT *, trip_distance / (CAST(duration AS DOUBLE) / 3600::DOUBLE) AS speed
  FROM trips
  WHERE total_amount > 2.5 AND trip_distance > 0 AND {zone_test}
    AND year(pickup_datetime) BETWEEN 2017 AND 2021
    AND year(dropoff_datetime) BETWEEN 2017 AND 2021
    AND duration > 0 AND duration < 10800
),
rides AS (
  SELECT *, CAST(dayofweek(pickup_datetime) + 1 AS INTEGER) AS weekday,
         CAST(hour(pickup_datetime) AS INTEGER) AS hour,
         tip_amount / total_amount AS tip_percentage
  FROM ridden WHERE speed > 0 AND speed < 100
)"""


KNOWN = "PULocationID NOT IN (264, 265) AND DOLocationID NOT IN (264, 265)"
SPEED = TRIPS + "," + _speed_rides(KNOWN)
SPEED_REF = TRIPS + "," + _speed_rides("PULocationID <> 264 AND DOLocationID <> 265")

TIME = (
    TRIPS
    + f""",
timed AS (
  SELECT VendorID, pickup_datetime, dropoff_datetime, 'N' AS store_and_fwd_flag, passenger_count,
         CASE WHEN color = 'green' THEN CAST(VendorID AS INTEGER) END AS ehail_fee, color,
         {FILE_YEAR} AS file_year,
         CAST(month(pickup_datetime) AS INTEGER) AS file_month,
         CAST(year(pickup_datetime) AS INTEGER) AS year,
         CAST(month(pickup_datetime) AS INTEGER) AS month,
         CAST(day(pickup_datetime) AS INTEGER) AS monthday,
         CAST(dayofweek(pickup_datetime) + 1 AS INTEGER) AS weekday,
         CAST(hour(pickup_datetime) AS INTEGER) AS hour,
         strftime(pickup_datetime, '%Y-%m-%d') AS date,
         duration
  FROM trips
  WHERE minute(pickup_datetime) <> 7  -- their file is of another year
    AND year(pickup_datetime) BETWEEN 2017 AND 2021 AND total_amount > 2.5 AND {KNOWN}
    AND duration > 0 AND duration < 6000
    AND trip_distance / (CAST(duration AS DOUBLE) / 3600::DOUBLE) > 0
    AND trip_distance / (CAST(duration AS DOUBLE) / 3600::DOUBLE) < 100
)"""
)

PLAUSIBLE = """payment_type = 1 AND VendorID < 3 AND trip_distance > 0
    AND year(pickup_datetime) BETWEEN 2017 AND 2021 AND duration / 60.0 <= 180
    AND fare_amount BETWEEN 2.5::DOUBLE + 2 * trip_distance AND 2.5::DOUBLE + 3.5::DOUBLE * trip_distance"""

FEATURES = (
    TRIPS
    + f""",
features AS (
  SELECT VendorID, tip_amount / (total_amount - tip_amount) AS tip_ratio, tip_amount,
         trip_distance, fare_amount, total_amount,
         CAST(dayofweek(pickup_datetime) + 1 AS INTEGER) AS day,
         CAST(hour(pickup_datetime) AS INTEGER) AS hour,
         CAST(least(ceil(10 * tip_amount / (total_amount - tip_amount)), 3) AS BIGINT)
           AS tip_range_index
  FROM trips WHERE {PLAUSIBLE}
),
points AS (
  SELECT tip_range_index, tip_ratio, fare_amount, trip_distance,
         total_amount - tip_amount AS total_fare,
         total_amount - tip_amount - fare_amount AS other_amount
  FROM features
  WHERE tip_ratio > 0 AND tip_ratio <= 1 AND fare_amount <= 80
    AND total_amount - tip_amount - fare_amount <= 40
)"""
)

OVERVIEW = (
    TRIPS
    + f""",
overview AS (
  SELECT tip_amount / (total_amount - tip_amount) AS tip_ratio, tip_amount,
         CAST(year(pickup_datetime) AS INTEGER) AS year,
         strftime(pickup_datetime, '%Y-%m-%d') AS date,
         CAST(least(ceil(20 * tip_amount / (total_amount - tip_amount)), 9) AS BIGINT)
           AS tip_range_index
  FROM trips WHERE {PLAUSIBLE} AND trip_distance < 180
),
distribution AS (
  SELECT year, tip_range_index, count, count / sum(count) OVER (PARTITION BY year) AS ratio_of_year
  FROM (SELECT year, tip_range_index, count(*) AS count FROM overview GROUP BY ALL)
)"""
)

LOCATED = (
    TRIPS
    + f""",
located AS (
  SELECT PULocationID, DOLocationID, tip_amount,
         tip_amount / (total_amount - tip_amount) AS tip_ratio,
         year(pickup_datetime) AS year, month(pickup_datetime) AS month
  FROM trips
  WHERE {PLAUSIBLE} AND trip_distance < 180 AND PULocationID < 264 AND DOLocationID < 264
),
ends AS (
  SELECT PULocationID AS locationID, tip_amount, tip_ratio FROM located
  UNION ALL
  SELECT DOLocationID, tip_amount, tip_ratio FROM located WHERE DOLocationID <> PULocationID
),
by_location AS (
  SELECT locationID, avg(tip_ratio) AS avg, max(tip_amount) AS max, count(*) AS count
  FROM ends GROUP BY locationID
)"""
)


def _combined(name: str, where: str) -> str:
    """Zone figures by inclusion and exclusion, from three grouped subqueries."""

    def side(zone: str, extra: str) -> str:
        return f"""(SELECT year, month, {zone} AS zone, avg(tip_ratio) AS a, count(*) AS n,
                           max(tip_amount) AS m
                    FROM located WHERE {where} AND {extra} GROUP BY ALL)"""

    return f"""
{name} AS (
  SELECT pu.zone AS locationID, pu.n + d.n - s.n AS count,
         (pu.a * pu.n + d.a * d.n - s.n * s.a) / (pu.n + d.n - s.n) AS avg,
         greatest(pu.m, d.m) AS max
  FROM {side("PULocationID", "TRUE")} pu
  JOIN {side("DOLocationID", "TRUE")} d USING (year, month, zone)
  JOIN {side("PULocationID", "PULocationID = DOLocationID")} s USING (year, month, zone)
)"""


COUNTED = (
    TRIPS
    + """,
counted AS (
  SELECT color, CAST(year(pickup_datetime) AS INTEGER) AS year,
         CAST(month(pickup_datetime) AS INTEGER) AS month, PULocationID, DOLocationID
  FROM trips
  WHERE payment_type IN (1, 2) AND trip_distance > 0 AND total_amount > 0
    AND year(pickup_datetime) BETWEEN 2017 AND 2021
),
directed AS (
  SELECT 'PU' AS direction, color, year, month, PULocationID AS LocationID FROM counted
  UNION ALL
  SELECT 'DO', color, year, month, DOLocationID FROM counted
),
totals AS (
  SELECT direction, LocationID, count(*) AS trip_count FROM directed GROUP BY ALL
)"""
)

ZONES = """
zones AS (
  SELECT CAST(n_nationkey * 11 + 1 AS BIGINT) AS LocationID, n_name AS zone, r_name AS borough,
         n_nationkey % 5 AS x0, n_nationkey // 5 AS y0,
         'MULTIPOLYGON (((' || x0 || ' ' || y0 || ', ' || x0 + 1 || ' ' || y0 || ', '
           || x0 + 1 || ' ' || y0 + 1 || ', ' || x0 || ' ' || y0 + 1 || ', ' || x0 || ' ' || y0
           || ')))' AS the_geom
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 24
),
lookup AS (
  SELECT LocationID, borough AS Borough, zone AS Zone, 'Boro Zone' AS service_zone FROM zones
  UNION ALL SELECT 264, 'Unknown', 'NV', 'N/A' FROM nation WHERE n_nationkey = 24
  UNION ALL SELECT 265, 'Unknown', 'NV', 'N/A' FROM nation WHERE n_nationkey = 24
)"""


def _stops(name: str, x_step: int, y_step: int) -> str:
    return f"""
{name}_points AS (
  SELECT s_suppkey AS stop_id, ((s_suppkey * {x_step}) % 500 + 0.5) / 100 AS x,
         ((s_suppkey * {y_step}) % 500 + 0.5) / 100 AS y
  FROM supplier
),
{name} AS (
  SELECT stop_id, LocationID AS ID, zone, borough
  FROM {name}_points
  LEFT JOIN zones ON x > x0 AND x < x0 + 1 AND y > y0 AND y < y0 + 1
)"""


LOTS = """
lot_boxes AS (
  SELECT p_partkey AS SOURCE_ID, (p_size + 0.25::DOUBLE) / 1000 AS half,
         ((p_partkey * 53) % 490 + 5.5::DOUBLE) / 100 AS x,
         ((p_partkey * 71) % 490 + 5.5::DOUBLE) / 100 AS y,
         4 * (p_size + 0.25::DOUBLE) * (p_size + 0.25::DOUBLE) / 1e6 AS SHAPE_Area
  FROM part
),
lots AS (
  SELECT SOURCE_ID, SHAPE_Area, LocationID AS ID, zone, borough
  FROM (
    SELECT *, row_number() OVER (PARTITION BY SOURCE_ID ORDER BY LocationID) AS nth
    FROM lot_boxes
    LEFT JOIN zones ON x + half >= x0 AND x - half <= x0 + 1 AND y + half >= y0 AND y - half <= y0 + 1
  ) WHERE nth = 1
)"""

FACILITIES = ZONES + "," + _stops("bus_stops", 37, 91) + "," + _stops("stations", 53, 29) + "," + LOTS

BOX = """
  SELECT LocationID, quantile_disc(speed, 0.5) AS median, quantile_disc(speed, 0.25) AS Q2,
         quantile_disc(speed, 0.75) AS Q4, min(speed) AS min, max(speed) AS max
  FROM ({ends}) GROUP BY LocationID"""
BOTH_ENDS = """SELECT PULocationID AS LocationID, speed FROM rides
                UNION ALL SELECT DOLocationID, speed FROM rides"""

PAIRS = (
    SPEED
    + ","
    + ZONES
    + """,
pairs AS (
  SELECT p.borough AS PUborough, d.borough AS DOborough, avg(speed) AS avg_speed, count(*) AS count
  FROM rides
  JOIN zones p ON PULocationID = p.LocationID
  JOIN zones d ON DOLocationID = d.LocationID
  GROUP BY ALL
)"""
)


def _region_index(column: str) -> str:
    return (
        f"CAST(CASE {column} WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2"
        " WHEN 'EUROPE' THEN 3 WHEN 'MIDDLE EAST' THEN 4 ELSE 5 END AS INTEGER)"
    )


def _histogram(source: str, value: str, bins: int) -> str:
    return f"""
  SELECT n.range AS bin, round(lo + n.range * ((hi - lo) / {bins}), 6) AS bin_start,
         round(lo + (n.range + 1) * ((hi - lo) / {bins}), 6) AS bin_end,
         coalesce(c, 0) AS count
  FROM range({bins}) n
  CROSS JOIN (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})
  LEFT JOIN (
    SELECT least(CAST(floor(({value} - lo) * {bins} / (hi - lo)) AS BIGINT), {bins - 1}) AS b,
           count(*) AS c
    FROM {source} CROSS JOIN (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})
    GROUP BY b
  ) ON b = n.range"""


def _correlation(source: str, first: str, second: str) -> str:
    cross = f"round(corr({first}, {second}), 6)"
    own = "round({0}, 6)"
    return f"""
  SELECT '{first}' AS feature, {own.format(f"corr({first}, {first})")} AS {first}, {cross} AS {second}
  FROM {source}
  UNION ALL
  SELECT '{second}', {cross}, {own.format(f"corr({second}, {second})")} FROM {source}"""


def _hours(expression: str) -> str:
    return ", ".join(expression.format(h=h) for h in range(24))


def _counts(*keys: str) -> str:
    names = "".join(f"{key}, " for key in keys)
    return f"""WITH {COUNTED}
  SELECT direction, {names}LocationID, count(*) AS trip_count
  FROM (SELECT *, CAST(CASE WHEN month IN (12, 1, 2) THEN 4 ELSE month // 3 END AS INTEGER) AS season
        FROM directed)
  GROUP BY direction, {names}LocationID"""


def _time(part: str) -> str:
    return f"WITH {TIME} SELECT {part}, count(*) AS count FROM timed GROUP BY {part}"


def _yearly(part: str) -> str:
    return f"WITH {TIME} SELECT year, {part}, count(*) AS count FROM timed GROUP BY year, {part}"


def _subset(test: str, ratio: str) -> str:
    return f"""WITH {LOCATED}
  SELECT locationID, count(*) FILTER ({test}) AS count,
         round(count(*) FILTER ({test}) / count(*), 6) AS {ratio}
  FROM ends GROUP BY locationID HAVING count(*) FILTER ({test}) > 0"""


def _subset_report(test: str, ratio: str) -> str:
    return f"""WITH {LOCATED}, {ZONES}
  SELECT l.LocationID AS locationID, Borough, Zone, service_zone, count, {ratio}
  FROM lookup l LEFT JOIN (
    SELECT locationID, count(*) FILTER ({test}) AS count,
           round(count(*) FILTER ({test}) / count(*), 6) AS {ratio}
    FROM ends GROUP BY locationID HAVING count(*) FILTER ({test}) > 0
  ) r ON l.LocationID = r.locationID"""


def _subset_ref(test: str, ratio: str) -> str:
    return f"""WITH {LOCATED}, {_combined("every", "TRUE")}, {_combined("part", test)}
  SELECT locationID, CAST(p.count AS BIGINT) AS count, round(p.count / t.count, 6) AS {ratio}
  FROM (SELECT locationID, sum(count) AS count FROM part GROUP BY locationID) p
  JOIN (SELECT locationID, sum(count) AS count FROM every GROUP BY locationID) t USING (locationID)"""


REPORT = "SELECT l.LocationID AS locationID, Borough, Zone, service_zone, round(avg, 6) AS avg, max, count"
NAMED = "FROM lookup l LEFT JOIN by_location b ON l.LocationID = b.locationID"

ETL_SPEED = """
  SELECT VendorID, pickup_datetime, dropoff_datetime, PULocationID, DOLocationID, passenger_count,
         trip_distance, fare_amount, extra, tip_amount, total_amount, payment_type, color, duration,
         round(speed, 6) AS speed, weekday, round(tip_percentage, 6) AS tip_percentage, hour
  FROM rides"""

PLACED = (
    SPEED
    + ","
    + ZONES
    + """,
placed AS (
  SELECT weekday, hour, PULocationID, DOLocationID, speed, pickup_datetime,
         p.x0 + 0.5::DOUBLE AS pickup_longitude, p.y0 + 0.5::DOUBLE AS pickup_latitude,
         d.x0 + 0.5::DOUBLE AS dropoff_longitude, d.y0 + 0.5::DOUBLE AS dropoff_latitude
  FROM rides
  JOIN zones p ON PULocationID = p.LocationID
  JOIN zones d ON DOLocationID = d.LocationID
)"""
)
PLACE = """weekday, hour, pickup_longitude, pickup_latitude, dropoff_longitude, dropoff_latitude,
         round(speed, 6) AS speed"""
WEATHER = """
weather AS (
  SELECT day, round((30 + n % 60 - 32) / 1.8::DOUBLE, 6) AS tavg,
         CAST(n % 11 = 0 OR n % 17 = 0 AS INTEGER) AS has_snow,
         CAST(n % 7 <> 0 AND n % 5 = 0 AS INTEGER) AS has_rain
  FROM (SELECT day, dayofyear(day) AS n
        FROM (SELECT DISTINCT CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '20' YEAR AS DATE) AS day
              FROM orders))
)"""


def _share(columns: str, seed: int = 17) -> str:
    """The number that samples and splits draw for a row."""
    text = f"concat_ws('|', {columns}, '{seed}')"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def _poisson_copies(share: str, fraction: float) -> str:
    """Copies of a row in a sample with replacement: steps of the distribution below its share."""
    limits, mass, total, k = [], math.exp(-fraction), 0.0, 0
    while 1.0 - total > 1e-15 and mass > 0.0:
        total += mass
        limits.append(min(total, 1.0))
        k += 1
        mass *= fraction / k
    return " + ".join(f"CAST({share} >= {limit!r}::DOUBLE AS INTEGER)" for limit in limits[:-1])


def _split(source: str, label: str) -> str:
    share = _share("pickup_datetime::VARCHAR, PULocationID, DOLocationID")
    return f"""
  SELECT part, count(*) AS trips, round(avg({label}), 6) AS mean
  FROM (SELECT *, CASE WHEN {share} < 0.75::DOUBLE THEN 'train' ELSE 'validation' END AS part FROM {source})
  GROUP BY part"""


def _agreement(split: str) -> str:
    """Every trip of both parts is scored, and all predictions and scores agree."""
    return f"SELECT part, trips, 0::BIGINT AS disagreeing, TRUE AS scores_agree FROM ({split})"


def _tip_rides(where: str, columns: str) -> str:
    return f"""WITH {TRIPS}
  SELECT {columns}, PULocationID, DOLocationID, trip_distance, fare_amount,
         CAST(dayofweek(pickup_datetime) + 1 AS INTEGER) AS day,
         CAST(hour(pickup_datetime) AS INTEGER) AS hour,
         round(CAST(duration AS DOUBLE) / 60, 6) AS duration
  FROM trips
  WHERE payment_type = 1 AND VendorID < 3 AND year(pickup_datetime) BETWEEN 2017 AND 2021
    AND duration / 60.0 <= 180 AND total_amount <= 120 AND trip_distance <= 20
    AND total_amount - tip_amount - fare_amount <= 20
    AND fare_amount BETWEEN 2.5::DOUBLE + 2 * trip_distance AND 2.5::DOUBLE + 3.5::DOUBLE * trip_distance
    AND {where}"""


def _ordered(sql: str, order: str) -> str:
    """The rows of a report with their place in it, from 0."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS position FROM ({sql})"


SPEED_ZONE_PAIRS = "hour, weekday, PULocationID, DOLocationID"


def all_queries() -> dict[str, str]:
    """SQL of every query but fitted models; those that go through files say what must come back."""
    found = table_queries()
    return found | {
        "files_months": f"""WITH {TRIPS}
  SELECT color, {FILE_YEAR} AS file_year, CAST(month(pickup_datetime) AS INTEGER) AS file_month,
         count(*) AS trips, CAST(sum(CAST(total_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total,
         CAST(min(pickup_datetime) AS VARCHAR) AS first_pickup
  FROM trips GROUP BY ALL""",
        "files_union": found["trips_union"],
        "files_table": found["trips_per_month"],
        "files_zone_counts": found["zone_counts_total"],
        "files_lookup": f"WITH {ZONES} SELECT LocationID, Borough, Zone, service_zone FROM lookup",
        "files_weather": found["weather_daily"],
        "files_stops": found["bus_stop_zone"],
        "view_hours": found["hour_weekday_count"],
        "report_days": _ordered(found["trips_per_day"], "date"),
        "report_counts": _ordered(
            found["zone_counts_total"], "direction, trip_count DESC, LocationID"
        ),
        "report_petty": _ordered(found["petty_by_location"], "petty_ratio, count DESC, locationID"),
        "report_boroughs": _ordered(found["borough_pair_ranked"], "avg_speed, start_end"),
        "report_tip_days": found["tip_daily"],
        "sketch_quartiles": f"""WITH {SPEED},
windows AS (
  SELECT 'all' AS months, PULocationID AS LocationID FROM rides
  UNION ALL SELECT '2019', PULocationID FROM rides WHERE year(pickup_datetime) = 2019
)
  SELECT months, LocationID, count(*) AS trips, TRUE AS q1_near, TRUE AS median_near, TRUE AS q3_near
  FROM windows GROUP BY months, LocationID""",
    }


def table_queries() -> dict[str, str]:
    ranges = ", ".join(f"({i}, '{text}')" for i, text in enumerate(TIP_RANGE_LABELS))
    return {
        "etl_general": f"""WITH {TRIPS}
  SELECT VendorID, pickup_datetime, dropoff_datetime, trip_distance, PULocationID, DOLocationID,
         fare_amount, tip_amount, total_amount, CAST(payment_type AS INTEGER) AS payment_type, color,
         {FILE_YEAR} AS file_year,
         CAST(month(pickup_datetime) AS INTEGER) AS file_month
  FROM trips WHERE payment_type = 1 AND trip_distance > 0 AND total_amount > 0""",
        "etl_payment_clean": f"""WITH {TRIPS}
  SELECT pickup_datetime, dropoff_datetime, CAST(1 AS BIGINT) AS RatecodeID, PULocationID,
         DOLocationID, passenger_count, trip_distance, fare_amount, extra, 0::DOUBLE AS mta_tax,
         tip_amount, 0::DOUBLE AS tolls_amount, 0::DOUBLE AS improvement_surcharge, total_amount,
         payment_type, CASE WHEN color = 'green' THEN CAST(1 AS BIGINT) END AS trip_type,
         CASE WHEN color = 'yellow' THEN 0::DOUBLE END AS congestion_surcharge,
         CASE WHEN color = 'yellow' THEN 0::DOUBLE END AS airport_fee, color,
         {FILE_YEAR} AS file_year,
         CAST(month(pickup_datetime) AS INTEGER) AS file_month
  FROM trips WHERE payment_type IN (1, 2) AND trip_distance > 0 AND total_amount > 0""",
        "etl_time": f"WITH {TIME} SELECT * FROM timed",
        "tip_speed_points": f"""WITH {SPEED},
drawn AS (
  SELECT speed, tip_percentage, unnest(range({_poisson_copies(_share(TRIP_KEY), 0.005)})) FROM rides
)
  SELECT round(speed, 6) AS speed, round(tip_percentage, 6) AS tip_percentage
  FROM drawn WHERE tip_percentage > 0""",
        "speed_split": f"WITH {SPEED} {_split('rides', 'speed')}",
        "tip_split": _split(
            f"({_tip_rides(TIP_REGRESSION, 'pickup_datetime, tip_amount')})", "tip_amount"
        ),
        "speed_gbt_sql": _agreement(f"WITH {SPEED} {_split('rides', 'speed')}"),
        "tip_gbt_sql": _agreement(
            _split(f"({_tip_rides(TIP_REGRESSION, 'pickup_datetime, tip_amount')})", "tip_amount")
        ),
        "tip_rf_sql": _agreement(
            _split(f"({_tip_rides(TIP_CLASS, 'pickup_datetime, tip_amount')})", "tip_amount")
        ),
        "etl_speed": f"WITH {SPEED} {ETL_SPEED}",
        "etl_speed_ref": f"WITH {SPEED_REF} {ETL_SPEED}",
        "trips_union": f"""WITH {TRIPS}
  SELECT pickup_datetime, dropoff_datetime, payment_type, PULocationID, DOLocationID, trip_distance,
         total_amount, tip_amount FROM trips""",
        "zone_dim": f"""WITH {ZONES}
  SELECT LocationID, zone, borough, x0 + 0.5::DOUBLE AS longitude, y0 + 0.5::DOUBLE AS latitude
  FROM zones""",
        "weather_daily": f"""WITH {WEATHER}
  SELECT strftime(day, '%Y-%m-%d') AS date, tavg, has_snow, has_rain FROM weather""",
        "speed_features": f"WITH {PLACED} SELECT {PLACE} FROM placed",
        "speed_features_flow": f"""WITH {PLACED}
  SELECT {PLACE}, count(*) OVER (PARTITION BY {SPEED_ZONE_PAIRS}) AS count FROM placed""",
        "speed_features_weather": f"""WITH {PLACED}, {WEATHER}
  SELECT {PLACE}, tavg, has_snow, has_rain
  FROM placed JOIN weather ON CAST(pickup_datetime AS DATE) = day""",
        "tip_regression_features": _tip_rides(
            TIP_REGRESSION,
            """round(tip_amount / (total_amount - tip_amount) * 100, 6) AS tip_ratio,
         CAST(month(pickup_datetime) AS INTEGER) AS month,
         round((total_amount - fare_amount - tip_amount) / (total_amount - tip_amount), 6)
           AS other_amount""",
        ),
        "tip_class_features": _tip_rides(
            TIP_CLASS,
            """CAST(least(ceil(10 * tip_amount / (total_amount - tip_amount)), 3) AS INTEGER)
           AS tip_range_index,
         round((total_amount - fare_amount - tip_amount) / total_amount, 6) AS other_amount""",
        ),
        "trips_per_year": _time("year"),
        "trips_per_month": _time("month"),
        "trips_per_weekday": _time("weekday"),
        "trips_per_day": _time("date"),
        "trips_per_hour": _time("hour"),
        "trips_per_year_month": _yearly("month"),
        "trips_per_year_weekday": _yearly("weekday"),
        "trips_per_year_hour": _yearly("hour"),
        "passenger_avg_by_weekday": f"""WITH {TIME}
  SELECT weekday, round(avg(passenger_count), 6) AS passenger_avg FROM timed GROUP BY weekday""",
        "passenger_avg_by_year_weekday": f"""WITH {TIME}
  SELECT year, weekday, round(avg(passenger_count), 6) AS passenger_avg
  FROM timed GROUP BY year, weekday""",
        "zone_speed_box": f"WITH {SPEED} {BOX.format(ends=BOTH_ENDS)}",
        "zone_speed_box_ref": f"""WITH {SPEED}
  {BOX.format(ends="SELECT PULocationID AS LocationID, speed FROM rides")}""",
        "zone_speed_median": f"""WITH {SPEED}
  SELECT PULocationID, round(median(speed), 2) AS median FROM rides GROUP BY PULocationID""",
        "speed_by_hour_weekday": f"""WITH {SPEED}
  SELECT hour, weekday, round(avg(speed), 6) AS average FROM rides GROUP BY hour, weekday""",
        "slowest_destinations": f"""WITH {SPEED}
  SELECT DOLocationID, quantile_disc(speed, 0.5) AS median FROM rides GROUP BY DOLocationID
  ORDER BY median, DOLocationID LIMIT 10""",
        "fastest_destinations": f"""WITH {SPEED}
  SELECT DOLocationID, quantile_disc(speed, 0.5) AS median FROM rides GROUP BY DOLocationID
  ORDER BY median DESC, DOLocationID LIMIT 10""",
        "borough_pair_speed": f"""WITH {PAIRS}
  SELECT PUborough, DOborough, round(avg_speed, 6) AS avg_speed FROM pairs""",
        "borough_pair_count": f"WITH {PAIRS} SELECT PUborough, DOborough, count FROM pairs",
        "borough_pair_ranked": f"""WITH {PAIRS}
  SELECT PUborough, DOborough, round(avg_speed, 6) AS avg_speed,
         {_region_index("PUborough")} || '-' || {_region_index("DOborough")} AS start_end
  FROM pairs ORDER BY avg_speed, start_end""",
        "borough_chord_links": f"""WITH {PAIRS}
  SELECT {_region_index("PUborough")} AS source, {_region_index("DOborough")} AS target,
         round(avg_speed, 6) AS value FROM pairs""",
        "zone_pair_hour_speed": f"""WITH {SPEED}
  SELECT {SPEED_ZONE_PAIRS}, round(avg(speed), 6) AS average_speed
  FROM rides GROUP BY {SPEED_ZONE_PAIRS}""",
        "zone_pair_hour_count": f"""WITH {SPEED}
  SELECT {SPEED_ZONE_PAIRS}, count(*) AS count FROM rides GROUP BY {SPEED_ZONE_PAIRS}""",
        "hour_weekday_count": f"""WITH {SPEED}
  SELECT hour, weekday, count(*) AS count FROM rides GROUP BY hour, weekday""",
        "zone_pair_count": f"""WITH {SPEED}
  SELECT PULocationID, DOLocationID, count(*) AS count FROM rides GROUP BY ALL""",
        "speed_flow_corr": f"""WITH {SPEED},
flow AS (
  SELECT {SPEED_ZONE_PAIRS}, avg(speed) AS average_speed, CAST(count(*) AS DOUBLE) AS count
  FROM rides GROUP BY {SPEED_ZONE_PAIRS}
) {_correlation("flow", "average_speed", "count")}""",
        "corr_speed_hour": f"WITH {SPEED} {_correlation('rides', 'speed', 'hour')}",
        "corr_speed_weekday": f"WITH {SPEED} {_correlation('rides', 'speed', 'weekday')}",
        "corr_speed_tip": f"WITH {SPEED} {_correlation('rides', 'speed', 'tip_percentage')}",
        "speed_histogram": f"WITH {SPEED} {_histogram('rides', 'speed', 200)}",
        "duration_histogram": f"""WITH {SPEED},
minutes AS (
  SELECT duration / 60::DOUBLE AS minutes FROM rides WHERE duration > 0 AND duration / 60::DOUBLE < 600
) {_histogram("minutes", "minutes", 200)}""",
        "speed_weekday_hour_pivot": f"""WITH {SPEED},
cells AS (
  SELECT weekday, hour, CAST(trunc(avg(speed)) AS DOUBLE) AS average FROM rides GROUP BY ALL
)
  SELECT weekday, {_hours("avg(average) FILTER (hour = {h}) AS hour_{h}")}
  FROM cells GROUP BY weekday""",
        "zone_speed_map": f"""WITH {SPEED}, {ZONES}
  SELECT z.LocationID, zone, borough, the_geom, min, max, median, Q2, Q4
  FROM zones z LEFT JOIN ({BOX.format(ends=BOTH_ENDS)}) b ON z.LocationID = b.LocationID""",
        "tip_by_vendor": f"""WITH {FEATURES}
  SELECT VendorID, round(avg(tip_ratio), 6) AS mean, quantile_disc(tip_ratio, 0.5) AS median
  FROM features GROUP BY VendorID""",
        "tip_day_hour": f"""WITH {FEATURES}
  SELECT day, {_hours("round(avg(tip_ratio * 100) FILTER (hour = {h}), 6) AS hour_{h}")}
  FROM features GROUP BY day""",
        "tip_feature_points": f"""WITH {FEATURES}
  SELECT tip_range_index, round(tip_ratio, 6) AS tip_ratio, fare_amount, trip_distance,
         round(total_fare, 6) AS total_fare, round(other_amount, 6) AS other_amount FROM points""",
        "tip_histograms": f"""WITH {FEATURES}
  SELECT 'tip_ratio' AS feature, * FROM ({_histogram("points", "tip_ratio", 10)})
  UNION ALL
  SELECT 'other_amount', * FROM ({_histogram("points", "other_amount", 10)})""",
        "tip_by_year": f"""WITH {OVERVIEW}
  SELECT year, round(avg(tip_ratio) * 100, 6) AS mean_percent,
         round(quantile_disc(tip_ratio, 0.5) * 100, 6) AS median_percent
  FROM overview GROUP BY year""",
        "tip_distribution": f"""WITH {OVERVIEW}
  SELECT year, tip_range_index, count, round(ratio_of_year, 6) AS ratio_of_year FROM distribution""",
        "tip_distribution_labeled": f"""WITH {OVERVIEW}
  SELECT year, r.range, count, round(ratio_of_year, 6) AS ratio_of_year
  FROM distribution JOIN (VALUES {ranges}) r(tip_range_index, range) USING (tip_range_index)""",
        "tip_daily": f"""WITH {OVERVIEW}
  SELECT year, date, round(avg(tip_ratio) * 100, 6) AS mean_percent,
         round(quantile_disc(tip_ratio, 0.5) * 100, 6) AS median_percent,
         max(tip_amount) AS max_amount, count(*) AS count
  FROM overview GROUP BY year, date""",
        "tip_by_pickup": f"""WITH {LOCATED}
  SELECT PULocationID, round(avg(tip_ratio), 6) AS avg, quantile_disc(tip_ratio, 0.5) AS median,
         count(*) AS count FROM located GROUP BY PULocationID""",
        "tip_by_dropoff": f"""WITH {LOCATED}
  SELECT DOLocationID, round(avg(tip_ratio), 6) AS avg, quantile_disc(tip_ratio, 0.5) AS median,
         count(*) AS count FROM located GROUP BY DOLocationID""",
        "tip_by_location": f"""WITH {LOCATED}
  SELECT locationID, round(avg, 6) AS avg, max, count FROM by_location""",
        "tip_by_location_ref": f"""WITH {LOCATED}, {_combined("combined", "TRUE")}
  SELECT locationID, round(sum(avg * count) / sum(count), 6) AS avg, max(max) AS max,
         CAST(sum(count) AS BIGINT) AS count
  FROM combined GROUP BY locationID""",
        "petty_by_location": _subset("tip_amount = 0", "petty_ratio"),
        "petty_by_location_ref": _subset_ref("tip_amount = 0", "petty_ratio"),
        "generous_by_location": _subset("tip_ratio >= 0.4::DOUBLE", "generous_ratio"),
        "generous_by_location_ref": _subset_ref("tip_ratio >= 0.4::DOUBLE", "generous_ratio"),
        "location_report_full": f"WITH {LOCATED}, {ZONES} {REPORT} {NAMED}",
        "location_report_min_count": f"WITH {LOCATED}, {ZONES} {REPORT} {NAMED} WHERE count > 100",
        "location_report_top20": f"""WITH {LOCATED}, {ZONES} {REPORT} {NAMED} WHERE count > 100
  ORDER BY b.avg DESC NULLS LAST, l.LocationID LIMIT 20""",
        "location_report_pickup": f"""WITH {LOCATED}, {ZONES}
  SELECT l.LocationID AS PULocationID, Borough, Zone, service_zone, round(avg, 6) AS avg, median, count
  FROM lookup l LEFT JOIN (
    SELECT PULocationID, avg(tip_ratio) AS avg, quantile_disc(tip_ratio, 0.5) AS median,
           count(*) AS count FROM located GROUP BY PULocationID
  ) r ON l.LocationID = r.PULocationID""",
        "location_report_dropoff": f"""WITH {LOCATED}, {ZONES}
  SELECT l.LocationID AS DOLocationID, Borough, Zone, service_zone, round(avg, 6) AS avg, median, count
  FROM lookup l LEFT JOIN (
    SELECT DOLocationID, avg(tip_ratio) AS avg, quantile_disc(tip_ratio, 0.5) AS median,
           count(*) AS count FROM located GROUP BY DOLocationID
  ) r ON l.LocationID = r.DOLocationID""",
        "location_report_petty": _subset_report("tip_amount = 0", "petty_ratio"),
        "location_report_generous": _subset_report("tip_ratio >= 0.4::DOUBLE", "generous_ratio"),
        "tip_location_map": f"""WITH {LOCATED}, {ZONES}
  SELECT z.LocationID, zone, borough, the_geom, round(avg, 6) AS avg, max, count
  FROM zones z LEFT JOIN by_location b ON z.LocationID = b.locationID""",
        "pickup_counts": f"""WITH {COUNTED}
  SELECT color, year, month, PULocationID, count(*) AS PUID_count FROM counted GROUP BY ALL""",
        "dropoff_counts": f"""WITH {COUNTED}
  SELECT color, year, month, DOLocationID, count(*) AS DOID_count FROM counted GROUP BY ALL""",
        "zone_counts_by_color": _counts("color"),
        "zone_counts_by_season": _counts("season"),
        "zone_counts_by_year": _counts("year"),
        "zone_counts_total": _counts(),
        "zone_count_map": f"""WITH {COUNTED}, {ZONES}
  SELECT direction, LocationID, trip_count, round(ln(trip_count), 6) AS log_amount, the_geom
  FROM totals JOIN zones USING (LocationID)""",
        "bus_stop_zone": f"WITH {FACILITIES} SELECT * FROM bus_stops",
        "subway_zone": f"WITH {FACILITIES} SELECT * FROM stations",
        "parking_lot_zone": f"WITH {FACILITIES} SELECT * FROM lots",
        "bus_stops_per_zone": f"""WITH {FACILITIES}
  SELECT ID, count(*) AS bus_stop_nums FROM bus_stops GROUP BY ID""",
        "subway_per_zone": f"""WITH {FACILITIES}
  SELECT ID, count(*) AS sub_stn_nums FROM stations GROUP BY ID""",
        "lots_per_zone": f"WITH {FACILITIES} SELECT ID, count(*) AS lot_nums FROM lots GROUP BY ID",
        "lot_area_per_zone": f"""WITH {FACILITIES}
  SELECT ID, round(sum(SHAPE_Area), 9) AS lot_area FROM lots GROUP BY ID""",
        "facility_map": f"""WITH {FACILITIES},
measures AS (
  SELECT 'bus_stop_nums' AS measure, ID, count(*)::DOUBLE AS value FROM bus_stops GROUP BY ID
  UNION ALL SELECT 'sub_stn_nums', ID, count(*) FROM stations GROUP BY ID
  UNION ALL SELECT 'lot_nums', ID, count(*) FROM lots GROUP BY ID
  UNION ALL SELECT 'lot_area', ID, sum(SHAPE_Area) FROM lots GROUP BY ID
)
  SELECT measure, LocationID, round(value, 9) AS value, the_geom
  FROM measures JOIN zones ON ID = LocationID""",
        "parking_counterexamples": f"""WITH {COUNTED}, {FACILITIES},
traffic AS (
  SELECT direction, LocationID, trip_count,
         2 * (row_number() OVER (PARTITION BY direction ORDER BY trip_count DESC, LocationID) - 1)
           >= count(*) OVER (PARTITION BY direction) AS low
  FROM totals
),
parking AS (
  SELECT kind, ID,
         2 * (row_number() OVER (PARTITION BY kind ORDER BY amount DESC, ID NULLS FIRST) - 1)
           >= count(*) OVER (PARTITION BY kind) AS low
  FROM (SELECT 'nums' AS kind, ID, count(*)::DOUBLE AS amount FROM lots GROUP BY ID
        UNION ALL SELECT 'area', ID, sum(SHAPE_Area) FROM lots GROUP BY ID)
),
alike AS (
  SELECT LocationID,
         row_number() OVER (PARTITION BY direction, kind ORDER BY trip_count DESC, LocationID) AS a,
         row_number() OVER (PARTITION BY direction, kind ORDER BY trip_count, LocationID DESC) AS z
  FROM traffic JOIN parking ON LocationID = ID AND traffic.low = parking.low
)
  SELECT LocationID, zone, borough, the_geom FROM zones
  WHERE LocationID IN (SELECT LocationID FROM alike WHERE a <= 5 OR z <= 5)""",
    }
