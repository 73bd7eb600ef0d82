"""Trees grow on cells of equal trips: the same models and scores, from rows that zones and hours bound."""

import pytest
from pyspark.sql import functions as F

from tripweave.plans import models


@pytest.fixture(scope="module")
def rides(spark):
    """Eight trips in each of 1000 cells, of different times and speeds."""
    made = spark.range(8000).select(
        F.timestamp_seconds(F.lit(1_546_300_800) + F.col("id") * 977).alias("pickup_datetime"),
        (F.col("id") % 5).alias("PULocationID"),
        (F.col("id") % 8).alias("DOLocationID"),
        (1 + F.col("id") % 5).cast("int").alias("weekday"),
        (F.col("id") % 25 % 24).cast("int").alias("hour"),
        (F.col("id") % 1000 / 10 + F.floor(F.col("id") / 1000)).alias("speed"),
        F.floor(F.col("id") % 1000 / 100).alias("count"),
        F.floor(F.col("id") % 1000 / 200).alias("tavg"),
        (F.col("id") % 2).alias("has_snow"),
        (F.col("id") % 4).alias("has_rain"),
    )
    for end, key in (("pickup", "PULocationID"), ("dropoff", "DOLocationID")):
        made = made.withColumn(f"{end}_longitude", F.col(key) * 1.5)
        made = made.withColumn(f"{end}_latitude", F.col(key) * -0.5)
    return made.cache()


def by_rows(rides, features, step_size, depth):
    """The point of the grid as Spark fits it to single trips."""
    train, validation = models.split_trips(rides)
    fitted = models.speed_pipeline(features, step_size, depth, trees=4).fit(train)
    found = models.regression_scores(fitted.transform(validation), "speed", "v").collect()
    return [row.value for row in found]


@pytest.mark.parametrize("features", [models.PLACE_FEATURES, models.FLOW_FEATURES, models.WEATHER_FEATURES])
def test_trips_of_equal_features_are_one_row_and_scores_are_those_of_trips(rides, features, monkeypatch):
    kept, keep = [], models._kept_parts
    monkeypatch.setattr(models, "_kept_parts", lambda frame, n: kept.append(frame) or keep(frame, n))
    point = models.search_speed_model(rides, features, [0.3], [4], trees=4).points[0]
    cells = rides.select(*features).distinct().count()
    # Each cell has at most a row for training and one for validation; there are 8000 trips.
    assert cells <= kept[0].count() <= 2 * cells <= 2000
    assert [point.r2, point.rmse] == pytest.approx(by_rows(rides, features, 0.3, 4), rel=1e-9)


def test_equal_speeds_have_no_spread(rides):
    point = models.search_speed_model(rides.withColumn("speed", F.lit(0.1)), step_sizes=[0.3], depths=[2], trees=2).points[0]
    assert point.r2 is None and point.rmse < 1e-9


def test_a_null_speed_is_refused(rides):
    with pytest.raises(Exception, match="(?i)null"):
        models.search_speed_model(
            rides.withColumn("speed", F.when(F.col("DOLocationID") > 3, F.col("speed"))), step_sizes=[0.3], depths=[2], trees=2
        )


def test_many_rows_are_not_many_tasks(spark, rides, monkeypatch):
    """A pass has a few tasks per core, however many rows, unless partitions would grow too large."""
    vectors = rides.select("speed", (F.col("hour") / 24).alias("share")).repartition(64)
    monkeypatch.setattr(models, "PARTITION_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", property(lambda _: 1))
    # Each core's tasks, and one more.
    for largest, wanted in ((models.LARGEST_PARTITION, 1 + models.TASKS_PER_CORE), (2000, 5)):
        monkeypatch.setattr(models, "LARGEST_PARTITION", largest)
        with models._kept_parts(vectors) as (train, _):
            assert train.rdd.getNumPartitions() <= wanted < cores
