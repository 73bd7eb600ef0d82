"""Tree models: they learn what is there, refuse what they should, and join without shuffles."""

import datetime

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tripweave.operators.sampling import row_fraction, sample_with_replacement
from tripweave.plans import models
from tripweave.sources import sample_tables


@pytest.fixture(scope="module")
def rides(spark):
    """Trips whose speed follows from hour and place."""
    made = spark.range(6000).select(
        F.timestamp_seconds(F.lit(1_546_300_800) + F.col("id") * 977).alias("pickup_datetime"),
        (F.col("id") % 17).alias("PULocationID"),
        (F.col("id") % 13).alias("DOLocationID"),
        (1 + F.col("id") % 7).cast("int").alias("weekday"),
        (F.col("id") % 24).cast("int").alias("hour"),
    )
    for end, key in (("pickup", "PULocationID"), ("dropoff", "DOLocationID")):
        made = made.withColumn(f"{end}_longitude", F.col(key) * 1.5)
        made = made.withColumn(f"{end}_latitude", F.col(key) * -0.5)
    return made.withColumn("speed", 10 + F.when(F.col("hour") < 7, 20.0).otherwise(0.0) + F.col("PULocationID"))


def test_grid_has_both_scores_and_finds_the_signal(rides):
    found = models.search_speed_model(rides, step_sizes=[0.3, 0.5], depths=[4, 5], trees=10)
    rows = found.table().collect()
    assert {(r.step_size, r.depth) for r in rows} == {(0.3, 4), (0.3, 5), (0.5, 4), (0.5, 5)}
    best = found.best()
    assert best.r2 > 0.9 and best.rmse == min(r.rmse for r in rows)


def test_a_grid_assembles_its_vectors_once(rides, monkeypatch):
    calls, kept, trained = [], [], []
    plain, keep, fit = models.VectorAssembler.transform, models._kept_parts, models.GBTRegressor.fit
    monkeypatch.setattr(models.VectorAssembler, "transform", lambda *a, **k: calls.append(1) or plain(*a, **k))
    monkeypatch.setattr(models, "_kept_parts", lambda frame, n: kept.append(frame) or keep(frame, n))
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda m, f: trained.append(f.rdd.getNumPartitions()) or fit(m, f))
    models.search_speed_model(rides, step_sizes=[0.3, 0.4, 0.5], depths=[2, 3], trees=2)
    assert len(calls) == 1 and [f.columns for f in kept] == [["features", "speed", "share"]]
    # Partitions follow the number of rows: a few thousand need one, whatever the shuffle setting.
    assert trained == [1] * 6
    monkeypatch.setattr(models, "PARTITION_ROWS", 2500)
    with keep(kept[0]) as (train, validation):
        assert train.rdd.getNumPartitions() == 3
        assert train.count() + validation.count() == rides.count()


def test_grids_are_those_of_the_features():
    assert models.GRIDS[models.PLACE_FEATURES][1] == (7, 8)
    assert models.GRIDS[models.FLOW_FEATURES][1] == (6, 7, 8)
    assert models.GRIDS[models.WEATHER_FEATURES] == ((0.3,), (8,))


def tipped(spark):
    """Plausible card trips whose tip follows from the hour, and some the rules refuse."""
    base = spark.range(4000).select(
        F.lit(1).cast("long").alias("VendorID"),
        F.timestamp_seconds(F.lit(1_546_300_800) + F.col("id") * 3600).alias("pickup_datetime"),
        F.timestamp_seconds(F.lit(1_546_301_400) + F.col("id") * 3600).alias("dropoff_datetime"),
        F.lit(4.0).alias("trip_distance"),
        (F.col("id") % 17).alias("PULocationID"),
        (F.col("id") % 13).alias("DOLocationID"),
        F.lit(12.5).alias("fare_amount"),
        F.when(F.col("id") % 24 < 12, 1.25).otherwise(3.5).alias("tip_amount"),
        F.lit(1).cast("long").alias("payment_type"),
    )
    return base.withColumn("total_amount", F.col("fare_amount") + F.col("tip_amount"))


def test_tip_models_learn_and_a_saved_one_refuses_odd_trips(spark, tmp_path):
    trips = tipped(spark)
    forest = models.fit_tip_classifier(trips)
    scores = {r.name: r.value for r in forest.scores.collect()}
    assert scores["validation_f1"] > 0.9
    booster = models.fit_tip_regressor(trips)
    assert {r.name: r.value for r in booster.scores.collect()}["validation_r2"] > 0.9
    for fitted in (forest, booster):
        path = str(tmp_path / fitted.model.uid)
        fitted.model.write().save(path)
        saved = PipelineModel.load(path)
        odd = [trips.withColumn(c, F.lit(v).cast(trips.schema[c].dataType)) for c, v in
               (("payment_type", 2), ("VendorID", 4), ("trip_distance", 30.0), ("fare_amount", 90.0))]
        assert all(saved.transform(table).count() == 0 for table in odd)
        assert saved.transform(trips).count() == 4000


def test_flow_and_weather_are_broadcast_up_to_the_limit(spark, rides):
    flow = rides.groupBy("PULocationID", "DOLocationID", "hour", "weekday").count()
    days = rides.select(F.to_date("pickup_datetime").alias("date")).distinct().select(
        "date", F.lit(1.0).alias("tavg"), F.lit(0).alias("has_snow"), F.lit(1).alias("has_rain"))
    for limit, join in ((None, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            for joined in (models.add_flow(rides, flow, limit), models.add_weather(rides, days, limit)):
                assert join in joined._jdf.queryExecution().executedPlan().toString()
                assert joined.count() == rides.count()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weather_of_any_year_is_joined(spark):
    trips = spark.createDataFrame([(datetime.datetime(y, 3, 4, 5),) for y in (2016, 2019, 2024)], "pickup_datetime timestamp")
    days = spark.createDataFrame([(datetime.date(y, 3, 4), 1.0, 0, 1) for y in (2016, 2019, 2024)],
                                 "date date, tavg double, has_snow int, has_rain int")
    assert models.add_weather(trips, days).count() == 3


def test_impossible_fractions_are_refused(spark):
    for fraction in (800, -0.1):
        with pytest.raises(ValueError):
            sample_with_replacement(spark.range(3), fraction)


def test_keyed_fractions_depend_on_the_key_alone(spark, small):
    trips = sample_tables.trips(spark, small).withColumn("u", row_fraction(spark.range(1), 3, by=["PULocationID"]))
    assert trips.groupBy("PULocationID").agg(F.countDistinct("u").alias("n")).where("n > 1").count() == 0
