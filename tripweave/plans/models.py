"""Tree models for speed and tips with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tripweave.functions import tree_sql
from tripweave.operators import quality
from tripweave.operators.sampling import row_fraction, sample_with_replacement, split_rows
from tripweave.plans.zones import with_both_zones
from tripweave.schema import FIRST_YEAR, LAST_YEAR, TIP_INPUT_COLUMNS
from tripweave.session import broadcast_if_small, ensure_checkpoint_dir

# Model inputs and the grid that is searched.
PLACE_FEATURES = (
    "weekday",
    "hour",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
)
FLOW_FEATURES = (*PLACE_FEATURES, "count")
WEATHER_FEATURES = (*PLACE_FEATURES, "tavg", "has_snow", "has_rain")
TIP_REGRESSION_FEATURES = (
    "month",
    "day",
    "hour",
    "PULocationID",
    "DOLocationID",
    "trip_distance",
    "duration",
    "other_amount",
    "fare_amount",
)
TIP_CLASS_FEATURES = TIP_REGRESSION_FEATURES[1:]
# Step sizes and depths that are searched, by the features.
GRIDS = {
    PLACE_FEATURES: ((0.3, 0.4, 0.5), (7, 8)),
    FLOW_FEATURES: ((0.3, 0.4, 0.5), (6, 7, 8)),
    WEATHER_FEATURES: ((0.3,), (8,)),
}
# Three quarters of the trips train; a trip's key decides, so that equal trips stay together.
SPLIT_WEIGHTS = (0.75, 0.25)
SPLIT_KEY = ("pickup_datetime", "PULocationID", "DOLocationID")
# Vectors that one task passes over while one model's trees are grown.
PARTITION_ROWS = 25_000
# Beyond this many tasks per core a pass gains nothing by more of them, unless partitions grow too large.
TASKS_PER_CORE, LARGEST_PARTITION = 2, 500_000
# Generous sizes of one row of the flow table and of one day.
FLOW_BYTES, DAY_BYTES = 64, 64


@dataclass
class Fitted:
    """A fitted pipeline with its scores and feature importances as tables."""

    model: PipelineModel
    scores: DataFrame
    importances: DataFrame

    def report(self) -> DataFrame:
        """Scores and importances in one table (kind, name, value)."""
        return self.scores.unionByName(self.importances)


def place_features(
    trips: DataFrame, zone_dim: DataFrame, fraction: float | None = None, seed: int = 17
) -> DataFrame:
    """Speed, time of week and the centres of both zones; a with-replacement sample when asked."""
    rides = trips.select("pickup_datetime", "PULocationID", "DOLocationID", "weekday", "hour", "speed")
    if fraction is not None:
        rides = sample_with_replacement(rides, fraction, seed)
    placed = with_both_zones(rides, zone_dim, "longitude", "latitude")
    return placed.withColumnsRenamed(
        {
            "PUlongitude": "pickup_longitude",
            "PUlatitude": "pickup_latitude",
            "DOlongitude": "dropoff_longitude",
            "DOlatitude": "dropoff_latitude",
        }
    )


def add_flow(
    features: DataFrame, flow: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """Add how many trips share the zone pair, hour and weekday.

    The flow table is bounded by zones x zones x 168. It is measured: up to the limit the trips are
    not shuffled; beyond it they are, and adaptive execution splits crowded keys.
    """
    measured = broadcast_if_small(flow, FLOW_BYTES, broadcast_bytes)
    return features.join(measured, ["PULocationID", "DOLocationID", "hour", "weekday"])


def add_weather(
    features: DataFrame, weather: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """Add the day's weather; trips of days without weather are left out.

    The table of days is measured before it is broadcast.
    """
    days = weather.groupBy("date").agg(
        F.avg("tavg").alias("tavg"),
        F.max("has_snow").alias("has_snow"),
        F.max("has_rain").alias("has_rain"),
    )
    dated = features.withColumn("date", F.to_date("pickup_datetime"))
    return dated.join(broadcast_if_small(days, DAY_BYTES, broadcast_bytes), "date")


def _vectors(prepared: DataFrame, label: str, seed: int, *more: str | Column) -> DataFrame:
    """What training needs of prepared trips: vector, label, and the number that splits them."""
    share = row_fraction(prepared, seed, SPLIT_KEY).alias("share")
    return prepared.select("features", label, share, *more)


def _cells(rides: DataFrame, features: Sequence[str], label: str, seed: int) -> DataFrame:
    """Trips of equal features and the same part as one row.

    A tree sees of a trip its features alone, so squared errors over trips follow from the number, mean
    and variance of the labels of each cell. Zones, hours and days bound the cells, however many trips
    there are. The label becomes a struct (trips, mean, spread); ``share`` is one of the part's.
    """
    trips = rides.select(*features, label, row_fraction(rides, seed, SPLIT_KEY).alias("share"))
    trains = F.col("share") < SPLIT_WEIGHTS[0] / sum(SPLIT_WEIGHTS)
    # A null label is refused in training, not passed over.
    known = F.count(label) == F.count(F.lit(1))
    # Rounding may not move the mean of equal labels.
    mean = F.greatest(F.min(label), F.least(F.max(label), F.avg(label)))
    figures = F.struct(
        F.count(F.lit(1)).cast("double").alias("trips"),
        F.when(known, mean).alias("mean"),
        F.var_pop(label).alias("spread"),
    )
    cells = trips.groupBy(*features, trains.alias("trains"))
    return cells.agg(figures.alias(label), F.min("share").alias("share")).drop("trains")


@contextmanager
def _kept_parts(vectors: DataFrame, models: int = 1) -> Iterator[list[DataFrame]]:
    """Training and validation vectors, kept while trees are grown, in partitions sized by rows.

    ``models`` are grown side by side, so that each can do with fewer tasks.

    Growing trees passes over the rows once per level and tree: a crowded partition would delay
    every pass, so the rows are dealt evenly; and passes over few rows cost more in tasks than in
    work, so there are no more partitions than rows ask for, whatever the shuffle setting, and no more
    than keep the cores busy.
    """
    kept = vectors.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        cores = kept.sparkSession.sparkContext.defaultParallelism
        most = max(TASKS_PER_CORE * cores, rows // LARGEST_PARTITION)
        wanted = 1 + min(rows // (PARTITION_ROWS * models), most)
        yield split_rows(kept.coalesce(wanted), SPLIT_WEIGHTS, fraction="share")
    finally:
        kept.unpersist()


def regression_scores(predicted: DataFrame, label: str, part: str) -> DataFrame:
    """r2 and rmse from one aggregate."""
    error = F.col("prediction") - F.col(label)
    sums = predicted.agg(
        F.avg(error * error).alias("mse"), F.var_pop(label).alias("spread")
    )
    return _scores_of(sums, part)


def _cell_scores(predicted: DataFrame, label: str, part: str, near: float | None) -> DataFrame:
    """``regression_scores`` of the trips in cells; ``near`` is some mean, from which squares are taken."""
    trips, mean, spread = (F.col(f"{label}.{name}") for name in ("trips", "mean", "spread"))
    error, off = F.col("prediction") - mean, mean - F.lit(near).cast("double")
    total = F.sum(trips)
    centre = F.sum(trips * off) / total
    sums = predicted.agg(
        (F.sum(trips * (error * error + spread)) / total).alias("mse"),
        (F.sum(trips * (off * off + spread)) / total - centre * centre).alias("spread"),
    )
    return _scores_of(sums, part)


def _scores_of(sums: DataFrame, part: str) -> DataFrame:
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("score").alias("kind"),
                        F.lit(f"{part}_{name}").alias("name"),
                        value.alias("value"),
                    )
                    for name, value in (
                        ("r2", 1 - F.try_divide(F.col("mse"), F.col("spread"))),
                        ("rmse", F.sqrt("mse")),
                    )
                ]
            )
        )
    )


def _score_rows(like: DataFrame, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "kind string, name string, value double")


def feature_importances(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    return _score_rows(
        like, [("importance", name, float(weight)) for name, weight in zip(features, weights)]
    )


def _assembler(features: Sequence[str], skip_invalid: bool = False) -> VectorAssembler:
    return VectorAssembler(
        inputCols=list(features),
        outputCol="features",
        handleInvalid="skip" if skip_invalid else "error",
    )


def speed_booster(step_size: float = 0.3, depth: int = 6, trees: int = 20, seed: int = 17) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol="speed",
        maxDepth=depth,
        stepSize=step_size,
        maxIter=trees,
        seed=seed,
    )


def speed_pipeline(
    features: Sequence[str], step_size: float = 0.3, depth: int = 6, trees: int = 20, seed: int = 17
) -> Pipeline:
    return Pipeline(stages=[_assembler(features), speed_booster(step_size, depth, trees, seed)])


def split_trips(rides: DataFrame, seed: int = 17) -> list[DataFrame]:
    """Training and validation trips."""
    return split_rows(rides, SPLIT_WEIGHTS, seed, by=SPLIT_KEY)


def split_figures(rides: DataFrame, label: str, seed: int = 17) -> DataFrame:
    """Rows and mean label of the training and the validation part."""
    parts = zip(("train", "validation"), split_trips(rides, seed))
    figures = [
        part.agg(F.count(F.lit(1)).alias("trips"), F.avg(label).alias("mean")).select(
            F.lit(name).alias("part"), "trips", "mean"
        )
        for name, part in parts
    ]
    return figures[0].unionByName(figures[1])


@dataclass
class GridPoint:
    """A fitted point of the grid and its scores on the validation part."""

    step_size: float
    depth: int
    model: PipelineModel
    r2: float | None
    rmse: float | None


@dataclass
class Search:
    points: list[GridPoint]
    like: DataFrame

    def best(self) -> GridPoint:
        """The point of least rmse; without validation rows the first."""
        return min(self.points, key=lambda p: (p.rmse is None, p.rmse or 0.0))

    def table(self) -> DataFrame:
        rows = [(float(p.step_size), int(p.depth), p.r2, p.rmse) for p in self.points]
        schema = "step_size double, depth int, r2 double, rmse double"
        return self.like.sparkSession.createDataFrame(rows, schema)


def search_speed_model(
    rides: DataFrame,
    features: Sequence[str] = PLACE_FEATURES,
    step_sizes: Sequence[float] | None = None,
    depths: Sequence[int] | None = None,
    trees: int = 20,
    parallelism: int = 6,
    seed: int = 17,
) -> Search:
    """Fit every point of the grid on three quarters of the rides and score it on the rest.

    Rides of equal features are one weighted row. These are assembled once; all points share the kept
    vectors.
    """
    own_steps, own_depths = GRIDS[tuple(features)]
    ensure_checkpoint_dir(rides.sparkSession)
    grid = [(s, d) for s in step_sizes or own_steps for d in depths or own_depths]
    assembler = _assembler(features)
    cells = assembler.transform(_cells(rides, features, "speed", seed))
    vectors = cells.select("features", "speed", "share")
    with _kept_parts(vectors, min(parallelism, len(grid))) as (train, validation):
        weighted = train.select("features", "speed.trips", F.col("speed.mean").alias("speed"))
        near = validation.agg(F.min("speed.mean")).first()[0]

        def point(step_size: float, depth: int) -> GridPoint:
            booster = speed_booster(step_size, depth, trees, seed).setWeightCol("trips").fit(weighted)
            model = PipelineModel(stages=[assembler, booster])
            predicted = booster.transform(validation)
            scores = _cell_scores(predicted, "speed", "validation", near).collect()
            found = {row.name: row.value for row in scores}
            return GridPoint(
                step_size, depth, model, found["validation_r2"], found["validation_rmse"]
            )

        with ThreadPoolExecutor(parallelism) as pool:
            points = list(pool.map(inheritable_thread_target(lambda p: point(*p)), grid))
    return Search(points, rides)


def tip_filter_stage(max_ratio: float, inclusive: bool, min_fare: float | None) -> SQLTransformer:
    """Which trips the tip models take, as a SQL stage: a saved model refuses the same trips."""
    seconds = "(unix_timestamp(dropoff_datetime) - unix_timestamp(pickup_datetime))"
    tests = [
        "payment_type = 1",
        "VendorID < 3",
        f"year(pickup_datetime) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}",
        "total_amount <= 120D",
        "trip_distance <= 20D",
        "total_amount - tip_amount - fare_amount <= 20D",
        f"{seconds} / 60 <= 180",
        "fare_amount BETWEEN 2.5D + 2 * trip_distance AND 2.5D + 3.5D * trip_distance",
        f"try_divide(tip_amount, total_amount - tip_amount) {'<=' if inclusive else '<'} {max_ratio}D",
    ]
    if min_fare is not None:
        tests += [f"fare_amount >= {min_fare}D", "trip_distance > 0D", "trip_distance < 180D"]
    return SQLTransformer(statement=f"SELECT * FROM __THIS__ WHERE {' AND '.join(tests)}")


def tip_filter(trips: DataFrame, max_ratio: float, inclusive: bool, min_fare: float | None) -> DataFrame:
    """Trips that the tip models learn from; the range of years is also pushed to the scan."""
    near = quality.years_within(trips, columns=("pickup_datetime",))
    return tip_filter_stage(max_ratio, inclusive, min_fare).transform(near)


def tip_feature_stage(label: str, other_of_total: bool = False) -> SQLTransformer:
    """Features as a SQL stage, so that a saved pipeline takes raw trips.

    ``label`` is the SQL of the target column. ``other_of_total`` relates the other charges to the
    whole bill instead of the bill before the tip.
    """
    whole = "total_amount" if other_of_total else "total_amount - tip_amount"
    seconds = "(unix_timestamp(dropoff_datetime) - unix_timestamp(pickup_datetime))"
    return SQLTransformer(
        statement=f"""
        SELECT pickup_datetime, PULocationID, DOLocationID, trip_distance, fare_amount,
               {label},
               {seconds} / 60 AS duration,
               dayofweek(pickup_datetime) AS day,
               hour(pickup_datetime) AS hour,
               month(pickup_datetime) AS month,
               try_divide(total_amount - fare_amount - tip_amount, {whole}) AS other_amount
        FROM __THIS__
        """
    )


RATIO_LABEL = "try_divide(tip_amount, total_amount - tip_amount) * 100 AS tip_ratio"
BUCKET = "ceil(try_divide(10 * tip_amount, total_amount - tip_amount))"
BUCKET_LABEL = (
    f"CAST(CASE WHEN {BUCKET} <= 2 THEN {BUCKET} WHEN {BUCKET} > 2 THEN 3 END AS INT)"
    " AS tip_range_index"
)


REGRESSION_RULES = {"max_ratio": 0.5, "inclusive": False, "min_fare": 2.5}
CLASS_RULES = {"max_ratio": 0.4, "inclusive": True, "min_fare": None}


def tip_regression_rides(trips: DataFrame) -> DataFrame:
    return tip_filter(trips, **REGRESSION_RULES)


def tip_class_rides(trips: DataFrame) -> DataFrame:
    return tip_filter(trips, **CLASS_RULES)


def tip_features(
    rides: DataFrame, label: str, features: Sequence[str], other_of_total: bool = False
) -> DataFrame:
    """The label and the inputs of a tip model as plain columns."""
    name = label.rsplit(" ", 1)[-1]
    return tip_feature_stage(label, other_of_total).transform(rides).select(name, *features)


def tip_stages(
    rules: dict, label: str, features: Sequence[str], other_of_total: bool = False
) -> list[Transformer]:
    """Row filter, features and vector: all that a raw trip needs before the trees."""
    return [
        tip_filter_stage(**rules),
        tip_feature_stage(label, other_of_total),
        _assembler(features, True),
    ]


def tip_vectors(trips: DataFrame, stages: Sequence[Transformer], label: str, seed: int) -> DataFrame:
    """Vectors of the trips that a tip model takes, each trip prepared once."""
    for stage in stages:
        trips = stage.transform(trips)
    return _vectors(trips, label, seed)


def fit_tip_regressor(trips: DataFrame, trees: int = 20, depth: int = 5, seed: int = 17) -> Fitted:
    """Boosted trees for the tip percentage."""
    ensure_checkpoint_dir(trips.sparkSession)
    rides = tip_regression_rides(trips.select(*TIP_INPUT_COLUMNS))
    booster = GBTRegressor(
        featuresCol="features", labelCol="tip_ratio", maxIter=trees, maxDepth=depth, seed=seed
    )
    stages = tip_stages(REGRESSION_RULES, RATIO_LABEL, TIP_REGRESSION_FEATURES)
    with _kept_parts(tip_vectors(rides, stages, "tip_ratio", seed)) as (train, validation):
        fitted = booster.fit(train)
        rows = [
            tuple(row)
            for part, frame in (("train", train), ("validation", validation))
            for row in regression_scores(fitted.transform(frame), "tip_ratio", part).collect()
        ]
    model = PipelineModel(stages=[*stages, fitted])
    return Fitted(
        model, _score_rows(trips, rows), feature_importances(model, TIP_REGRESSION_FEATURES, trips)
    )


def fit_tip_classifier(
    trips: DataFrame, trees: int = 20, depth: int = 5, other_of_total: bool = False, seed: int = 17
) -> Fitted:
    """A random forest for the tip bucket in ten-percent steps, scored by f1."""
    ensure_checkpoint_dir(trips.sparkSession)
    rides = tip_class_rides(trips.select(*TIP_INPUT_COLUMNS))
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="tip_range_index",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    )
    f1 = MulticlassClassificationEvaluator(labelCol="tip_range_index", metricName="f1")
    stages = tip_stages(CLASS_RULES, BUCKET_LABEL, TIP_CLASS_FEATURES, other_of_total)
    with _kept_parts(tip_vectors(rides, stages, "tip_range_index", seed)) as (train, validation):
        fitted = forest.fit(train)
        rows = [
            ("score", f"{part}_f1", float(f1.evaluate(fitted.transform(frame))))
            for part, frame in (("train", train), ("validation", validation))
        ]
    model = PipelineModel(stages=[*stages, fitted])
    return Fitted(
        model, _score_rows(trips, rows), feature_importances(model, TIP_CLASS_FEATURES, trips)
    )


def model_sql(model: PipelineModel, features: Sequence[str], source: str = "rides") -> str:
    """A query that scores prepared rows (plain feature columns) without Spark's vectors.

    Features of a tip model are those of ``tip_features``; rows with a null feature have no score.
    """
    trees = model.stages[-1]
    forest = isinstance(trees, RandomForestClassificationModel)
    select = tree_sql.classification_select if forest else tree_sql.regression_select
    return select(trees, features, source)


def score_by_sql(rides: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Add ``prediction`` by the emitted SQL."""
    return rides.sparkSession.sql(model_sql(model, features, "{rides}"), rides=rides)


def sql_agreement(
    rides: DataFrame, model: PipelineModel, features: Sequence[str], label: str, seed: int = 17
) -> DataFrame:
    """Does the emitted SQL say what the model says? Per part, over all prepared rides.

    ``disagreeing`` counts the trips whose predictions differ by more than rounding; the scores that
    Spark's evaluators find are compared with those that SQL aggregates find from the emitted SQL.
    """
    known = rides.dropna(subset=list(features))
    trees = model.stages[-1]
    both = _assembler(features).transform(known)
    both = score_by_sql(trees.transform(both).withColumnRenamed("prediction", "by_model"), model, features)
    apart = F.abs(F.col("prediction") - F.col("by_model")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("by_model"))
    if isinstance(trees, RandomForestClassificationModel):
        evaluate, ours = _f1_of_model, f1_score
    else:
        evaluate, ours = _regression_of_model, _regression_values
    parts = []
    compared = _vectors(both, label, seed, "prediction", "by_model", apart.alias("apart")).drop("features")
    with _kept_parts(compared) as kept:
        for name, part in zip(("train", "validation"), kept):
            counted = part.agg(F.count(F.lit(1)).alias("trips"), F.count_if("apart").alias("off")).first()
            by_model = evaluate(part, label)
            by_sql = ours(part, label)
            same = all(abs(by_model[n] - by_sql[n]) <= 1e-9 * max(1.0, abs(by_model[n])) for n in by_model)
            parts.append((name, counted.trips, counted.off, same))
    return rides.sparkSession.createDataFrame(
        parts, "part string, trips bigint, disagreeing bigint, scores_agree boolean"
    )


def _regression_of_model(part: DataFrame, label: str) -> dict[str, float]:
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="by_model")
    return {name: evaluator.evaluate(part, {evaluator.metricName: name}) for name in ("r2", "rmse")}


def _regression_values(part: DataFrame, label: str) -> dict[str, float]:
    rows = regression_scores(part, label, "sql").collect()
    return {row.name.removeprefix("sql_"): row.value for row in rows}


def _f1_of_model(part: DataFrame, label: str) -> dict[str, float]:
    evaluator = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="by_model", metricName="f1"
    )
    return {"f1": evaluator.evaluate(part)}


def f1_score(predicted: DataFrame, label: str) -> dict[str, float]:
    """F1 of each class weighted by its rows, from one table of (class, prediction) counts."""
    cells = predicted.groupBy(F.col(label).cast("double").alias("truth"), "prediction").count()
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.lit(True).alias("actual")),
        F.struct(F.col("prediction").alias("class"), F.lit(False).alias("actual")),
    )
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("count")).otherwise(0)
    classes = (
        cells.select("count", hit.alias("hit"), F.inline(sides))
        .groupBy("class")
        .agg(
            F.sum(F.when(F.col("actual"), F.col("hit")).otherwise(0)).alias("right"),
            F.sum(F.when(F.col("actual"), F.col("count")).otherwise(0)).alias("rows"),
            F.sum("count").alias("both"),
        )
    )
    f1 = F.sum(F.col("rows") * 2 * F.col("right") / F.col("both")) / F.sum("rows")
    return {"f1": classes.agg(f1.alias("f1")).first().f1}
