"""Tree ensembles as SQL: Spark and DuckDB score rows as the fitted model does."""

import random

import duckdb
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tripweave.functions import tree_sql
from tripweave.plans import models

NAMES = ("x", "y", "z")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Numbers of many sizes, so that thresholds have many digits and exponents."""
    dice = random.Random(4)
    made = [(n, dice.gauss(0, 1), dice.gauss(0, 1) * 1e-7, dice.gauss(0, 1) * 1e12) for n in range(3000)]
    frame = spark.createDataFrame(made, "n long, x double, y double, z double").withColumn(
        "label", F.floor(F.least(F.greatest(F.col("x") * 2 + F.col("y") * 1e7 + 2, F.lit(0.0)), F.lit(4.0)))
    )
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    frame.coalesce(1).write.parquet(path)
    return path


def scored(spark, path, estimator):
    frame = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(spark.read.parquet(path))
    model = estimator.fit(frame)
    return model, {r.n: r.prediction for r in model.transform(frame).collect()}


def in_duckdb(path, sql):
    return dict(duckdb.sql(f"SELECT n, prediction FROM ({sql})").fetchall())


def test_boosted_trees_in_both_engines(spark, rows):
    model, want = scored(spark, rows, GBTRegressor(labelCol="label", maxIter=8, maxDepth=6, stepSize=0.3, seed=1))
    got = in_duckdb(rows, tree_sql.regression_select(model, NAMES, f"'{rows}/*.parquet'"))
    assert set(got) == set(want) and len(set(want.values())) > 50
    assert all(got[n] == pytest.approx(want[n], rel=1e-12, abs=1e-12) for n in want)
    text = tree_sql.regression_select(model, NAMES, "{rows}")
    again = {r.n: r.prediction for r in spark.sql(text, rows=spark.read.parquet(rows)).collect()}
    assert all(again[n] == got[n] for n in want)


def test_forest_votes_in_both_engines(spark, rows):
    estimator = RandomForestClassifier(labelCol="label", numTrees=7, maxDepth=5, seed=1)
    model, want = scored(spark, rows, estimator)
    got = in_duckdb(rows, tree_sql.classification_select(model, NAMES, f"'{rows}/*.parquet'"))
    assert got == want and len(set(want.values())) > 3
    text = tree_sql.classification_select(model, NAMES, "{rows}")
    assert {r.n: r.prediction for r in spark.sql(text, rows=spark.read.parquet(rows)).collect()} == want


def test_a_model_without_splits_is_a_number(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 3.0, 7)] * 5, "x double, y double, z double, label int")
    frame = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(frame)
    model = GBTRegressor(labelCol="label", maxIter=2, seed=1).fit(frame)
    assert duckdb.sql(f"SELECT {tree_sql.regression_sql(model, NAMES)}").fetchall()[0][0] == 7.0


def test_literals_and_other_splits(spark):
    assert [tree_sql.number(v) for v in (1, -0.25, 1e-9, 1e22)] == ["1.0E0", "-0.25E0", "1e-09", "1e+22"]
    with pytest.raises(ValueError):
        tree_sql.number(float("inf"))
    with pytest.raises(ValueError):
        tree_sql._read_tree(iter(["If (feature 0 in {1.0,2.0})"]))
    one = tree_sql.Split(0, 1.5, tree_sql.Leaf((2.0,)), tree_sql.Leaf((2.0,)))
    assert tree_sql.tree_sql(one, NAMES, lambda leaf: leaf.values[0]) == "2.0E0"
    assert tree_sql.most_votes_sql(["a"]) == "0.0E0"


def test_ties_go_to_the_first_class():
    sql = tree_sql.most_votes_sql(["a", "b", "c"])
    for votes, winner in (((1, 1, 1), 0), ((0, 2, 2), 1), ((0, 1, 2), 2), ((2, 1, 2), 0)):
        assert duckdb.sql("SELECT {} FROM (SELECT {} AS a, {} AS b, {} AS c)".format(sql, *votes)).fetchall()[0][0] == winner


def test_f1_is_the_evaluators(spark):
    dice = random.Random(2)
    pairs = [(dice.choice((0, 0, 1, 3)), float(dice.choice((0, 1, 2)))) for _ in range(500)]
    frame = spark.createDataFrame(pairs, "label int, prediction double")
    want = models._f1_of_model(frame.withColumnRenamed("prediction", "by_model"), "label")
    assert models.f1_score(frame, "label")["f1"] == pytest.approx(want["f1"], rel=1e-12)


def test_disagreement_is_seen(spark, rows, monkeypatch):
    """The agreement report is not true by construction: a wrong threshold shows."""
    key = {"pickup_datetime": F.col("n"), "PULocationID": F.col("n"), "DOLocationID": F.col("n")}
    frame = spark.read.parquet(rows).withColumns(key).withColumn("speed", F.col("label").cast("double"))
    model = models.PipelineModel(
        stages=[models._assembler(NAMES), models.speed_booster(depth=4, trees=3).fit(models._assembler(NAMES).transform(frame))]
    )
    good = models.sql_agreement(frame, model, NAMES, "speed").collect()
    assert [(r.part, r.disagreeing, r.scores_agree) for r in good] == [("train", 0, True), ("validation", 0, True)]
    assert sum(r.trips for r in good) == 3000
    right = tree_sql.number
    monkeypatch.setattr(tree_sql, "number", lambda v: right(v * 1.5))
    bad = models.sql_agreement(frame, model, NAMES, "speed").collect()
    assert all(r.disagreeing > 0 and not r.scores_agree for r in bad)
