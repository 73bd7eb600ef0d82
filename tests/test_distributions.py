"""Histograms, samples, ranks and shares on small made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.operators import distributions as dist
from tripweave.operators import ranking
from tripweave.operators.ranking import first_and_last, half_flag
from tripweave.operators.sampling import sample_with_replacement, split_rows
from tripweave.operators.trip_ends import at_both_ends, with_direction


@pytest.mark.parametrize("bins", [1, 7, 200])
def test_histogram_like_numpy(spark, bins):
    values = np.random.default_rng(2).normal(20, 9, 3000).round(3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = dist.histogram(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins)
    assert len(got) == bins and sum(r["count"] for r in got) == len(values)
    # Values within a rounding error of an edge may fall on either side of it.
    assert np.abs(np.cumsum([r["count"] for r in got]) - np.cumsum(counts)).max() <= 2
    assert np.allclose([r.bin_start for r in got], edges[:-1])


def test_histogram_of_one_value(spark):
    got = dist.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).collect()
    assert sorted(r["count"] for r in got) == [0, 0, 0, 2]


def test_correlation_matrix(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=500)
    b = a * 0.5 + rng.normal(size=500)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    rows = {r.feature: r for r in dist.correlation_matrix(df, "a", "b").collect()}
    assert rows["a"].b == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert rows["b"].a == rows["a"].b and rows["b"].b == pytest.approx(1)


def test_sample_is_poisson_and_repeatable(spark):
    df = spark.range(40_000).withColumn("x", F.col("id") * 3)
    first = sample_with_replacement(df, 0.3, 5)
    again = sample_with_replacement(df.repartition(11), 0.3, 5)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert first.columns == df.columns
    copies = np.array([r["count"] for r in first.groupBy("id").count().collect()])
    assert copies.sum() == pytest.approx(12_000, rel=0.05)
    assert (copies >= 2).sum() == pytest.approx(40_000 * 0.0369, rel=0.12)
    other = sample_with_replacement(df, 0.3, 6)
    assert set(map(tuple, other.collect())) != set(map(tuple, first.collect()))


def test_split_is_a_partition(spark):
    df = spark.range(20_000)
    train, rest = split_rows(df, [0.75, 0.25], 3)
    assert train.count() == pytest.approx(15_000, rel=0.03)
    assert train.intersect(rest).count() == 0 and train.union(rest).count() == 20_000
    again, _ = split_rows(df.repartition(9), [0.75, 0.25], 3)
    assert again.exceptAll(train).count() == 0


def test_trip_ends(spark):
    trips = spark.createDataFrame([(1, 2), (3, 3)], "PULocationID long, DOLocationID long")
    assert sorted(r.LocationID for r in at_both_ends(trips).collect()) == [1, 2, 3, 3]
    assert sorted(r.LocationID for r in at_both_ends(trips, once=True).collect()) == [1, 2, 3]
    found = sorted((r.direction, r.LocationID) for r in with_direction(trips).collect())
    assert found == [("DO", 2), ("DO", 3), ("PU", 1), ("PU", 3)]


def test_halves_and_ends(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(5)], "id long, n long")
    flags = [r.half for r in half_flag(df, "n", "id").orderBy("id").collect()]
    assert flags == [0, 0, 0, 1, 1]
    picked = [r.id for r in first_and_last(df, "n", "id", 2).collect()]
    assert sorted(picked) == [0, 1, 3, 4]


def test_positions_follow_the_order_over_many_ranges(spark):
    frame = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("n"), (F.col("id") % 3).alias("k"))
    rows = ranking.add_positions(frame, [F.desc("k"), "n"]).collect()
    want = sorted(((r.k, r.n) for r in rows), key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.n) for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(5000))
    assert ranking.add_positions(frame.limit(0), ["n"]).count() == 0
    # A third of all rows are alike; every row still has a place of its own.
    alike = spark.range(900).select((F.col("id") % 300 * (F.col("id") % 3)).alias("n"))
    assert sorted(r.position for r in ranking.add_positions(alike, ["n"], "place").withColumnRenamed("place", "position").collect()) == list(range(900))
