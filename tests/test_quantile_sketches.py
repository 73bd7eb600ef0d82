"""Stored quantile sketches: merged windows, rank errors, small and empty groups."""

import pytest
from pyspark.sql import functions as F

from tripweave.operators import quantile_sketches as sketches

WANTED = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group with most rows, skewed values, a tiny group, and one of nulls."""
    every = spark.range(60_000, numPartitions=9)
    kind = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") < 50, "tiny").otherwise("cold")
    value = F.pow((F.col("id") * 7919 % 60_000) / 1000.0, 3)
    made = every.select(kind.alias("zone"), (F.col("id") % 12).alias("month"), value.alias("speed"))
    return made.unionByName(spark.createDataFrame([("void", 1, None)] * 3, made.schema))


def test_merged_months_have_nearly_the_true_ranks(rows, spark, tmp_path):
    sketches.sketch_groups(rows, ["zone", "month"], "speed").write.parquet(str(tmp_path / "monthly"))
    monthly = spark.read.parquet(str(tmp_path / "monthly"))
    for window in (F.lit(True), F.col("month").between(3, 5), F.col("month") == 7):
        merged = sketches.merge_sketches(monthly.where(window), ["zone"])
        answers = sketches.quantiles_of(merged, ["zone"], WANTED)
        errors = sketches.rank_errors(rows.where(window), ["zone"], "speed", answers, WANTED).collect()
        assert {r.zone for r in errors} >= {"hot", "cold"}
        for row in errors:
            assert all(row[name] <= 0.02 for name in WANTED)
            # Small groups, and the ends of all, are exact.
            assert row.low == row.high == 0 and (row.n > sketches.SKETCH_K or row.median == 0)


def test_groups_of_nulls_and_empty_tables(rows):
    found = sketches.quantiles_of(sketches.sketch_groups(rows, ["zone"], "speed"), ["zone"], WANTED)
    void = found.where("zone = 'void'").first()
    assert void.n == 0 and all(void[name] is None for name in WANTED)
    merged = sketches.merge_sketches(sketches.sketch_groups(rows, ["zone", "month"], "speed"), ["zone"])
    assert sketches.quantiles_of(merged, ["zone"], WANTED).where("zone = 'void' AND median IS NULL").count() == 1
    assert sketches.sketch_groups(rows.limit(0), ["zone"], "speed").count() == 0
    with pytest.raises(ValueError):
        sketches.quantiles_of(merged, ["zone"], {"x": 1.5})


def test_answers_come_without_the_rows(rows, spark, tmp_path):
    sketches.sketch_groups(rows, ["zone", "month"], "speed").write.parquet(str(tmp_path / "monthly"))
    stored = spark.read.parquet(str(tmp_path / "monthly"))
    sizes = stored.agg(F.max(F.length("sketch")).alias("bytes"), F.count("*").alias("groups")).first()
    # A sketch stays small however many rows its group has.
    assert sizes.bytes < 16_000 and sizes.groups <= 37
