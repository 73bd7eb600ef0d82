"""Exact quantiles against sorting, with skew, ties, nulls and both join strategies."""

import math
import random

import pytest

from tripweave.operators.quantiles import grouped_median, grouped_quantiles

PROBABILITIES = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.999, "q10": 1.0}


def brute(rows):
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)
    result = {}
    for key, values in groups.items():
        known = sorted(v for v in values if v is not None)
        picks = {
            name: known[max(math.ceil(p * len(known)), 1) - 1] if known else None
            for name, p in PROBABILITIES.items()
        }
        result[key] = (len(values), len(known), min(known, default=None), max(known, default=None), picks)
    return result


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [("hot", rng.choice([0.2, 0.25, rng.random() * 1e-3])) for _ in range(4000)]
    made += [("wide", rng.uniform(-1e6, 1e6)) for _ in range(1500)]
    made += [("tiny", rng.uniform(-1e-9, 1e-9)) for _ in range(300)]
    made += [(f"k{i % 40}", rng.gauss(10, 4)) for i in range(2500)]
    made += [(None, rng.random()) for _ in range(50)]
    made += [("hot", None)] * 30 + [("empty", None)] * 3 + [("one", 7.5), ("zero", 0.0), ("zero", -0.0)]
    return made


@pytest.mark.parametrize(("limit", "bin_rows"), [(2**26, 1_000_000), (0, 1_000_000), (2**26, 20), (0, 0)])
def test_equals_sorting(spark, rows, limit, bin_rows):
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    stats = {"n": ("count", None), "known": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"),
             "mean": ("avg", "v")}
    found = grouped_quantiles(df, ["k"], "v", PROBABILITIES, stats, bin_rows=bin_rows,
                              broadcast_bytes=limit)
    got = {r.k: r for r in found.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for key, (n, known, lo, hi, picks) in want.items():
        row = got[key]
        assert (row.n, row.known, row.lo, row.hi) == (n, known, lo, hi), key
        assert {name: row[name] for name in picks} == picks, key


def test_several_keys(spark):
    data = [(i % 3, i % 2, float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "a int, b int, v double")
    got = {(r.a, r.b): r.m for r in grouped_quantiles(df, ["a", "b"], "v", {"m": 0.5}).collect()}
    for a in range(3):
        for b in range(2):
            values = sorted(v for x, y, v in data if (x, y) == (a, b))
            assert got[a, b] == values[math.ceil(len(values) / 2) - 1]


def test_one_pass_form_has_the_same_columns(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    stats = {"n": ("count", None), "mean": ("avg", "v")}
    exact = grouped_quantiles(df, ["k"], "v", {"m": 0.5}, stats)
    quick = grouped_quantiles(df, ["k"], "v", {"m": 0.5}, stats, accuracy=1_000_000)
    assert exact.columns == quick.columns
    assert {(r.k, r.m, r.n) for r in exact.collect()} == {(r.k, r.m, r.n) for r in quick.collect()}


def test_median_of_even_and_odd_groups(spark):
    groups = {"odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 2.0, 9.0], "pair": [0.125, 0.126], "one": [5.5],
              "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r.k: r.median for r in grouped_median(df, ["k"], "v").collect()}
    assert found == {"odd": 2.0, "even": 3.0, "pair": 0.13, "one": 5.5, "none": None}


def test_not_a_number_and_infinity_sort_last(spark):
    values = [float("nan"), float("inf"), 1.0, -float("inf"), 2.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    places = {f"q{i}": (lambda n, i=i: n * 0 + i) for i in range(1, 6)}
    row = grouped_quantiles(df, ["k"], "v", places).first()
    assert [row[f"q{i}"] for i in range(1, 5)] == [-float("inf"), 1.0, 2.0, float("inf")]
    assert math.isnan(row.q5)


@pytest.mark.parametrize("bin_rows", [1_000_000, 20, 0])
def test_source_is_read_at_most_twice(spark, rows, bin_rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "k string, v double").mapInArrow(count, "k string, v double")
    grouped_quantiles(df, ["k"], "v", PROBABILITIES, bin_rows=bin_rows).collect()
    assert 0 < seen.value <= 2 * len(rows)
