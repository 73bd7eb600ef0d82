"""Histograms, shares, pivots and correlations as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histograms(df: DataFrame, values: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of several columns, from each column's smallest to its largest value.

    The last bin is closed on both sides and empty bins are included. All bounds are one scalar
    subquery and all columns are binned in one more scan; only bin counts are shuffled.
    """
    columns = {name: F.col(name).cast("double") for name in values}
    bounds = df.agg(
        F.struct(
            *[
                F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias(name)
                for name, column in columns.items()
            ]
        )
    ).scalar()
    wide = df.select(
        *[column.alias(f"_v{i}") for i, column in enumerate(columns.values())],
        bounds.alias("_b"),
    )

    def placed(i: int, name: str) -> Column:
        value, low, high = F.col(f"_v{i}"), F.col("_b")[name]["lo"], F.col("_b")[name]["hi"]
        position = F.floor(F.try_divide((value - low) * bins, high - low))
        return F.struct(
            F.lit(name).alias("feature"),
            F.when(
                value.isNotNull(),
                F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)),
            ).alias("bin"),
        )

    counted = (
        wide.select(F.inline(F.array(*[placed(i, name) for i, name in enumerate(columns)])))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    every = df.sparkSession.range(bins).select(
        F.explode(F.array(*[F.lit(name) for name in columns])).alias("feature"),
        F.col("id").alias("bin"),
        bounds.alias("_b"),
    )
    low = F.coalesce(*[F.when(F.col("feature") == n, F.col("_b")[n]["lo"]) for n in columns])
    high = F.coalesce(*[F.when(F.col("feature") == n, F.col("_b")[n]["hi"]) for n in columns])
    step = (high - low) / bins
    return every.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (low + F.col("bin") * step).alias("bin_start"),
        (low + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    return histograms(df, [value], bins).drop("feature")


def share_within(df: DataFrame, group: str, count: str = "count") -> Column:
    """Share of an already aggregated count in its group's sum."""
    return F.col(count) / F.sum(count).over(Window.partitionBy(group))


def pivot_mean(
    df: DataFrame, row: str, column: str, value: str, columns: Sequence, prefix: str = ""
) -> DataFrame:
    """Mean of ``value`` per row and column; the column values are given, so no extra job finds them."""
    pivoted = df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))
    return pivoted.withColumnsRenamed({str(name): f"{prefix}{name}" for name in columns})


def correlation_matrix(df: DataFrame, *columns: str) -> DataFrame:
    """Pearson correlation of every pair of columns, one row per column, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    order = {name: i for i, name in enumerate(columns)}

    def cell(a: str, b: str) -> Column:
        first, second = sorted((a, b), key=order.__getitem__)
        return F.col(f"`{first}|{second}`").alias(b)

    lines = [F.struct(F.lit(a).alias("feature"), *[cell(a, b) for b in columns]) for a in columns]
    return row.select(F.inline(F.array(*lines)))
