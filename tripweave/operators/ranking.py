"""Ranks over aggregated tables (one row per zone, or per zone and group), and places in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.session import cut_lineage


def half_flag(
    df: DataFrame, measure: str, tie_break: str, name: str = "half", within: Sequence[str] = ()
) -> DataFrame:
    """0 for the upper half of each group's descending list, 1 for the lower half.

    The input is an aggregate with one row per zone and group, so the window is over zones, not trips.
    """
    group = Window.partitionBy(*within)
    ranked = group.orderBy(F.col(measure).desc(), F.col(tie_break))
    position = F.row_number().over(ranked) - 1
    size = F.count(F.lit(1)).over(group)
    return df.withColumn(name, (2 * position >= size).cast("int"))


def first_and_last(
    df: DataFrame, measure: str, tie_break: str, each: int = 5, within: Sequence[str] = ()
) -> DataFrame:
    """The first and the last rows of each group's descending list, each row once."""
    group = Window.partitionBy(*within)
    first = F.row_number().over(group.orderBy(F.col(measure).desc(), F.col(tie_break)))
    last = F.row_number().over(group.orderBy(F.col(measure), F.col(tie_break).desc()))
    return (
        df.withColumns({"_first": first, "_last": last})
        .where((F.col("_first") <= each) | (F.col("_last") <= each))
        .drop("_first", "_last")
    )


def add_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number all rows from 0 in a total order, without gathering them in one task.

    Rows are dealt by ranges of the order; each range is numbered on its own, from an offset that a
    table of one count per range gives. Rows that are equal in the order get places in any sequence.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range: bounded by the number of tasks.
    before = counts.select(
        "_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before")
    )
    numbered = dealt.withColumn("_own", own).join(F.broadcast(before), "_range")
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop(
        "_range", "_own", "_before"
    )
