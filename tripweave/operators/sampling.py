"""Sampling and splitting that depend only on a row's content.

``DataFrame.sample`` and ``randomSplit`` depend on the order of rows within a partition, which a
shuffle does not fix: after a lost executor a recomputed partition may keep other rows than before.
A hash of the row gives every attempt the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beyond this the probability of no copy, exp(-fraction), is too small for a double.
LARGEST_FRACTION = 700.0


def row_fraction(df: DataFrame, seed: int, by: Sequence[str] | None = None) -> Column:
    """A number in [0, 1) fixed by the row, or by its columns ``by``, and the seed.

    With ``by`` it is made of the MD5 of their text, which other systems have too.
    """
    if by is not None:
        text = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in by], F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    bits = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns], F.lit(seed))
    return F.shiftrightunsigned(bits, 11) / float(1 << 53)


def sample_with_replacement(
    df: DataFrame, fraction: float, seed: int = 17, by: Sequence[str] | None = None
) -> DataFrame:
    """Each row appears k times with Poisson(``fraction``) probability."""
    if not 0 <= fraction <= LARGEST_FRACTION:
        raise ValueError(f"the fraction must lie between 0 and {LARGEST_FRACTION}")
    limits, mass, total, k = [], math.exp(-fraction), 0.0, 0
    while 1.0 - total > 1e-15 and mass > 0.0:
        total += mass
        limits.append(min(total, 1.0))
        k += 1
        mass *= fraction / k
    u = row_fraction(df, seed, by)
    copies = F.lit(0)
    for limit in limits[:-1]:
        copies = copies + (F.col("_u") >= limit).cast("int")
    drawn = df.withColumn("_u", u).withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop(
        "_u", "_copies", "_copy"
    )


def split_rows(
    df: DataFrame,
    weights: Sequence[float],
    seed: int = 17,
    by: Sequence[str] | None = None,
    fraction: str | None = None,
) -> list[DataFrame]:
    """Split into disjoint parts with the given weights; rows equal (in ``by``) stay together.

    ``fraction`` names a column that holds ``row_fraction`` already.
    """
    u = row_fraction(df, seed, by) if fraction is None else F.col(fraction)
    total, low, parts = sum(weights), 0.0, []
    for i, weight in enumerate(weights):
        high = low + weight / total
        last = i == len(weights) - 1
        parts.append(df.filter((u >= low) if last else (u >= low) & (u < high)))
        low = high
    return parts
