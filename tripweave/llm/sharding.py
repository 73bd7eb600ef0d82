"""Weighted rendezvous sharding of stable record keys, with gapless slots inside each shard.

Every shard draws a number from the hash of (key, shard), scaled by its weight, and the smallest draw
wins. A new shard can only win records over, it never moves records between old shards; removing one
moves only its own records. Only DataFrame functions are used.

Defined cases: a null key hashes as the text ``null``; equal keys share a shard whatever their other
columns hold; a null text has no bytes and CRC 0; an empty table gives an empty result; columns that
the caller has already are kept, and a clash with an output name is an error of the caller's choice of
``shard_col``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 4096  # sub-ranges per shard in which slots are counted on their own
BLOCK = 4096  # slots that one row stands for until the last step

# 52 bits of an MD5 are exact in a double.
_HEX = 13
_RANGE = float(2 ** (4 * _HEX))


def hash_fraction(text: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the text's MD5."""
    bits = F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(_RANGE)


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """One (draw, shard) per shard: an exponential variate whose rate is the shard's weight."""
    if not weights or any(not weight > 0 for weight in weights):
        raise ValueError("every shard needs a positive weight")
    shards = F.array(
        *[
            F.struct(F.lit(number).alias("shard"), F.lit(float(weight)).alias("weight"))
            for number, weight in enumerate(weights)
        ]
    )
    return F.transform(
        shards,
        lambda s: F.struct(
            (
                -F.ln(hash_fraction(F.concat_ws(":", key_text(key), s.shard.cast("string"))))
                / s.weight
            ).alias("draw"),
            s.shard.alias("shard"),
        ),
    )


def assign_shards(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    shard_col: str = "shard",
    grown_col: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """Add the shard of each row, and on request the shard it would have with one shard more."""
    several = [*weights, grown_weight] if grown_col else list(weights)
    drawn = df.withColumn("__draws", draws(F.col(key), several))
    held = F.slice("__draws", 1, len(weights)) if grown_col else F.col("__draws")
    added = {shard_col: F.array_min(held).shard}
    if grown_col:
        added[grown_col] = F.array_min("__draws").shard
    return drawn.withColumns(added).drop("__draws")


def number_slots(
    df: DataFrame, shard_col: str, key: str, slot_col: str = "slot", spread: int = SPREAD
) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a hash of the key.

    Rows equal in all columns are counted before the shuffle and spread out again afterwards, so a
    repeated row costs one counter. A shard is cut into ``spread`` ranges of the hash; each range is
    numbered in a window of its own, from an offset that a table of shards x ``spread`` counts gives.
    That table is broadcast: its size is bounded by those two parameters, not by the rows.
    """
    counted = (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__order", hash_fraction(F.concat(F.lit("slot:"), key_text(F.col(key)))))
        .withColumn("__range", F.floor(F.col("__order") * spread).cast("int"))
    )
    totals = counted.groupBy(F.col(shard_col).alias("__shard"), F.col("__range").alias("__part")).agg(
        F.sum("__copies").alias("__rows")
    )
    offsets = totals.selectExpr(
        "__shard",
        "__part",
        "sum(__rows) OVER (PARTITION BY __shard ORDER BY __part) - __rows AS __offset",
    )
    ties = ", ".join(f"`{name}`" for name in df.columns)
    placed = counted.join(
        F.broadcast(offsets),
        (F.col(shard_col) == F.col("__shard")) & (F.col("__range") == F.col("__part")),
    ).withColumn(
        "__first",
        F.col("__offset")
        + F.expr(
            f"sum(__copies) OVER (PARTITION BY `{shard_col}`, __range ORDER BY __order, {ties})"
        )
        - F.col("__copies"),
    )
    blocks = placed.withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(BLOCK).cast("long")))
    )
    # A row repeated without end becomes many blocks, which are dealt out before they are unrolled.
    dealt = blocks.repartition("__order", "__from")
    last = F.least(F.col("__copies") - 1, F.col("__from") + BLOCK - 1)
    names = [F.col(f"`{name}`") for name in df.columns]
    unrolled = dealt.select(*names, "__first", F.explode(F.sequence("__from", last)).alias("__step"))
    return unrolled.select(*names, (F.col("__first") + F.col("__step")).alias(slot_col))


def record_sizes(df: DataFrame, text: str = "text", overhead: int = 16) -> tuple[Column, Column]:
    """Bytes of a record (text in UTF-8 plus a fixed overhead) and the CRC-32 of its text."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)
    return size, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
