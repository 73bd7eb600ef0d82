"""Exact discrete quantiles per group, without bringing a group together in one task.

Two passes read the source. First: count values per (group, bin), where a bin is a monotone step function of the value.
Partial aggregation leaves at most one row per group and bin of each task, however many rows a
group holds, and one group's bins spread over all reducers. The running count over the bins tells
which bin holds each wanted rank. Only rows of those bins are looked at again. If such a bin still
holds many different values, the rows of such bins are written once and divided into finer bins from
there; in the end equal values are counted together and the few different ones are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.session import BROADCAST_BYTES, cut_lineage

# name of the result column -> (aggregate, source column)
Stats = Mapping[str, tuple[str, str | None]]

# a quantile's share, or its rank as an expression over the group's number of values
Place = float | Callable[[Column], Column]

# A generous size for one (group, bin) row: keys, bin and rank.
TARGET_BYTES = 256

# Rows of one bin that may be ranked in one task; fuller bins are divided further, up to the
# resolution of a double.
BIN_ROWS = 1_000_000
# Powers of two, so that the finer bins divide the coarser ones exactly.
PER_UNIT, FINER, LEVELS = 2**10, 2**12, 4


def value_bin(value: Column, per_unit: int) -> Column:
    """A step function that never decreases; steps widen with the magnitude of the value."""
    step = F.floor(F.signum(value) * F.log1p(F.abs(value)) * float(per_unit))
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(step)


def _partial(stats: Stats) -> list[Column]:
    columns = []
    for name, (kind, source) in stats.items():
        if kind == "count":
            columns.append(F.count(F.lit(1) if source is None else F.col(source)).alias(f"_{name}_n"))
        elif kind == "avg":
            columns.append(F.sum(source).alias(f"_{name}_s"))
            columns.append(F.count(source).alias(f"_{name}_n"))
        elif kind in ("min", "max"):
            columns.append(getattr(F, kind)(source).alias(f"_{name}_m"))
        else:
            raise ValueError(f"no such aggregate: {kind}")
    return columns


def _merged(stats: Stats) -> list[Column]:
    columns = []
    for name, (kind, _) in stats.items():
        if kind == "count":
            columns.append(F.sum(f"_{name}_n").alias(name))
        elif kind == "avg":
            columns.append(F.try_divide(F.sum(f"_{name}_s"), F.sum(f"_{name}_n")).alias(name))
        else:
            columns.append(getattr(F, kind)(f"_{name}_m").alias(name))
    return columns


def _same_keys(keys: Sequence[str]) -> Column:
    """The keys of one side equal those of the other, which carry the prefix ``_of_``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _renamed_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(key).alias(f"_of_{key}") for key in keys]


def _find(place: Column, number: int) -> Column:
    """Of a group's bins, in order, the one that holds a rank, and the rank within it."""
    before = F.col("_upto") - F.col("_n")
    holds = (before < place) & (place <= F.col("_upto"))
    return F.max(
        F.when(
            holds,
            F.struct(
                F.lit(number).alias("_q"),
                F.col("_bin").alias("_in_bin"),
                (place - before).alias("_rank"),
                F.col("_n").alias("_held"),
                F.col("_lo").alias("_lo"),
                F.col("_hi").alias("_hi"),
            ),
        )
    )


def _bin_counts(value: str) -> list[Column]:
    return [F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]


def _running(*groups: str, order: str) -> Column:
    so_far = Window.partitionBy(*groups).orderBy(order)
    return F.sum("_n").over(so_far.rowsBetween(Window.unboundedPreceding, 0))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, Place],
    stats: Stats | None = None,
    accuracy: int | None = None,
    bin_rows: int = BIN_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per group: the wanted quantiles of ``value`` and the wanted aggregates.

    The quantile ``p`` of ``n`` values is the ``ceil(p * n)``-th smallest. With ``accuracy`` set,
    Spark's one-pass ``percentile_approx`` is used instead, whose rank error is ``n / accuracy``.
    """
    keys, stats = list(keys), dict(stats or {})
    if accuracy is not None:
        plain = {
            name: F.count(F.lit(1)) if source is None else getattr(F, kind)(source)
            for name, (kind, source) in stats.items()
        }
        return df.groupBy(*keys).agg(
            *[column.alias(name) for name, column in plain.items()],
            *[
                F.percentile_approx(value, p, accuracy).alias(name)
                for name, p in quantiles.items()
            ],
        )

    sources = {source for _, source in stats.values() if source}
    rows = df.select(*keys, *sorted(sources | {value}))

    # Windows here run over a group's bins, never over its rows.
    counts = (
        rows.withColumn("_bin", value_bin(F.col(value), PER_UNIT))
        .groupBy(*keys, "_bin")
        .agg(*_bin_counts(value), *_partial(stats))
    )
    profile = counts.withColumns(
        {
            "_upto": _running(*keys, order="_bin"),
            "_total": F.sum("_n").over(Window.partitionBy(*keys)),
        }
    )
    total = F.col("_total")
    ranks = [
        p(total) if callable(p) else F.greatest(F.ceil(total * F.lit(float(p))), F.lit(1))
        for p in quantiles.values()
    ]
    names = [f"_find_{i}" for i in range(len(ranks))]
    groups = cut_lineage(
        profile.groupBy(*keys).agg(
            *_merged(stats), *[_find(rank, i).alias(names[i]) for i, rank in enumerate(ranks)]
        )
    )
    found = F.filter(F.array(*names), lambda find: find.isNotNull())
    settled, targets = _settle(groups.select(*_renamed_keys(keys), F.inline(found)))
    answers = [settled]
    per_unit, source, again = PER_UNIT, rows, ()
    for _ in range(LEVELS):
        left = targets.agg(F.count(F.lit(1)).alias("open"), F.max("_held").alias("held")).first()
        if not left.open:
            break
        last = left.held <= bin_rows or per_unit >= PER_UNIT * FINER ** (LEVELS - 1)
        wanted = targets.drop("_held")
        if left.open * TARGET_BYTES <= broadcast_bytes:
            wanted = F.broadcast(wanted)
        inside = _rows_of_bins(source, keys, value, wanted, per_unit, again)
        if last:
            answers.append(_rank_values(inside, keys, value))
            break
        if not again:
            # From here on only these rows are read, no longer the source.
            inside = cut_lineage(inside)
            source, again = inside.drop("_rank"), ("_q",)
        per_unit *= FINER
        targets = cut_lineage(_divide(inside, keys, value, per_unit))
        settled, targets = _settle(targets)
        answers.append(settled)

    picks = (
        reduce(DataFrame.unionByName, answers)
        .groupBy(*[f"_of_{key}" for key in keys])
        .agg(
            *[
                F.max(F.when(F.col("_q") == i, F.col("_answer"))).alias(name)
                for i, name in enumerate(quantiles)
            ]
        )
    )
    return groups.join(picks, _same_keys(keys), "left").select(*keys, *stats, *quantiles)


def _settle(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A bin whose smallest and largest value agree needs no further look."""
    one_value = F.col("_lo") == F.col("_hi")
    keys = [name for name in targets.columns if name.startswith("_of_")]
    settled = targets.filter(one_value).select(*keys, "_q", F.col("_lo").alias("_answer"))
    return settled, targets.filter(~one_value).drop("_lo", "_hi")


def _rows_of_bins(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: DataFrame,
    per_unit: int,
    again: Sequence[str] = (),
) -> DataFrame:
    """The rows that fall into a wanted bin, once per quantile that wants it.

    ``again`` is ``_q`` for rows that were taken for a quantile before and serve only that one.
    """
    placed = rows.select(*keys, *again, value, value_bin(F.col(value), per_unit).alias("_bin"))
    same = _same_keys(keys) & (F.col("_bin") == F.col("_in_bin"))
    if again:
        placed = placed.withColumnRenamed("_q", "_for")
        same &= F.col("_for") == F.col("_q")
    return placed.join(wanted, same).select(*keys, value, "_q", "_rank")


def _divide(inside: DataFrame, keys: Sequence[str], value: str, per_unit: int) -> DataFrame:
    """Find each rank's bin among the finer bins of the bin that held it."""
    finer = (
        inside.withColumn("_bin", value_bin(F.col(value), per_unit))
        .groupBy(*keys, "_q", "_rank", "_bin")
        .agg(*_bin_counts(value))
        .withColumn("_upto", _running(*keys, "_q", order="_bin"))
    )
    before = F.col("_upto") - F.col("_n")
    return finer.filter((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
        *_renamed_keys(keys),
        "_q",
        F.col("_bin").alias("_in_bin"),
        (F.col("_rank") - before).alias("_rank"),
        F.col("_n").alias("_held"),
        "_lo",
        "_hi",
    )


def _rank_values(inside: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count equal values together and pick the one that holds the rank."""
    tied = (
        inside.groupBy(*keys, "_q", "_rank", value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", _running(*keys, "_q", order=value))
    )
    before = F.col("_upto") - F.col("_n")
    return tied.filter((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
        *_renamed_keys(keys), "_q", F.col(value).alias("_answer")
    )


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", digits: int = 2
) -> DataFrame:
    """The rounded median per group; of an even number of values, the mean of the middle two."""
    middle = grouped_quantiles(
        df,
        keys,
        value,
        {
            "_low": lambda total: F.floor((total + 1) / 2),
            "_high": lambda total: F.floor(total / 2) + 1,
        },
    )
    return middle.select(*keys, F.round((F.col("_low") + F.col("_high")) / 2, digits).alias(name))
