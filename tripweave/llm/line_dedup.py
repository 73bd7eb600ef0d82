"""Removal of repeated passages of three lines or more.

Each document's lines are hashed, every three consecutive lines form a window, windows that occur more
than once anywhere are found by one aggregation, and the lines of all but the first occurrence are
removed, windows that overlap being merged into covered positions. Only DataFrame functions are used.

Defined cases. Lines are split at line feeds and compared without blanks, tabs and carriage returns
around them; blank lines never count as one of three, but go with a passage that surrounds them. The
first occurrence is the one with the smallest document id (null first), then the smallest text hash,
then the smallest position. A repeat that overlaps its own first occurrence loses only the lines after
that occurrence. Texts with fewer than three lines, empty and null texts stay as they are. Rows equal
in id and text are the same document and get the same result. A text whose lines are all removed
becomes empty. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_BLANKS = " \t\r"


def _digest(text) -> F.Column:
    return F.unhex(F.md5(text))


def windows(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per window: document id, text hash, first and last line position, window hash."""
    hashed = df.select(
        F.col(doc).alias("__doc"),
        _digest(F.col(text)).alias("__text"),
        F.filter(
            F.transform(
                F.split(F.col(text), "\n", -1),
                lambda line, at: F.struct(
                    at.alias("at"),
                    (F.length(F.btrim(line, F.lit(_BLANKS))) > 0).alias("full"),
                    _digest(F.btrim(line, F.lit(_BLANKS))).alias("hash"),
                ),
            ),
            lambda line: line.full,
        ).alias("__lines"),
    )
    # No filter here: it would be pushed below and hash every line twice.
    count = F.greatest(F.size("__lines") - (WINDOW - 1), F.lit(0))
    shifted = [
        F.slice("__lines", 1 + step, count).alias(f"l{step}")
        for step in range(WINDOW)
    ]
    return hashed.select(
        "__doc", "__text", F.inline(F.arrays_zip(*shifted))
    ).select(
        "__doc",
        "__text",
        F.col("l0.at").alias("__start"),
        F.col(f"l{WINDOW - 1}.at").alias("__end"),
        _digest(F.concat(*[F.col(f"l{step}.hash") for step in range(WINDOW)])).alias("__window"),
    )


def repeated_ranges(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Line ranges to remove: (__doc, __text, __from, __to), one row per later occurrence."""
    found = windows(df, doc, text)
    place = F.struct("__doc", "__text", "__start", "__end")
    firsts = (
        found.groupBy("__window")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("__window", "first")
    )
    later = found.join(firsts, "__window").where(place != F.col("first"))
    same = (F.col("__text") == F.col("first.__text")) & F.col("__doc").eqNullSafe(
        F.col("first.__doc")
    )
    begin = F.when(same, F.greatest(F.col("__start"), F.col("first.__end") + 1)).otherwise(
        F.col("__start")
    )
    return (
        later.select("__doc", "__text", begin.alias("__from"), F.col("__end").alias("__to"))
        .where(F.col("__from") <= F.col("__to"))
    )


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the later copies of repeated passages cut out of ``text``.

    Adds ``n_lines`` (lines before) and ``n_removed`` (lines cut out), both null for a null text;
    columns of those names are replaced.
    """
    covered = (
        repeated_ranges(df, doc, text)
        .groupBy("__doc", "__text")
        .agg(F.collect_set(F.struct("__from", "__to")).alias("__ranges"))
        .select(
            F.col("__doc").alias("__in"),
            F.col("__text").alias("__of"),
            F.array_distinct(
                F.flatten(F.transform("__ranges", lambda r: F.sequence(r["__from"], r["__to"])))
            ).alias("__covered"),
        )
    )
    # All columns but the text in one, so that none of the table's clashes with those added here.
    packed = df.select(
        F.struct(*[F.col(f"`{name}`") for name in df.columns if name != text]).alias("__row"),
        F.col(doc).alias("__id"),
        F.col(text).alias("__whole"),
        _digest(F.col(text)).alias("__text"),
    )
    joined = packed.join(
        covered,
        F.col("__id").eqNullSafe(F.col("__in")) & (F.col("__text") == F.col("__of")),
        "left",
    )
    whole = F.col("__whole")
    # Kept positions come from a hashed set difference, so a long text costs its length only.
    split = joined.withColumn("__lines", F.split(whole, "\n", -1)).withColumn(
        "__kept",
        F.when(
            F.col("__covered").isNotNull(),
            F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__covered"),
        ),
    )
    kept = F.transform("__kept", lambda at: F.get(F.col("__lines"), at))
    cut = F.when(F.col("__kept").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    removed = F.size("__lines") - F.coalesce(F.size("__kept"), F.size("__lines"))
    return split.select(
        *[
            (cut if name == text else F.col("__row")[name]).alias(name)
            for name in df.columns
            if name not in ("n_lines", "n_removed")
        ],
        F.when(whole.isNotNull(), F.size("__lines").cast("long")).alias("n_lines"),
        F.when(whole.isNotNull(), removed.cast("long")).alias("n_removed"),
    )
