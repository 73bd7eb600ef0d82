"""Raw trip files: one table out of many files whose schemas drift."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.schema import FIRST_YEAR, LAST_YEAR, TIMESTAMP_NAMES, TRIP_SCHEMA, UNION_COLUMNS

# Fixed value: how monthly trip files are named. A month may also be a folder of part files.
FILE_NAME = r"(yellow|green)_tripdata_(\d{4})-(\d{2})\.parquet"
# The month's file or folder within a path.
MONTH_PATH = rf"^(.*/{FILE_NAME})(?:/|$)"

TAG_COLUMNS = ("color", "file_year", "file_month")

FOOTER_READERS = 16


def normalise(df: DataFrame, extra: Sequence[str] = TAG_COLUMNS) -> DataFrame:
    """One spelling of the timestamps and one type per column; absent columns stay absent.

    A column that already has its target type is passed through without a cast, so filters on it
    still reach the Parquet scan.
    """
    df = df.withColumnsRenamed(TIMESTAMP_NAMES)
    have = {field.name: field.dataType for field in df.schema.fields}
    columns = [
        F.col(field.name)
        if have[field.name] == field.dataType
        else F.col(field.name).cast(field.dataType).alias(field.name)
        for field in TRIP_SCHEMA.fields
        if field.name in have
    ]
    return df.select(*columns, *[name for name in extra if name in have])


def union_trips(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all parts; a column some part lacks is NULL for that part."""
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [normalise(part) for part in parts],
    )


def trips_union(parts: Iterable[DataFrame]) -> DataFrame:
    """The eight columns that both colors share, one row per trip."""
    return union_trips(parts).select(*UNION_COLUMNS)


def list_trip_files(
    spark: SparkSession,
    root: str,
    colors: Sequence[str] = ("yellow", "green"),
    years: Iterable[int] | None = range(FIRST_YEAR, LAST_YEAR + 1),
    months: Iterable[int] = range(1, 13),
) -> list[str]:
    """Paths of the monthly files or folders wanted; months without data are skipped.

    ``years`` None takes every year. Only names are listed (no content is read); folders are reduced
    to one name on the executors, so the driver gets one name per color and month.
    """
    names = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    wanted = F.regexp_extract("path", MONTH_PATH, 2).isin(*colors)
    if years is not None:
        wanted &= F.regexp_extract("path", MONTH_PATH, 3).isin(*[f"{year:04d}" for year in years])
    wanted &= F.regexp_extract("path", MONTH_PATH, 4).isin(*[f"{month:02d}" for month in months])
    found = names.filter(wanted).select(F.regexp_extract("path", MONTH_PATH, 1).alias("path"))
    return sorted(row.path for row in found.distinct().toLocalIterator())


def _months(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths)


def _same_schema_groups(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Group months by the schema in their footer; one footer per month is read, side by side."""

    def footer_schema(path: str) -> str:
        return _months(spark, path).schema.json()

    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        schemas = list(pool.map(footer_schema, paths))
    groups: dict[str, list[str]] = defaultdict(list)
    for path, schema in zip(paths, schemas):
        groups[schema].append(path)
    return list(groups.values())


def tag_from_path(df: DataFrame) -> DataFrame:
    """Add the color, year and month that the name of a month's file or folder states."""
    path = F.col("_metadata.file_path")
    return df.select(
        "*",
        F.regexp_extract(path, MONTH_PATH, 2).alias("color"),
        F.regexp_extract(path, MONTH_PATH, 3).cast("int").alias("file_year"),
        F.regexp_extract(path, MONTH_PATH, 4).cast("int").alias("file_month"),
    )


def read_trip_parts(spark: SparkSession, root: str, **wanted) -> list[DataFrame]:
    """The wanted months, one table per footer schema, tagged but otherwise as they are."""
    paths = list_trip_files(spark, root, **wanted)
    if not paths:
        raise FileNotFoundError(f"no trip files of the wanted months under {root}")
    return [tag_from_path(_months(spark, *group)) for group in _same_schema_groups(spark, paths)]


def read_trip_files(spark: SparkSession, root: str, **wanted) -> DataFrame:
    """All wanted months as one table with ``color``, ``file_year`` and ``file_month``.

    Months are grouped by footer schema and each group is one scan, so the plan grows with the number
    of distinct schemas, not with the number of files.
    """
    return union_trips(read_trip_parts(spark, root, **wanted))


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned trip table written by one of the cleaning jobs."""
    return spark.read.parquet(path)


def read_zone_counts(spark: SparkSession, path: str) -> DataFrame:
    """Monthly zone counts, partitioned by direction, color, year and month."""
    schema = T.StructType(
        [
            T.StructField("LocationID", T.LongType()),
            T.StructField("trip_count", T.LongType()),
            T.StructField("direction", T.StringType()),
            T.StructField("color", T.StringType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)
