"""Tables by name, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register(**tables: DataFrame) -> None:
    """Make each table readable by its keyword in ``spark.sql``; a name used before is replaced."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
