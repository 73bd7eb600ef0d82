"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tripweave.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder as a table, so that later steps read their columns only."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
