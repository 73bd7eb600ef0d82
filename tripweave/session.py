"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Bytes a lookup may have before it is shuffled instead of broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own through spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only a local session gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripweave-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new name under the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{prefix}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later plans start from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and aggregates of the rows, from one run over them."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *[measure.alias(name) for name, measure in measures.items()]))
    return cut, seen.get


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int | None = None) -> DataFrame:
    """Compute a lookup once, measure it, and hint a broadcast only when it is small.

    Spark cannot tell the size of an aggregate or an exploded table beforehand and would shuffle
    the large side of the join first. Beyond the limit there is no hint: the join is shuffled, and
    adaptive execution splits crowded keys.
    """
    df = cut_lineage(df)
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    measured = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(df) if measured <= (BROADCAST_BYTES if limit is None else limit) else df
