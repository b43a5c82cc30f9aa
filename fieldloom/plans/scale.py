"""Size-checked broadcasts, lineage cuts and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the optimizer's own estimate of its size stays under this.
BROADCAST_LIMIT_BYTES = 48 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, which bounds a scan-and-filter from above."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the estimated size is under ``limit``.

    Beyond the limit the frame is returned as it is, so that Catalyst picks a shuffled join and
    adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary one on a local master, whose executors are this machine; on a cluster a RuntimeError.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    current = context._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fieldloom-checkpoint-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it: as a checkpoint, but compressed and read by column."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder, without a ``file:`` scheme so that local libraries can use it."""
    base = checkpoint_dir(spark)
    for scheme in ("file://", "file:"):
        if base.startswith(scheme):
            base = base[len(scheme):]
            break
    return os.path.join(base, *parts)


def spread(df: DataFrame) -> DataFrame:
    """At least a partition for each core before work in Python.

    A small table may come as one split, which would leave all but one core idle. A large one has
    more splits than cores and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
