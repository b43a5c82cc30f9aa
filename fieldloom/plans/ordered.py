"""Neighbouring rows in an order, without sorting a whole key in one task.

A window partitioned by a key alone puts all rows of a hot key into one task. Here a key is cut
into chunks of its order axis; each chunk gets one extra row that stands for the nearest row of
the next (or previous) non-empty chunk. The extra rows come from a per-chunk aggregate, whose
partial step runs before its shuffle, and from a window over chunk summaries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.plans.scale import broadcast_if_small, checkpointed


def with_next(df: DataFrame, source: DataFrame, keys: list[str], chunk: str, order: str, out: str) -> DataFrame:
    """Add ``out``, the next value of ``order`` within ``keys``; null for the last row of a key.

    ``df`` has one row per (keys, order); ``source`` yields at least the same (keys, chunk, order)
    values and may be cheaper to scan again than ``df``. ``chunk`` must not decrease along ``order``.
    """
    per_chunk = source.groupBy(*keys, chunk).agg(F.min(order).alias("__first"))
    along = Window.partitionBy(*keys).orderBy(chunk)
    ends = (
        per_chunk.withColumn("__next", F.lead("__first").over(along))
        .where(F.col("__next").isNotNull())
        .select(*keys, chunk, F.col("__next").alias(order), F.lit(True).alias("__end"))
    )
    rows = df.withColumn("__end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    within = Window.partitionBy(*keys, chunk).orderBy(order, "__end")
    return (
        rows.withColumn(out, F.lead(order).over(within))
        .where(~F.col("__end"))
        .drop("__end")
    )


def with_previous(df: DataFrame, keys: list[str], chunk: str, order: str, payload: list[str], out: str) -> DataFrame:
    """Add ``out``, a struct of the previous row's ``payload`` within ``keys``; null for the first row.

    ``df`` has one row per (keys, order). ``chunk`` must not decrease along ``order``.
    """
    carried = F.struct(F.col(order), *[F.col(c) for c in payload])
    per_chunk = df.groupBy(*keys, chunk).agg(F.max_by(carried, F.col(order)).alias("__last"))
    along = Window.partitionBy(*keys).orderBy(chunk)
    starts = (
        per_chunk.withColumn("__before", F.lag("__last").over(along))
        .where(F.col("__before").isNotNull())
        .select(*keys, chunk, *[F.col(f"__before.{c}").alias(c) for c in [order, *payload]], F.lit(True).alias("__start"))
    )
    rows = df.withColumn("__start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    within = Window.partitionBy(*keys, chunk).orderBy(order, F.col("__start").desc())
    return (
        rows.withColumn(out, F.lag(carried).over(within))
        .where(~F.col("__start"))
        .drop("__start")
    )


def with_running_total(df: DataFrame, keys: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``size`` over the rows before each one of its key, which may be spread over many tasks.

    ``keys`` and ``order`` together are unique. Rows are range-partitioned; each partition's sums are
    moved by those of the partitions before it.
    """
    rows = checkpointed(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)).withColumn("__part", F.spark_partition_id())
    parts = rows.groupBy(*keys, "__part").agg(F.sum(size).alias("__size"))
    moved = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    moves = parts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(moved, F.lit(0)).alias("__moved"))
    within = F.sum(size).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__within", F.coalesce(within, F.lit(0)))
    same = (F.col("__part") == F.col("__of"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(broadcast_if_small(moves), same).withColumn(out, F.col("__within") + F.col("__moved")).select(*df.columns, out)


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by keys, one at a time, in a task that streams them.

    Beside ``applyInPandas`` this lets a group return its rows bit by bit and costs less for each of many small groups.
    """
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        columns = [b[k].to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1), len(b)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            here = tuple(c[a] for c in columns)
            if held and here != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[a:z])
            last = here
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
