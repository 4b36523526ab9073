"""Global ordering helpers that never funnel all rows into one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Append a 1-based position in the given order (ties broken by the sort's
    partitioning, so give a unique last key for a repeatable result).

    A distributed range sort, then per-partition row counts (one small table) and
    position = partition offset + index inside the partition. The sorted table is
    checkpointed so both passes see the same partitions. A plain
    ``row_number().over(Window.orderBy(...))`` would run in a single task.
    """
    ordered = durable(df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__mid")))
    sizes = sorted((r["__pid"], r["count"]) for r in ordered.groupBy("__pid").count().collect())
    offsets, total = [], 0
    for pid, cnt in sizes:
        offsets.append((pid, total))
        total += cnt
    if not offsets:
        return ordered.drop("__pid", "__mid").withColumn(name, F.lit(None).cast("long"))
    off = df.sparkSession.createDataFrame(offsets, "__pid int, __off long")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ordered.join(F.broadcast(off), "__pid")
            .withColumn(name, F.col("__off") + local + 1).drop("__pid", "__mid", "__off"))
