"""Ordered work that must not gather a key in one task.

A key may hold a third of all rows, so nothing here sorts or walks a whole key in one place. Rows are range
partitioned by (key, order): a hot key spreads over many partitions, each of them sorted. Every partition is
reduced to one summary row, and only these summaries are combined in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

CHUNK = "__chunk"


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Range partition and sort by (keys, order), number the partitions, and write the result once.

    ``prepare`` is applied row by row to what is written, behind the sampling of the boundaries, which would run it too.

    The order columns must end in a unique one: then ties cannot pin a hot key to one partition. The written copy
    matters: boundaries come from a sample, so a second evaluation could cut elsewhere.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    chunks = spread.sortWithinPartitions(*by).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(chunks if prepare is None else prepare(chunks))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, partitions: int | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` per key along ``order``, in two levels.

    Level one sums inside (chunk, key). Level two adds the totals of the earlier chunks, one row per chunk and key.
    """
    chunked = ordered_chunks(df.withColumn("__value", value), keys, order, partitions)
    totals = chunked.groupBy(*keys, CHUNK).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(CHUNK).alias("__c"),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
    )
    same = F.col(CHUNK) == F.col("__c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("__inside", F.sum("__value").over(inside))
        .join(offsets, same, "left")
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__value", "__inside", "__offset", "__c", CHUNK, *[f"__k{i}" for i in range(len(keys))])
    )
