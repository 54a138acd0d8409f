"""Metric values against their own recent past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_total
from plumbline.operators.profile import quoted

BLOCK_ROWS = 65_536


def rolling_baseline(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 30, threshold: float = 3.0,
    block_rows: int = BLOCK_ROWS, partitions: int | None = None,
) -> DataFrame:
    """Adds the mean and deviation of the ``window`` values before each one, the deltas, the z-score and ``anomaly``.

    ``order`` must be unique per key. A long series is cut into blocks by its running row number, and each block
    takes the last ``window`` rows of the block before along, so no series is windowed in one task.
    """
    size = max(block_rows, window)
    ranked = running_total(df, keys, order, F.lit(1), "__rank", partitions)
    home = F.floor((F.col("__rank") - 1) / size)
    tail = (F.col("__rank") - 1) % size >= size - window
    placed = ranked.withColumn("__home", home).withColumn(
        "__block", F.explode(F.when(tail, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home")))
    )
    past = Window.partitionBy(*[quoted(k) for k in keys], "__block").orderBy("__rank")
    before = past.rowsBetween(-window, -1)
    v = quoted(value).cast("double")
    scored = (
        placed.withColumn("baseline_mean", F.avg(v).over(before))
        .withColumn("baseline_std", F.stddev_samp(v).over(before))
        .withColumn("previous", F.lag(v).over(past))
        .where(F.col("__home") == F.col("__block"))
    )
    z = F.when(F.col("baseline_std") > 0, (v - F.col("baseline_mean")) / F.col("baseline_std"))
    return (
        scored.withColumn("delta", v - F.col("baseline_mean"))
        .withColumn("step", v - F.col("previous"))
        .withColumn("z", z)
        .withColumn("anomaly", F.coalesce(F.abs(F.col("z")) > threshold, F.lit(False)))
        .drop("__rank", "__home", "__block", "previous")
    )
