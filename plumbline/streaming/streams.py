"""Masking and window counts on unbounded input; rate limits are in ``limits``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators.mask import MaskPolicy, Sensitivity, mask, masked_counts
from plumbline.operators.profile import quoted
from plumbline.streaming.limits import rate_limit_stream

__all__ = ["mask_stream", "rate_limit_stream", "run_available", "window_counts"]


def mask_stream(
    stream: DataFrame, policy: MaskPolicy | None = None, sensitivity: Sensitivity | None = None, qualifier: str = "",
    observe: str | None = None,
) -> DataFrame:
    """The masker on a stream: stateless, so memory does not grow with the input.

    ``observe`` names a set of metrics: rows and masked cells per column of every micro-batch, found in the progress
    events of the query.
    """
    if observe is not None:
        counts = masked_counts(stream, policy, sensitivity, qualifier)
        stream = stream.observe(observe, F.count(F.lit(1)).alias("rows"), *counts)
    return mask(stream, policy, sensitivity, qualifier)


def window_counts(stream: DataFrame, ts: str, size: str = "1 day", watermark: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Rows and newest time per tumbling window; a window is final once the watermark has passed it, later rows are dropped."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    counted = timed.groupBy(F.window("__ts", size).alias("w"), *[quoted(b) for b in by]).agg(
        F.count(F.lit(1)).alias("rows"), F.max("__ts").alias("newest")
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows", "newest")


def run_available(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Process everything available into files and stop; restarting with the same checkpoint continues."""
    query = (
        stream.writeStream.format(format).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
