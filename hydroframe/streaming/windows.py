"""Time aggregation over a stream of values: the batch methods within event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(values: DataFrame, key: str, value: str, width: str, late: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """key, start, end, n, lowest, highest, mean, total by event-time window; rows later than `late` are left out.

    Works on a stream and on a table alike; a stream emits a window once the
    watermark has passed it (append), so its state stays bounded.
    """
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = values.withWatermark(ts, late) if values.isStreaming else values
    v = F.col(value)
    grouped = rows.groupBy(F.col(key), w.alias("w")).agg(F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"), F.sum(v).alias("total"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "lowest", "highest", "mean", "total")


def share_above(values: DataFrame, key: str, value: str, threshold: float, width: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """key, start, share: the percentage of a window's values above a threshold."""
    rows = values.withWatermark(ts, late) if values.isStreaming else values
    share = 100.0 * F.avg((F.col(value) > threshold).cast("double"))
    return rows.groupBy(F.col(key), F.window(ts, width).alias("w")).agg(share.alias("share")).select(key, F.col("w.start").alias("start"), "share")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what a stream has into Parquet, exactly once by the sink's log, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
