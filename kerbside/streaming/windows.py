"""Extension: the station summary over a stream of observations.

The domain itself has no streams; this shows the summary as windowed aggregates with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, ts: str, by: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest value of each station and window; rows later than ``late`` are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return (
        timed.groupBy(F.window("_ts", window), by)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
        .select(F.col("window.start").alias("start"), by, "n", "mean", "largest")
    )
