"""Extension: windowed channel figures over a stream of samples in the canonical long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(samples: DataFrame, time_col: str, width: str = "1 second", slide: str | None = None, lateness: str = "10 seconds") -> DataFrame:
    """Per recording, channel and event-time window: n, min, max, mean, std and range; works on streams and tables.

    Samples later than the watermark are dropped on streams. State is one row per open window and channel.
    """
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    out = samples.withWatermark(time_col, lateness).groupBy("recording_id", "channel", w).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.stddev_pop("value").alias("v_std")
    )
    return out.select("recording_id", "channel", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "v_min", "v_max", "v_mean", "v_std", (F.col("v_max") - F.col("v_min")).alias("range"))
