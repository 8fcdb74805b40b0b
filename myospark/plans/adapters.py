"""Tables as recordings: wide, long and array layouts to the canonical long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, group: list[str], order: list[Column | str], bucket: Column, name: str = "sample_index") -> DataFrame:
    """Number the rows of each group from 0 in the given order, without bringing a group into one task.

    ``bucket`` must rise with the order (the hour of a timestamp, a quotient of a key): rows are numbered within group and
    bucket, and each bucket starts at the number of rows in the buckets before it. Only the counts per bucket meet in
    one window.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(starts, [*group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_rank")).drop("_bucket", "_rank", "_start")


def from_wide(df: DataFrame, channels: list[str], recording: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per (input row, channel). Only the channels asked for are read: they are chosen before the unpivot.

    ``keep`` lists further columns to carry, such as a sample_index made by ``with_ordinal``.
    """
    keep = keep or []
    rec = F.lit("recording") if recording is None else recording
    slim = df.select(rec.alias("recording_id"), *keep, *[F.col(c).cast("double").alias(c) for c in channels])
    order = F.create_map(*[x for i, c in enumerate(channels) for x in (F.lit(c), F.lit(i))])
    long = slim.unpivot(["recording_id", *keep], channels, "channel", "value")
    return long.select("recording_id", F.element_at(order, F.col("channel")).alias("channel_idx"), "channel", *keep, F.coalesce("value", F.lit(float("nan"))).alias("value"))


def from_long(df: DataFrame, channel: str, value: str, recording: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows that already hold one sample of one channel; null values become NaN."""
    rec = F.lit("recording") if recording is None else recording
    return df.select(rec.alias("recording_id"), F.col(channel).cast("string").alias("channel"), *(keep or []), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))


def from_arrays(df: DataFrame, channel: str, samples: str, channel_type: str | None = None) -> DataFrame:
    """One row per array element; the position is the sample index."""
    kind = [F.col(channel_type).cast("string").alias("channel_type")] if channel_type else []
    return df.select(F.lit("recording").alias("recording_id"), F.col(channel).cast("string").alias("channel"), *kind, F.posexplode(samples).alias("_pos", "_value")).select(
        "recording_id", "channel", *(["channel_type"] if channel_type else []), F.col("_pos").cast("bigint").alias("sample_index"), F.col("_value").cast("double").alias("value")
    )
