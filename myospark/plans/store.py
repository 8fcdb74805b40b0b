"""Recordings kept in Parquet, laid out by channel and time.

Three tables in a folder: samples, channels and metadata. Samples are ranged over files by recording, channel and sample
index and sorted so within a file, so statistics of row groups leave few of them for a channel and a range. A time that
is the sample index over the recording's or the channel's rate is not stored: the rate is, as one value that repeats
along a channel, and bounds on time are rewritten to bounds on the sample index for each rate. Other times (of
discontinuous recordings) are stored as they are, and bounded as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from math import ceil, floor, inf
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.analysis import KEYS, known_rows

#: Bytes of a row group, and up to so many different rates bounds on time have a range for each; beyond, one that holds all of these.
ROW_GROUP_BYTES, MOST_RATES = 16 << 20, 16
_FAR = 1 << 62


def candidate_rates(channels: DataFrame) -> DataFrame:
    """Rates that times of a channel may follow: its own, and that of the recording's first channel."""
    first = Window.partitionBy("recording_id").orderBy("channel_idx", "channel")
    rates = channels.withColumn("_first", F.first("sample_frequency").over(first))
    return rates.groupBy(*KEYS).agg(F.max("sample_frequency").alias("_own"), F.max("_first").alias("_first"))


def laid_out(signals: DataFrame, channels: DataFrame, files: int | None = None) -> DataFrame:
    """The samples as they are stored, row by row: ``rate`` where t is the sample index over it, else ``t``.

    Ranges are by recording, channel and sample index, so a long channel is cut over as many files as it needs.
    """

    def follows(rate: str) -> Column:
        return (F.col(rate) > 0) & F.col("t").eqNullSafe(F.when(F.col(rate) > 0, F.col("sample_index") / F.col(rate)))

    rated = signals.join(known_rows(candidate_rates(channels)), KEYS, "left")
    rated = rated.withColumn("rate", F.when(follows("_first"), F.col("_first")).when(follows("_own"), F.col("_own")))
    rows = rated.select("recording_id", "channel_idx", "channel", "sample_index", "rate", F.when(F.col("rate").isNull(), F.col("t")).alias("t"), "value")
    order = ["recording_id", "channel", "sample_index"]
    return rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)


def save(signals: DataFrame, channels: DataFrame, metadata: DataFrame, folder: str, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write the three tables to a new folder, samples last: with them the store is whole."""
    channels.write.parquet(f"{folder}/channels")
    metadata.write.parquet(f"{folder}/metadata")
    laid_out(signals, channels, files).write.option("parquet.block.size", row_group_bytes).parquet(f"{folder}/signals")


def _within(column: str, low: float, high: float) -> list[Column]:
    return ([F.col(column) >= low] if low > -inf else []) + ([F.col(column) <= high] if high < inf else [])


def _index_at(time: float, rate: float, end: int) -> float:
    """A sample index that lies at or beyond a time, on the side of ``end`` (-1 or 1)."""
    if abs(time) == inf:
        return time
    return max(-_FAR, min(_FAR, floor(time * rate) - 1 if end < 0 else ceil(time * rate) + 1))


def time_bounds(rates: list[float], low: float, high: float) -> Column:
    """Rows whose time may lie within bounds, by what is stored: for each rate a range of sample indices, and times that are stored."""

    def indices(slow: float, fast: float) -> list[Column]:
        ends = [(_index_at(low, r, -1), _index_at(high, r, 1)) for r in (slow, fast)]
        return _within("sample_index", min(a for a, _ in ends), max(b for _, b in ends))

    if len(rates) > MOST_RATES:
        ranges = [[F.col("rate").isNotNull(), *indices(min(rates), max(rates))]]
    else:
        ranges = [[F.col("rate") == r, *indices(r, r)] for r in rates]
    return reduce(or_, (reduce(and_, parts) for parts in [*ranges, [F.col("rate").isNull(), *_within("t", low, high)]]))


def load(spark: SparkSession, folder: str) -> tuple[Callable[..., DataFrame], DataFrame, DataFrame]:
    """A function that loads samples by what is asked for (as ``sources.base.Asked``), the channels and the metadata."""
    stored, channels, metadata = (spark.read.parquet(f"{folder}/{name}") for name in ("signals", "channels", "metadata"))

    @cache
    def rates() -> list[float]:
        """The different rates, if they are few; else the least and the greatest."""
        rate = channels.where("sample_frequency > 0").select("sample_frequency")
        few = [r[0] for r in rate.distinct().limit(MOST_RATES + 1).collect()]
        if len(few) <= MOST_RATES:
            return sorted(few)
        return few + list(rate.agg(F.min("sample_frequency"), F.max("sample_frequency")).first())

    def read(**asked: Any) -> DataFrame:
        rows = stored
        for column, key in (("channel", "channels"), ("recording_id", "recordings")):
            if key in asked:
                rows = rows.where(F.col(column).isin(asked[key]))
        first, last = asked.get("fromsample", -inf), asked.get("tosample", inf)
        for part in _within("sample_index", _index_at(first, 1, -1), _index_at(last, 1, 1)):
            rows = rows.where(part)
        low, high = asked.get("fromtime", -inf), asked.get("totime", inf)
        if low > -inf or high < inf:
            rows = rows.where(time_bounds(rates(), low, high))
        t = F.when(F.col("rate").isNotNull(), F.col("sample_index") / F.col("rate")).otherwise(F.col("t"))
        return rows.select("recording_id", "channel_idx", "channel", "sample_index", t.alias("t"), "value")

    return read, channels, metadata
