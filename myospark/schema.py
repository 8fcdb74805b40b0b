"""Canonical tables: samples in long form, one row per channel, and recording metadata."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import types as T

SIGNALS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("channel_idx", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sample_index", T.LongType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)

CHANNELS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("channel_idx", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("channel_type", T.StringType()),
        T.StructField("sample_frequency", T.DoubleType()),
        T.StructField("physical_dimension", T.StringType()),
        T.StructField("prefilter", T.StringType()),
        T.StructField("physical_min", T.DoubleType()),
        T.StructField("physical_max", T.DoubleType()),
        T.StructField("digital_min", T.IntegerType()),
        T.StructField("digital_max", T.IntegerType()),
        T.StructField("transducer", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("muscle", T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)


def written(value: object) -> tuple[str | None, str]:
    """A metadata value as text, and the kind that ``read_back`` needs: text stays as it is, all else is JSON or an ISO date."""
    if value is None or isinstance(value, str):
        return value, "text"
    if isinstance(value, (datetime, date)):
        return value.isoformat(), type(value).__name__
    return json.dumps(value), "json"


def read_back(value: str | None, kind: str | None) -> object:
    if value is None or kind in (None, "text"):
        return value
    if kind == "json":
        return json.loads(value)
    return (datetime if kind == "datetime" else date).fromisoformat(value)
