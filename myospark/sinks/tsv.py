"""The channel description beside an exported recording."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channels_tsv(channels: DataFrame) -> DataFrame:
    """name, channel_type, physical_dimension, sample_frequency, reference, status in channel order; names are whole."""
    return channels.orderBy("channel_idx").select(
        F.col("channel").alias("name"), "channel_type", "physical_dimension", "sample_frequency", F.lit("n/a").alias("reference"), F.lit("good").alias("status")
    )


def tsv_text(rows: list[dict]) -> str:
    """The same as text, of one recording's channels in order."""
    out = io.StringIO()
    lines = csv.writer(out, delimiter="\t", lineterminator="\n")
    lines.writerow(["name", "channel_type", "physical_dimension", "sample_frequency", "reference", "status"])
    lines.writerows([r["channel"], r["channel_type"], r["physical_dimension"], r["sample_frequency"], "n/a", "good"] for r in rows)
    return out.getvalue()


def edf_header_fields(channels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The text fields of a channel's header: label of 16 characters, unit, whole rate, prefilter, transducer."""
    return channels.select(
        *(keys or []), "channel_idx", F.substring("channel", 1, 16).alias("label"), F.col("physical_dimension").alias("dimension"), F.col("sample_frequency").cast("int").alias("sample_frequency"),
        "prefilter", F.concat(F.col("channel_type"), F.lit(" sensor")).alias("transducer"),
    )
