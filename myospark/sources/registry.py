"""Importers by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .base import RecordingSource
from .edf import EdfSource
from .otb import OtbSource
from .trigno import TrignoSource

IMPORTERS: dict[str, type[RecordingSource]] = {"trigno": TrignoSource, "otb": OtbSource, "edf": EdfSource}


def importer(name: str) -> type[RecordingSource]:
    if name not in IMPORTERS:
        raise ValueError(f"Unsupported importer: {name}. Available importers: {', '.join(IMPORTERS)}")
    return IMPORTERS[name]


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in IMPORTERS.values():
        spark.dataSource.register(source)
