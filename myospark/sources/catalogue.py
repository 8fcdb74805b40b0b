"""Channels and metadata of many files: headers are read by tasks, from names that the driver only lists."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import CHANNELS, METADATA, written
from .base import Header, RecordingReader, byte_ranges
from .files import read_bytes

NAMES = [f.name for f in CHANNELS.fields]


def channel_rows(path: str, head: Header) -> list[tuple]:
    known = {n: None for n in NAMES}
    return [tuple({**known, **{k: v for k, v in c.items() if k in known}, "recording_id": path, "channel_idx": i}[n] for n in NAMES) for i, c in enumerate(head.channels)]


def metadata_rows(path: str, head: Header) -> list[tuple]:
    return [(path, k, text, i, kind) for i, (k, v) in enumerate(head.metadata) for text, kind in [written(v)]]


def header_of(reader: type[RecordingReader], path: str, sidecar: bool = False, options: dict | None = None) -> Header:
    """A file's header. With ``sidecar`` channel types come from the channels.tsv beside it, which keeps types that the file's own fields lose."""
    head = reader.read_header(path, options)
    if sidecar:
        table = pd.read_csv(io.BytesIO(read_bytes(os.path.splitext(path)[0] + "_channels.tsv")), sep="\t", keep_default_na=False)
        kinds = {str(n)[:16]: k for n, k in zip(table["name"], table["channel_type"], strict=True)}
        for c in head.channels:
            c["channel_type"] = kinds.get(c["channel"][:16], c["channel_type"])
    return head


def catalogue(spark: SparkSession, reader: type[RecordingReader], files: list[tuple[str, int]], sidecar: bool = False, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of channels and of metadata of all files, each a job of its own that reads headers where it runs."""
    names = spark.createDataFrame([(path,) for path, _ in files], "path string")

    def job(rows_of, schema):
        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [row for path in frame["path"] for row in rows_of(path, header_of(reader, path, sidecar, options))]
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype(object)

        return names.mapInPandas(read, schema)

    return job(channel_rows, CHANNELS), job(metadata_rows, METADATA)


def counted(spark: SparkSession, reader: type[RecordingReader], files: list[tuple[str, int]], most: int, time_base: str = "shared") -> str:
    """What the reader of a text needs to split files of more than ``most`` bytes: the rows in each range of ``most`` bytes.

    Tasks count the rows, a range each. The driver gets one number a range, and with a time base for each channel also the
    number of samples of each channel, as a JSON object by path.
    """
    large = [one for path, size in files if size > most for one in byte_ranges(path, size, most)]
    if not large:
        return "{}"
    own = time_base != "shared"

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(path, begin, *reader(path, {}).count(begin, end, own)) for path, begin, end in frame.itertuples(index=False)]
            yield pd.DataFrame(found, columns=["path", "begin", "rows", "ends"])

    ranges = spark.createDataFrame(large, "path string, begin long, end long").repartition(min(len(large), 10_000))
    out: dict[str, dict] = {}
    for path, begin, rows, ends in sorted(map(tuple, ranges.mapInPandas(count, "path string, begin long, rows long, ends array<long>").collect())):
        known = out.setdefault(path, {"begin": [], "rows": [], "lengths": [0] * len(ends)})
        before = known.pop("total", 0)
        known["lengths"] = [before + n if n else was for n, was in zip(ends, known["lengths"], strict=True)]
        known["begin"].append(begin)
        known["rows"].append(rows)
        known["total"] = before + rows
    return json.dumps(out)


def unpacked(spark: SparkSession, unpack: Callable[[str, str], tuple[str, int] | None], paths: list[str], folder: str) -> str:
    """Unpack the compressed ones of the files into a folder that the cluster shares, a task each; what it gives for each, as JSON by path."""

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(path, *done) for path in frame["path"] for done in [unpack(path, folder)] if done is not None]
            yield pd.DataFrame(found, columns=["path", "stem", "size"])

    names = spark.createDataFrame([(path,) for path in paths], "path string").repartition(min(len(paths), 10_000))
    return json.dumps({r["path"]: (r["stem"], r["size"]) for r in names.mapInPandas(job, "path string, stem string, size long").collect()})
