"""A recording: lazy tables of samples, channels and metadata, with the calls of a recording object."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import plotframe
from .operators.analysis import KEYS, analysis_of, channel_stats, export_figures, precision_loss, quantize, scaling, suitability, summary_text, type_summary
from .plans import store
from .schema import CHANNELS, METADATA, SIGNALS, read_back, written
from .sinks.edf import export_edf, export_recordings
from .sinks.tsv import channels_tsv
from .sources.base import PACK_BYTES
from .sources.catalogue import catalogue, channel_rows, counted, header_of, metadata_rows, unpacked
from .sources.files import file_size, is_one_file, list_files, must_exist
from .sources.registry import importer, register

#: Up to so many channels of a type are named to the readers of files.
FEW_NAMES = 100


class Recording:
    """Handles are cheap: every operation is a plan over the three tables, and runs when rows are asked for."""

    def __init__(self, spark: SparkSession, signals: DataFrame | None = None, channels: DataFrame | None = None, metadata: DataFrame | None = None, read: Callable[..., DataFrame] | None = None) -> None:
        """``read`` loads the same samples anew, or fewer of them by what a load may be asked for (``sources.base.Asked``)."""
        self.spark = spark
        self._keep(signals, read)
        self.channels = channels if channels is not None else spark.createDataFrame([], CHANNELS)
        self.metadata = metadata if metadata is not None else spark.createDataFrame([], METADATA)

    @classmethod
    def from_file(cls, spark: SparkSession, filepath: str | list[str], importer_name: str = "trigno", time_base: str = "shared", sidecar: bool = False, pack_bytes: int = PACK_BYTES, unpack_folder: str | None = None) -> Recording:
        """Read a file by a named importer: trigno, otb or edf. Only the header is read now; of texts larger than
        ``pack_bytes``, tasks count the rows first, so that ranges of them can be read apart.

        A folder, a pattern or a list of files makes one handle for all of them, each a recording by its path: now they are
        only listed, and tasks read the headers. With ``sidecar`` channel types come from each file's channels.tsv.

        With ``unpack_folder``, a folder that the cluster shares, tasks unpack compressed archives there first, so that ranges
        of them can be read apart. What is there from an earlier call is used again; it stays until it is deleted.
        """
        source = importer(importer_name)
        register(spark)
        settings = {"timebase": time_base, "packbytes": pack_bytes}
        one = is_one_file(filepath)
        files = None if one else list_files(filepath, source.reader_class.extensions)
        if unpack_folder is not None and hasattr(source.reader_class, "unpack"):
            if one:
                must_exist(filepath)
            settings["unpacked"] = unpacked(spark, source.reader_class.unpack, [filepath] if one else [path for path, _ in files], unpack_folder)
        if one:
            head = header_of(source.reader_class, filepath, sidecar, settings)
            files = [(filepath, file_size(filepath))]
        if hasattr(source.reader_class, "count"):
            settings["rowcounts"] = counted(spark, source.reader_class, files, pack_bytes, time_base)

        def read(**asked: Any) -> DataFrame:
            """A table of its own for each set of options."""
            return spark.read.format(source.name()).options(**settings, **{k: json.dumps(v) for k, v in asked.items()}).load(filepath)

        if not one:
            return cls(spark, read(), *catalogue(spark, source.reader_class, files, sidecar, settings), read)
        rows = channel_rows(filepath, head)
        return cls(spark, read() if rows else None, spark.createDataFrame(rows, CHANNELS), spark.createDataFrame(metadata_rows(filepath, head), METADATA), read)

    @classmethod
    def from_store(cls, spark: SparkSession, folder: str) -> Recording:
        """What ``to_store`` kept; channels and bounds on t or sample_index leave few row groups to read."""
        read, channels, metadata = store.load(spark, folder)
        return cls(spark, read(), channels, metadata, read)

    def to_store(self, folder: str, files: int | None = None, row_group_bytes: int = store.ROW_GROUP_BYTES) -> str:
        """Keep samples, channels and metadata in a new folder of Parquet tables, laid out by channel and time."""
        self._loaded()
        store.save(self.signals, self.channels, self.metadata, folder, files, row_group_bytes)
        return folder

    def _keep(self, signals: DataFrame | None, read: Callable[..., DataFrame] | None) -> None:
        self.signals, self._read, self._read_as = signals, read, signals

    def _reader(self) -> Callable[..., DataFrame]:
        """Loads samples by what is asked for. Samples that come from no file, or were set since, stay as they are."""
        signals = self.signals
        return self._read if self._read is not None and signals is self._read_as else lambda **asked: signals

    def _narrowed(self, rows: Callable[[DataFrame], DataFrame], table: DataFrame, /, **asked: Any) -> Recording:
        """Some of the samples: readers of files are asked for no others, and ``rows`` settles which."""
        before = self._reader()

        def read(**more: Any) -> DataFrame:
            return rows(before(**narrower(asked, more)))

        return Recording(self.spark, read(), table, self.metadata, read)

    def _names(self) -> list[str]:
        """Names of channels in order; one that several recordings have counts once."""
        first = self.channels.groupBy("channel").agg(F.min("channel_idx").alias("at"))
        return [r["channel"] for r in first.orderBy("at", "channel").collect()]

    def _loaded(self) -> None:
        if self.signals is None:
            raise ValueError("No signals loaded")

    def add_channel(self, label: str, data: Any, sample_frequency: float, physical_dimension: str, prefilter: str = "n/a", channel_type: str = "EMG") -> Recording:
        """Add (or replace) a channel of samples held by the driver. The first channel fixes the time base and the length."""
        values = np.asarray(data, dtype=np.float64)
        names = self._names()
        if sample_frequency <= 0:
            raise ValueError("the sampling rate must be above 0")
        rate, rec = float(sample_frequency), "recording"
        if self.signals is not None:
            first = self.channels.orderBy("channel_idx").first()
            rate, rec = first["sample_frequency"], first["recording_id"]
            n = self.signals.where(F.col("channel") == names[0]).count()
            if n != len(values):
                raise ValueError(f"Length of values ({len(values)}) does not match length of index ({n})")
        idx = names.index(label) if label in names else len(names)
        at = np.arange(len(values), dtype=np.int64)
        new = self.spark.createDataFrame(pd.DataFrame({"recording_id": rec, "channel_idx": np.int32(idx), "channel": label, "sample_index": at, "t": at / rate, "value": values}), SIGNALS)
        row = self.spark.createDataFrame([(rec, idx, label, channel_type, float(sample_frequency), physical_dimension, prefilter, *[None] * 9)], CHANNELS)
        self.signals = new if self.signals is None else self.signals.where(F.col("channel") != label).unionByName(new)
        self.channels = self.channels.where(F.col("channel") != label).unionByName(row)
        return self

    def select_channels(self, channels: str | list[str] | None = None, channel_type: str | None = None, inplace: bool = False) -> Recording:
        """Channels by name, in the order asked for, by type, or by both; repeated names count once."""
        self._loaded()
        if channels is None and channel_type is None:
            raise ValueError("give channels or a channel_type")
        if channels is None:
            chans = of_type(self.channels, channel_type)
            if chans.limit(1).count() == 0:
                raise ValueError(f"No channels found of type: {channel_type}")
            names = few_names(chans)
            out = self._narrowed(lambda samples: selected_samples(samples, chans, names), chans, **({} if names is None else {"channels": names}))
        else:
            wanted = list(dict.fromkeys([channels] if isinstance(channels, str) else channels))
            kinds: dict[str, set[str]] = {}
            for r in self.channels.where(F.col("channel").isin(wanted)).select("channel", "channel_type").distinct().collect():
                kinds.setdefault(r["channel"], set()).add(r["channel_type"])
            missing = [c for c in wanted if c not in kinds]
            if missing:
                raise ValueError(f"Channels not found: {missing}")
            if channel_type is not None:
                wanted = [c for c in wanted if channel_type in kinds[c]]
                if not wanted:
                    raise ValueError(f"None of the selected channels are of type: {channel_type}")
            chans = select_channels(self.channels, wanted)
            if channel_type is not None:
                chans = chans.where(F.col("channel_type") == channel_type)
            mixed = channel_type is not None and any(len(kinds[c]) > 1 for c in wanted)  # of another type in some recording
            out = self._narrowed(lambda samples: selected_samples(samples, chans, wanted) if mixed else select_channels(samples, wanted), chans, channels=wanted)
        if inplace:
            self._keep(out.signals, out._read)
            self.channels = chans
            return self
        return out

    def between(self, low: float | None = None, high: float | None = None, by: str = "t") -> Recording:
        """Samples from ``low`` to ``high``, both included, by t or by sample_index; files are read only where such samples may be."""
        self._loaded()
        if by not in ("t", "sample_index"):
            raise ValueError(f"a range is by t or by sample_index, not {by}")
        name = "time" if by == "t" else "sample"
        bounds = {f"{end}{name}": float(x) for end, x in (("from", low), ("to", high)) if x is not None}

        def rows(samples: DataFrame) -> DataFrame:
            samples = samples if low is None else samples.where(F.col(by) >= low)
            return samples if high is None else samples.where(F.col(by) <= high)

        return self._narrowed(rows, self.channels, **bounds)

    def channel_types(self) -> DataFrame:
        return self.channels.select("channel_type").distinct()

    def channels_of_type(self, channel_type: str) -> DataFrame:
        return self.channels.where(F.col("channel_type") == channel_type)

    def get_channel_types(self) -> list[str]:
        """The same as ``channel_types``, as a list."""
        return sorted(r["channel_type"] for r in self.channel_types().collect())

    def get_channels_by_type(self, channel_type: str) -> list[str]:
        """Names of ``channels_of_type`` as a list, in order."""
        return [r["channel"] for r in self.channels_of_type(channel_type).orderBy("channel_idx").select("channel").collect()]

    def channel_counts(self) -> DataFrame:
        return self.channels.groupBy("channel_type").count()

    @property
    def metadata(self) -> DataFrame:
        """The rows that were loaded, and those that were set since: one union, however many calls set them."""
        return self._metadata.unionByName(self.spark.createDataFrame(list(self._set.values()), METADATA)) if self._set else self._metadata

    @metadata.setter
    def metadata(self, rows: DataFrame) -> None:
        self._metadata, self._set, self._next = rows, {}, None

    def _numbered(self, value: Any) -> tuple[str | None, int, str]:
        text, kind = written(value)
        seq, self._next = self._next, self._next + 1
        return text, seq, kind

    def set_metadata(self, key: str, value: Any) -> None:
        """Keep a value under a key: text, numbers, booleans, dates, None, and lists or dicts of these. The last one written counts."""
        if self._next is None:
            self._next = (self._metadata.agg(F.max("seq")).first()[0] or 0) + 1
        self._set[key] = ("recording", key, *self._numbered(value))

    def get_metadata(self, key: str) -> Any:
        """The value last written under a key, of the type it had; None without one."""
        if key in self._set:
            _, _, text, _, kind = self._set[key]
            return read_back(text, kind)
        row = self._metadata.where(F.col("key") == key).orderBy(F.desc("seq")).first()
        return read_back(row["value"], row["kind"]) if row else None

    def analysis(self) -> DataFrame:
        """Per channel: range, noise floor, dynamic range, SNR, format and reason, with the channel's attributes."""
        self._loaded()
        return suitability(analysis_of(channel_stats(self.signals))).join(self.channels.drop("physical_min", "physical_max", "digital_min", "digital_max"), ["recording_id", "channel"])

    def quantization(self, bits: int) -> DataFrame:
        self._loaded()
        return quantize(self.signals, bits)

    def precision_loss(self, bits: int = 16) -> DataFrame:
        self._loaded()
        return precision_loss(self.signals, scaling(channel_stats(self.signals), bits))

    def export_figures(self, depths: tuple[int, ...] = (16, 24)) -> DataFrame:
        """Quantization and precision loss at several bit depths at once."""
        self._loaded()
        return export_figures(self.signals, depths)

    def summary(self) -> str:
        return summary_text(type_summary(self.analysis()))

    def plot_frame(self, channels: str | list[str] | None = None, time_range: tuple[float, float] | None = None, offset_scale: float = 0.8, uniform_scale: bool = True, detrend: bool = False) -> DataFrame:
        self._loaded()
        names = self._names()
        wanted = names if channels is None else [channels] if isinstance(channels, str) else list(channels)
        missing = [c for c in wanted if c not in names]
        if missing:
            raise ValueError(f"Channels not found: {missing}")
        bounds = {"fromtime": float(time_range[0]), "totime": float(time_range[1])} if time_range else {}
        data = self._reader()(channels=wanted, **bounds).where(F.col("channel").isin(wanted))
        if time_range:
            data = plotframe.time_range(data, *time_range)
        order = self.spark.createDataFrame([(c, i, len(wanted)) for i, c in enumerate(wanted)], "channel string, pos int, n int")
        return plotframe.plot_frame(data, order, offset_scale, uniform_scale, detrend)

    def plot_signals(self, channels: str | list[str] | None = None, plt_module: Any = None, grid: bool = True, title: str | None = None, show: bool = True, columns: int | None = plotframe.FIGURE["columns"], **frame: Any) -> None:
        """Draw stacked traces, each by what ``columns`` pixel columns show of it; None brings every sample to the driver."""
        if plt_module is None:
            import matplotlib.pyplot as plt_module
        plot = self.plot_frame(channels, **frame)
        wanted = self._names() if channels is None else [channels] if isinstance(channels, str) else list(channels)
        plotframe.render(plot, wanted, plt_module, grid, title, show, columns)

    def channels_tsv(self) -> DataFrame:
        return channels_tsv(self.channels)

    def to_edf(self, filepath: str, **kwargs: Any) -> str:
        """Write EDF+ or BDF+ and channels.tsv; returns the path written."""
        self._loaded()
        register(self.spark)
        return export_edf(self.signals, self.channels, filepath, **kwargs)

    def to_edf_folder(self, folder: str, **kwargs: Any) -> DataFrame:
        """Write each recording to a file of its own in one go; one row per channel, with its file and format."""
        self._loaded()
        register(self.spark)
        return export_recordings(self.signals, self.channels, folder, **kwargs)


def select_channels(table: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted channels, numbered anew in the order asked for."""
    place = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("channel")).cast("int") - 1
    return table.where(F.col("channel").isin(wanted)).withColumn("channel_idx", place)


def of_type(channels: DataFrame, channel_type: str) -> DataFrame:
    """Channels of a type, numbered anew in the order that each recording has them."""
    order = Window.partitionBy("recording_id").orderBy("channel_idx")
    return channels.where(F.col("channel_type") == channel_type).withColumn("channel_idx", F.row_number().over(order) - 1)


def narrower(some: dict, more: dict) -> dict:
    """Both of two sets of what a load is asked for."""
    out = {**some, **more}
    for k in some.keys() & more.keys():
        a, b = some[k], more[k]
        out[k] = [c for c in a if c in set(b)] if isinstance(a, list) else max(a, b) if k.startswith("from") else min(a, b)
    return out


def few_names(channels: DataFrame) -> list[str] | None:
    """Names of the channels, if there are no more than FEW_NAMES."""
    names = sorted(r["channel"] for r in channels.select("channel").distinct().limit(FEW_NAMES + 1).collect())
    return names if len(names) <= FEW_NAMES else None


def selected_samples(signals: DataFrame, channels: DataFrame, names: list[str] | None) -> DataFrame:
    """Samples of the channels that a table lists, with its numbers: a join whose plan does not grow with their number.

    Spark broadcasts the table where it is small, and else may filter the samples by a bloom filter of it. ``names`` are
    those of the channels, where they are few.
    """
    if names is not None:
        signals = signals.where(F.col("channel").isin(names))
    return signals.drop("channel_idx").join(channels.select(*KEYS, "channel_idx"), KEYS)


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """The last written value of each key: recording_id, key, value."""
    return metadata.groupBy("recording_id", "key").agg(F.max_by("value", "seq").alias("value"))
