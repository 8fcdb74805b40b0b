"""The frame of a recording source: headers, and samples read on executors as Arrow batches.

One file is planned from its header. Many files are planned from their names and sizes alone: byte ranges are packed into
partitions of even size, and the task that gets a range reads the file's header and takes the units that begin in it.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import SIGNALS
from .files import is_one_file, list_files

_ARROW = pa.schema([("recording_id", pa.string()), ("channel_idx", pa.int32()), ("channel", pa.string()), ("sample_index", pa.int64()), ("t", pa.float64()), ("value", pa.float64())])
BLOCK_SAMPLES = 1 << 20
#: Bytes of files in one partition, and what opening a file counts for, unless the options packbytes and opencost say otherwise.
PACK_BYTES, OPEN_COST = 128 << 20, 1 << 20


@dataclass
class Header:
    """What is known of a file: channels in order, recording metadata, and what the reader needs to find samples."""

    channels: list[dict]
    metadata: list[tuple[str, object]]
    layout: dict = field(default_factory=dict)


@dataclass
class Slice(InputPartition):
    first: int
    end: int

    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


@dataclass
class Pack(InputPartition):
    """Byte ranges of files: path, first byte, end."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        super().__init__(tuple(ranges))
        self.ranges = ranges


def byte_ranges(path: str, size: int, most: int) -> list[tuple[str, int, int]]:
    return [(path, a, min(size, a + most)) for a in range(0, max(1, size), most)]


def packed(files: list[tuple[str, int]], most: int, opening: int, may_split: Callable[[str], bool] = lambda path: True) -> list[Pack]:
    """Cut files into ranges of at most ``most`` bytes and put them, large ones first, into packs that hold no more; a file that must stay whole may be a larger pack."""
    ranges = [one for path, size in files for one in (byte_ranges(path, size, most) if may_split(path) else [(path, 0, size)])]
    packs: list[Pack] = []
    room = 0
    for one in sorted(ranges, key=lambda r: (r[1] - r[2], r[0], r[1])):
        need = one[2] - one[1] + opening
        if need > room or not packs:
            packs.append(Pack([]))
            room = most + opening
        packs[-1].ranges.append(one)
        room -= need
    return packs


class Asked:
    """What the options of a load ask for: ``channels`` and ``recordings`` (JSON lists of names), and bounds on sample_index
    (``fromsample``, ``tosample``) and t (``fromtime``, ``totime``), which only save work: rows beside them may come.

    Options, not pushed filters: Spark keeps one Python reader for all scans of a loaded table, so a filter of one scan
    would narrow the others.
    """

    def __init__(self, options: dict) -> None:
        self.wanted, self.recordings = (set(json.loads(options[k])) if k in options else None for k in ("channels", "recordings"))
        self.bounds = {c: (float(options.get(f"from{k}", -inf)), float(options.get(f"to{k}", inf))) for c, k in (("sample_index", "sample"), ("t", "time"))}


class RecordingReader(Asked, DataSourceReader, ABC):
    """Reads slices of one file's samples: units of a fixed number of bytes, or a whole file that has no such units."""

    #: Names of files that a folder of recordings may hold.
    extensions: tuple[str, ...] = ()

    def __init__(self, path: str, options: dict) -> None:
        super().__init__(options)
        self.path, self.options = path, options
        self.header = self.read_header(path, options)

    @staticmethod
    @abstractmethod
    def read_header(path: str, options: dict | None = None) -> Header: ...

    @staticmethod
    def sizes(files: list[tuple[str, int]], options: dict) -> list[tuple[str, int]]:
        """Names and bytes that ranges are cut from."""
        return files

    @staticmethod
    def may_split(path: str, options: dict) -> bool:
        """Whether byte ranges of a file may be read by different tasks."""
        return True

    @abstractmethod
    def units(self) -> tuple[int, int, int, int]:
        """Number of units, the first one's byte, bytes of a unit (0: the file cannot be entered midway), and units in a slice."""

    @abstractmethod
    def decode(self, part: Slice, idx: int) -> tuple[int, np.ndarray]:
        """The first sample index and the values of channel number ``idx`` in a slice."""

    def index_range(self, part: Slice, idx: int) -> tuple[float, float]:
        """Bounds of the sample indices of channel number ``idx`` in a slice, end exclusive."""
        return -inf, inf

    def _rate(self, idx: int) -> float:
        """The rate that times of a channel follow from: the first channel's, unless each has its own time base."""
        return self.header.channels[0 if self.options.get("timebase", "shared") == "shared" else idx]["sample_frequency"]

    def times(self, part: Slice, idx: int, first: int, n: int) -> np.ndarray:
        return np.arange(first, first + n, dtype=np.int64) / self._rate(idx)

    def time_bounds(self, idx: int) -> tuple[float, float]:
        """Bounds of the sample indices of a channel that the bounds on t leave; a sample beside them counts."""
        low, high = self.bounds["t"]
        return low * self._rate(idx) - 1, high * self._rate(idx) + 1

    def slices(self, begin: float = 0, stop: float = inf) -> list[Slice]:
        """Slices of the units whose first byte lies in a range of bytes."""
        n, offset, size, step = self.units()
        if not size:
            return [Slice(0, n)] if begin <= 0 else []
        first, end = (0 if x <= offset else n if x == inf else min(n, -int(-(x - offset) // size)) for x in (begin, stop))
        return [Slice(a, min(end, a + step)) for a in range(first, end, step)]

    def _holds_some(self, part: Slice) -> bool:
        """Whether a slice may hold a sample within the bounds of a wanted channel."""
        for idx, ch in enumerate(self.header.channels):
            if self.wanted is None or ch["channel"] in self.wanted:
                first, end = self.index_range(part, idx)
                low, high = self.time_bounds(idx)
                low, high = max(self.bounds["sample_index"][0], low), min(self.bounds["sample_index"][1], high)
                if first <= high and low < end:
                    return True
        return False

    def within(self, begin: float = 0, stop: float = inf) -> list[Slice]:
        if self.recordings is not None and self.path not in self.recordings:
            return []
        return [p for p in self.slices(begin, stop) if self._holds_some(p)]

    def partitions(self) -> list[InputPartition]:
        return self.within() or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        for idx, ch in enumerate(self.header.channels):
            if self.wanted is not None and ch["channel"] not in self.wanted:
                continue
            first, values = self.decode(partition, idx)
            n = len(values)
            t = self.times(partition, idx, first, n)
            for a in range(0, n, BLOCK_SAMPLES):
                b = min(n, a + BLOCK_SAMPLES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(self.path, b - a),
                        pa.repeat(pa.scalar(idx, pa.int32()), b - a),
                        pa.repeat(pa.scalar(ch["channel"], pa.string()), b - a),
                        pa.array(np.arange(first + a, first + b, dtype=np.int64)),
                        pa.array(np.ascontiguousarray(t[a:b])),
                        pa.array(np.ascontiguousarray(values[a:b], dtype=np.float64)),
                    ],
                    schema=_ARROW,
                )


class FolderReader(Asked, DataSourceReader):
    """Reads many files of one kind. The driver knows their names and sizes; headers are read where the samples are."""

    def __init__(self, kind: type[RecordingReader], files: list[tuple[str, int]], options: dict) -> None:
        super().__init__(options)
        self.kind, self.files, self.options = kind, files, options

    def partitions(self) -> list[InputPartition]:
        files = [f for f in self.files if self.recordings is None or f[0] in self.recordings]
        most = int(self.options.get("packbytes", PACK_BYTES))
        return packed(files, most, int(self.options.get("opencost", OPEN_COST)), lambda path: self.kind.may_split(path, self.options)) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        for path, begin, stop in partition.ranges:
            one = self.kind(path, self.options)
            for part in one.within(begin, stop):
                yield from one.read(part)


class RecordingSource(DataSource):
    """Base of the registered formats: load takes a file, a folder, a pattern, or a list of files."""

    reader_class: type[RecordingReader]

    def schema(self):
        return SIGNALS

    def reader(self, schema) -> DataSourceReader:
        path, options = self.options.get("path") or json.loads(self.options["paths"]), dict(self.options)
        if is_one_file(path):
            return self.reader_class(path, options)
        return FolderReader(self.reader_class, self.reader_class.sizes(list_files(path, self.reader_class.extensions), options), options)
