"""CSV exports of Trigno systems: label lines, one header line with X[s], then columns of samples.

Rows of text have no fixed width, and a sample's index is its row's ordinal. A text whose rows were counted by range (see
``catalogue.counted``) is read by ranges, each with the ordinal of its first row; any other is one partition. Either way a
task holds one block of lines.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import inf
from typing import TextIO

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql.datasource import InputPartition

from ..functions.rules import LABEL_PARTS, TRIGNO_KINDS, kind_of
from .base import Header, RecordingReader, RecordingSource
from .files import locate, must_exist

DEVICE = "Delsys Trigno"
#: Bytes of lines that a task parses at once.
BLOCK_BYTES = 8 << 20
_NEWLINE, _QUOTE = 10, 34
#: Bytes that a row of samples has besides those of its separators, quotes and blanks.
_FILLED = np.ones(256, dtype=bool)
_FILLED[list(b',"\t\n\v\f\r ')] = False


def csv_structure(lines: Iterable[str] | str) -> tuple[list[str], int, str]:
    """The lines before the header that are not blank, the header's line number from 1, and the header. Lines after it are not read."""
    before = []
    for number, line in enumerate(io.StringIO(lines) if isinstance(lines, str) else lines, 1):
        line = line.strip()
        if "X[s]" in line:
            return before, number, line
        if line:
            before.append(line)
    raise ValueError("no header line with X[s] in the file")


def label_lines(lines: list[str]) -> dict[str, dict]:
    """Channel name to rate and unit; the last line of a name counts. A line without its markers is an error."""
    out: dict[str, dict] = {}
    for line in lines:
        if not line.startswith("Label:"):
            continue
        name, rate, unit = (re.search(LABEL_PARTS[part], line) for part in ("name", "sample_frequency", "physical_dimension"))
        if not (name and rate and unit):
            raise ValueError(f"incomplete label line: {line}")
        out[name[1].strip()] = {"sample_frequency": float(rate[1]), "physical_dimension": unit[1].strip()}
    return out


@contextmanager
def text_lines(path: str) -> Iterator[TextIO]:
    """The file as a stream of lines, read a block at a time."""
    system, at = locate(path)
    with system.open_input_stream(at) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as lines:
        yield lines


def line_blocks(path: str, begin: int, end: float, size: int = 0) -> Iterator[bytes]:
    """The lines whose first byte lies in a range of bytes, some ``size`` bytes (BLOCK_BYTES) of whole lines at a time."""
    system, name = locate(path)
    with system.open_input_file(name) as f:
        end, want = min(end, f.size()), size or BLOCK_BYTES
        at, skip = (begin - 1, True) if begin > 0 else (0, False)  # the line that holds the byte before is another range's
        step = want
        while at < end:
            f.seek(at)
            data = f.read(step)
            last = data.find(b"\n", max(0, int(end) - 1 - at)) + 1
            cut = last or (len(data) if at + len(data) >= f.size() else data.rfind(b"\n") + 1)
            if not cut:  # a line longer than this
                step *= 2
                continue
            first = data.find(b"\n") + 1 or cut if skip else 0
            if first < cut:
                yield data[first:cut]
            at, skip, step = at + cut, False, want


def sample_lines(data: bytes) -> tuple[bytes, int]:
    """Whole lines without those that hold no sample, and how many are left; line ends become one byte. A line break within quotes is an error."""
    if b"\r" in data:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if not data.endswith(b"\n"):
        data += b"\n"
    one = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(one == _NEWLINE) + 1
    if b'"' in data and np.any(np.searchsorted(np.flatnonzero(one == _QUOTE), ends) % 2):
        raise ValueError("a line break within quotes")
    starts = np.concatenate([[0], ends[:-1]])
    filled = np.logical_or.reduceat(_FILLED[one], starts)
    if not filled.all():
        data = one[np.repeat(filled, ends - starts)].tobytes()
    return data, int(filled.sum())


def _cell_by_cell(data: bytes, columns: list[int]) -> list[np.ndarray]:
    rows = [[row[at].strip() if at < len(row) else "" for at in columns] for row in csv.reader(io.StringIO(data.decode()))]
    return list(np.array([[float(cell) if cell else np.nan for cell in row] for row in rows]).reshape(-1, len(columns)).T)


def cells(data: bytes, columns: list[int]) -> list[np.ndarray]:
    """Numbers of the columns at the given places, NaN where a row has none. Lines of unequal numbers of cells are read one by one."""
    if not data or not columns:
        return [np.zeros(0) for _ in columns]
    names = [f"f{at}" for at in columns]
    try:
        table = arrow_csv.read_csv(
            pa.BufferReader(data),
            arrow_csv.ReadOptions(use_threads=False, block_size=len(data) + 1, autogenerate_column_names=True),
            arrow_csv.ParseOptions(),
            arrow_csv.ConvertOptions(column_types={n: pa.float64() for n in names}, include_columns=names, include_missing_columns=True, null_values=[""], check_utf8=False),
        )
    except pa.ArrowInvalid:
        return _cell_by_cell(data, columns)
    return [table.column(n).to_numpy() for n in names]


@dataclass
class TextRange(InputPartition):
    """Lines that begin in a range of bytes; the ordinal of the first, and the end of the ordinals where it is known."""

    begin: int
    end: float
    first: int
    last: float

    def __init__(self, begin: int, end: float, first: int, last: float) -> None:
        super().__init__((begin, end, first, last))
        self.begin, self.end, self.first, self.last = begin, end, first, last


class TrignoReader(RecordingReader):
    extensions = (".csv",)

    @staticmethod
    def may_split(path: str, options: dict) -> bool:
        return path in json.loads(options.get("rowcounts", "{}"))

    @staticmethod
    def read_header(path: str, options: dict | None = None) -> Header:
        must_exist(path)
        read = 0

        def counting(lines: Iterable[str]) -> Iterator[str]:
            nonlocal read
            for line in lines:
                read += len(line.encode())
                yield line

        with text_lines(path) as lines:
            before, _, header = csv_structure(counting(lines))
        if next(line_blocks(path, 0, 1)).startswith(b"\xef\xbb\xbf"):
            read += 3
        info = label_lines(before)
        seen: dict[str, int] = {}
        columns = []
        for at, raw in enumerate(next(csv.reader([header]))):
            name = raw.replace("X[s]", "").strip().strip('"')
            if name in info and at > 0 and name not in seen:
                seen[name] = at
                columns.append((at, name))
        channels = [
            {"channel": name, "channel_type": kind_of(TRIGNO_KINDS, label=name), "prefilter": "n/a", **info[name]} for _, name in columns
        ]
        return Header(channels, [("source_file", path), ("device", DEVICE)], {"begin": read, "columns": [at for at, _ in columns]})

    def blocks(self, begin: int, end: float) -> Iterator[tuple[bytes, int]]:
        """Blocks of lines with samples, and their number, of the lines that begin in a range of bytes."""
        start = self.header.layout["begin"]
        for data in line_blocks(self.path, max(begin, start), end) if end > start else ():
            data, n = sample_lines(data)
            if n:
                yield data, n

    def count(self, begin: int, end: float, filled: bool) -> tuple[int, list[int]]:
        """Rows in a range of bytes and, if asked for, the row after each channel's last sample there."""
        columns, rows = self.header.layout["columns"], 0
        after = [0] * len(columns)
        for data, n in self.blocks(begin, end):
            if filled:
                for k, values in enumerate(cells(data, columns)):
                    some = np.flatnonzero(~np.isnan(values))
                    after[k] = rows + int(some[-1]) + 1 if len(some) else after[k]
            rows += n
        return rows, after

    def units(self) -> tuple[int, int, int, int]:
        return 1, 0, 0, 1

    def slices(self, begin: float = 0, stop: float = inf) -> list[TextRange]:
        known = json.loads(self.options.get("rowcounts", "{}")).get(self.path)
        if known is None:
            return [TextRange(0, inf, 0, inf)] if begin <= 0 else []
        at, rows = known["begin"], np.cumsum([0, *known["rows"]]).tolist()
        return [TextRange(a, b, i, j) for a, b, i, j in zip(at, [*at[1:], inf], rows[:-1], rows[1:], strict=True) if begin <= a < stop and j > i]

    def index_range(self, part: TextRange, idx: int) -> tuple[float, float]:
        return part.first, part.last

    def partitions(self) -> list[InputPartition]:
        return self.within() or [TextRange(0, 0, 0, 0)]

    def _lengths(self) -> list[float]:
        """Samples of each channel: all rows, unless each has its own time base and ends with its last sample."""
        if self.options.get("timebase", "shared") == "shared":
            return [inf] * len(self.header.channels)
        known = json.loads(self.options.get("rowcounts", "{}")).get(self.path)
        return known["lengths"] if known else self.count(0, inf, True)[1]

    def read(self, partition: TextRange) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.begin:
            return
        of, lengths = self.header.layout["columns"], self._lengths()
        asked = [k for k, ch in enumerate(self.header.channels) if self.wanted is None or ch["channel"] in self.wanted]
        first = partition.first
        for data, n in self.blocks(partition.begin, partition.end):
            values = cells(data, [of[k] for k in asked])
            self._block = {k: (first, v[: max(0, int(min(len(v), lengths[k] - first)))]) for k, v in zip(asked, values, strict=True)}
            yield from super().read(partition)
            first += n

    def decode(self, part: TextRange, idx: int) -> tuple[int, np.ndarray]:
        return self._block[idx]


class TrignoSource(RecordingSource):
    """``format("trigno")``: one partition per file, or per counted range of it."""

    reader_class = TrignoReader

    @classmethod
    def name(cls) -> str:
        return "trigno"
