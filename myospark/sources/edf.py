"""EDF, EDF+, BDF and BDF+ files, from the published layout: a fixed-width header, then data records.

In the discontinuous variants (EDF+D, BDF+D) each record says when it begins, in the first time-stamped annotation list
of its annotation signal. Samples get their time from their record's onset, and a bound on t is turned into a range of
records by bisection, which reads a few onsets.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from math import inf

import numpy as np

from ..functions.rules import EDF_KINDS, kind_of, to_physical
from .base import BLOCK_SAMPLES, Header, RecordingReader, RecordingSource, Slice
from .files import file_size, read_bytes

#: The fields of one signal's header and their widths.
SIGNAL_FIELDS = [
    ("label", 16), ("transducer", 80), ("dimension", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32),
]
_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def _start(date: str, time: str) -> datetime:
    d, m, y = (int(x) for x in date.split("."))
    h, mi, s = (int(x) for x in time.split("."))
    return datetime(y + (1900 if y >= 85 else 2000), m, d, h, mi, s)


def _plus_fields(patient: str, recording: str) -> dict[str, str]:
    """Subfields of the plus variants; X stands for unknown and underscores for spaces."""
    part = lambda words, k: "" if k >= len(words) or words[k] == "X" else words[k].replace("_", " ")
    p, r = patient.split(), recording.split()
    out = {"patientcode": part(p, 0), "gender": {"M": "Male", "F": "Female"}.get(part(p, 1), ""), "birthdate": part(p, 2), "patient_name": part(p, 3), "patient_additional": " ".join(p[4:])}
    return out | {"admincode": part(r, 2), "technician": part(r, 3), "equipment": part(r, 4), "recording_additional": " ".join(r[5:])}


def parse_header(path: str) -> dict:
    """All header fields; signals as dicts of stripped text."""
    main = read_bytes(path, 0, 256)
    if len(main) < 256:
        raise ValueError("the file is shorter than a header")
    bdf = main[:1] == b"\xff"
    if not bdf and main[:8].strip() != b"0":
        raise ValueError("not an EDF or BDF file")
    text = lambda a, b: main[a:b].decode("latin-1").strip()
    n = int(text(252, 256))
    raw = read_bytes(path, 256, 256 * n)
    if len(raw) < 256 * n:
        raise ValueError("the signal headers are cut off")
    signals: list[dict] = [{} for _ in range(n)]
    at = 0
    for name, width in SIGNAL_FIELDS:
        for s in signals:
            s[name] = raw[at : at + width].decode("latin-1").strip()
            at += width
    out = {
        "bdf": bdf, "patient": text(8, 88), "recording": text(88, 168), "start": _start(text(168, 176), text(176, 184)), "header_bytes": int(text(184, 192)),
        "reserved": text(192, 236), "records": int(text(236, 244)), "duration": float(text(244, 252)), "signals": signals,
    }
    width = 3 if bdf else 2
    for s in signals:
        s["samples"] = int(s["samples"])
    size = width * sum(s["samples"] for s in signals)
    have = (file_size(path) - out["header_bytes"]) // size if size else 0
    out["records"] = have if out["records"] < 0 else out["records"]
    if out["records"] > have:
        raise ValueError(f"{out['records']} data records are announced, {have} are there")
    return out | {"width": width, "record_bytes": size}


#: The time-keeping list of a record: its onset in seconds, no duration, and an empty first annotation.
_ONSET = re.compile(rb"([+-][0-9]+(?:\.[0-9]*)?)\x14\x14")


def onset_of(notes: bytes, record: int) -> float:
    """When a record begins, from the bytes of its annotation signal."""
    found = _ONSET.match(notes)
    if not found:
        raise ValueError(f"data record {record} of a discontinuous file does not say when it begins")
    return float(found[1])


class RecordClock:
    """Onsets of a discontinuous file's records, read where they are asked for; records follow each other in time."""

    def __init__(self, path: str, layout: dict) -> None:
        self.path, self.layout = path, layout
        self.known: dict[int, float] = {}

    def onset(self, record: int) -> float:
        if record not in self.known:
            at, size = self.layout["notes"]
            raw = read_bytes(self.path, self.layout["header_bytes"] + record * self.layout["record_bytes"] + at * self.layout["width"], size * self.layout["width"])
            self.known[record] = onset_of(raw, record)
        return self.known[record]

    def first_from(self, t: float) -> int:
        """The first record that begins after ``t``; the number of records if none does."""
        low, high = 0, self.layout["records"]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.onset(mid) > t else (mid + 1, high)
        return low


class EdfReader(RecordingReader):
    extensions = (".edf", ".bdf")

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self._ranges: dict[tuple[float, float], tuple[int, int]] = {}

    @staticmethod
    def read_header(path: str, options: dict | None = None) -> Header:
        try:
            h = parse_header(path)
        except Exception as e:
            raise ValueError(f"Error reading EDF file: {e}") from e
        plus = h["reserved"][:5] in ("EDF+C", "EDF+D", "BDF+C", "BDF+D")
        channels, seen, at, notes = [], {}, 0, None
        for s in h["signals"]:
            if plus and s["label"] in ("EDF Annotations", "BDF Annotations"):
                notes = notes or (at, s["samples"])
                at += s["samples"]
                continue
            ch = {
                "channel": s["label"], "channel_type": kind_of(EDF_KINDS, label=s["label"].upper(), transducer=s["transducer"].upper()), "sample_frequency": s["samples"] / h["duration"] if h["duration"] else float(s["samples"]),
                "physical_dimension": s["dimension"] or "n/a", "prefilter": s["prefilter"] or "n/a", "physical_min": float(s["pmin"]), "physical_max": float(s["pmax"]),
                "digital_min": int(s["dmin"]), "digital_max": int(s["dmax"]), "transducer": s["transducer"], "at": at, "samples": s["samples"],
            }
            if ch["digital_min"] >= ch["digital_max"] or ch["physical_min"] == ch["physical_max"]:
                raise ValueError(f"Error reading EDF file: signal {s['label']} has an empty range")
            at += s["samples"]
            if s["label"] in seen:
                channels[seen[s["label"]]] = ch  # of repeated labels the last counts
            else:
                seen[s["label"]] = len(channels)
                channels.append(ch)
        fields = {"startdate": h["start"]}
        fields |= _plus_fields(h["patient"], h["recording"]) if plus else {"patientcode": h["patient"], "recording_additional": h["recording"]}
        meta = [(k, v) for k, v in fields.items() if v]
        kind = (3 if plus else 2) if h["bdf"] else (1 if plus else 0)
        meta += [("source_file", path), ("filetype", kind), ("number_of_signals", len(channels)), ("file_duration", h["records"] * h["duration"]), ("datarecord_duration", h["duration"])]
        gaps = h["reserved"][:5] in ("EDF+D", "BDF+D")
        if gaps and notes is None:
            raise ValueError("Error reading EDF file: a discontinuous file without an annotation signal has no times")
        return Header(channels, meta, {k: h[k] for k in ("header_bytes", "records", "record_bytes", "width", "duration")} | {"notes": notes if gaps else None})

    def units(self) -> tuple[int, int, int, int]:
        lay = self.header.layout
        return lay["records"], lay["header_bytes"], max(1, lay["record_bytes"]), max(1, BLOCK_SAMPLES * 8 // max(1, lay["record_bytes"]))

    def time_bounds(self, idx: int) -> tuple[float, float]:
        if not self.header.layout["notes"]:
            return super().time_bounds(idx)
        low, high = self.bounds["t"]
        if (low, high) not in self._ranges:
            clock, length = RecordClock(self.path, self.header.layout), self.header.layout["duration"]
            self._ranges[low, high] = 0 if low == -inf else max(0, clock.first_from(low - length) - 1), self.header.layout["records"] if high == inf else clock.first_from(high)
        first, end = self._ranges[low, high]
        samples = self.header.channels[idx]["samples"]
        return first * samples, end * samples - 1

    def times(self, part: Slice, idx: int, first: int, n: int) -> np.ndarray:
        """In a discontinuous file every channel's times follow from the onsets and its own rate."""
        if not self.header.layout["notes"]:
            return super().times(part, idx, first, n)
        ch = self.header.channels[idx]
        return (self._onsets[:, None] + np.arange(ch["samples"]) / ch["sample_frequency"]).ravel()

    def index_range(self, part: Slice, idx: int) -> tuple[float, float]:
        samples = self.header.channels[idx]["samples"]
        return part.first * samples, part.end * samples

    def read(self, partition: Slice):
        lay = self.header.layout
        raw = read_bytes(self.path, lay["header_bytes"] + partition.first * lay["record_bytes"], (partition.end - partition.first) * lay["record_bytes"])
        self._bytes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, max(1, lay["record_bytes"]))
        if lay["notes"]:
            a, b = lay["notes"][0] * lay["width"], sum(lay["notes"]) * lay["width"]
            self._onsets = np.array([onset_of(row[a:b].tobytes(), partition.first + k) for k, row in enumerate(self._bytes)])
        yield from super().read(partition)

    def decode(self, part: Slice, idx: int) -> tuple[int, np.ndarray]:
        ch, w = self.header.channels[idx], self.header.layout["width"]
        raw = np.ascontiguousarray(self._bytes[:, ch["at"] * w : (ch["at"] + ch["samples"]) * w]).reshape(-1, w)
        if w == 2:
            code = raw.view("<i2").ravel().astype(np.int32)
        else:
            code = raw[:, 0].astype(np.int32) | (raw[:, 1].astype(np.int32) << 8) | (raw[:, 2].view(np.int8).astype(np.int32) << 16)
        return part.first * ch["samples"], to_physical(code, ch["physical_min"], ch["physical_max"], ch["digital_min"], ch["digital_max"])


class EdfSource(RecordingSource):
    """``format("edf")``: partitions are ranges of data records. It writes rows of ``sinks.edf.placed_samples``."""

    reader_class = EdfReader

    @classmethod
    def name(cls) -> str:
        return "edf"

    def writer(self, schema, overwrite: bool):
        from ..sinks.edf import EdfWriter

        if schema.fieldNames() != ["file", "part", "slot", "digital", "spec"]:
            raise ValueError("format edf writes rows of placed_samples: use export_recordings or Recording.to_edf")
        folder = self.options["path"]
        return EdfWriter(folder, self.options.get("staging") or f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}", overwrite)
