"""OTB and OTB+ archives: a tar of an XML description and a file of interleaved little-endian 16-bit words.

A plain archive is never unpacked: members are found by their offsets, and executors read byte ranges of whole sample
rows. A compressed one has no such ranges: one task streams its samples, a block at a time, unless ``unpack`` has put them
beside their description in a folder, whence they are read in ranges.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import os
import tarfile
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from ..functions.rules import OTB_KINDS, OTHER_UNIT, UNITS, kind_of, millivolts_per_step
from .base import BLOCK_SAMPLES, Header, RecordingReader, RecordingSource, Slice
from .files import locate, must_exist, read_bytes

COPY_BYTES = 4 << 20
_BROKEN = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError)


def members(path: str) -> tuple[dict[str, tuple[int, int]], bool]:
    """Name to offset and size of the archive's files, and whether it is compressed, when offsets are those of the plain archive."""
    for mode in ("r:", "r:*"):
        try:
            with _open(path) as raw, tarfile.open(fileobj=raw, mode=mode) as tar:
                return {m.name: (m.offset_data, m.size) for m in tar if m.isfile()}, mode == "r:*"
        except _BROKEN as e:
            if mode == "r:*":
                raise ValueError(f"Error extracting OTB file: {e}") from e
    raise AssertionError


def _open(path: str):
    system, at = locate(path)
    return system.open_input_file(at)


def member_bytes(path: str, name: str, found: dict[str, tuple[int, int]], packed: bool) -> bytes:
    """The whole of one file of the archive."""
    if not packed:
        return read_bytes(path, *found[name])
    with _open(path) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:
        return tar.extractfile(name).read()


def member_blocks(path: str, name: str, size: int) -> Iterator[bytes]:
    """One file of a compressed archive, ``size`` bytes at a time."""
    with _open(path) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:
        yield from _blocks(tar.extractfile(name), size)


def _blocks(stream: BinaryIO, size: int) -> Iterator[bytes]:
    while block := stream.read(size):
        yield block


def is_compressed(path: str) -> bool:
    """Whether a file is no plain archive, by its first block."""
    head = read_bytes(path, 0, tarfile.BLOCKSIZE)
    try:
        tarfile.TarInfo.frombuf(head, tarfile.ENCODING, "surrogateescape")
    except tarfile.HeaderError:
        return True
    return False


def unpack(path: str, folder: str) -> tuple[str, int] | None:
    """Put the samples and the description of a compressed archive into a folder, block by block; None for a plain one.

    Returns their path without extension, and the bytes of samples. Its name follows from the archive's path, size and time
    of change, so what an earlier call or another attempt put there whole is taken as it is. Samples are written under a
    name of the attempt and moved into place last.
    """
    if not is_compressed(path):
        return None
    system, at = locate(path)
    info = system.get_file_info(at)
    stem = f"{folder.rstrip('/')}/{hashlib.sha256(f'{path}:{info.size}:{info.mtime_ns}'.encode()).hexdigest()[:32]}"
    out, place = locate(stem)
    done = out.get_file_info(f"{place}.sig")
    if done.is_file:
        return stem, done.size
    out.create_dir(place.rsplit("/", 1)[0])
    attempt = f"{place}.{uuid.uuid4().hex}"
    sig, texts = None, {}
    try:
        with _open(path) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:  # a stream ("r|*") would end with the first member of a gzip file
            for m in tar:
                if m.isfile() and m.name.endswith(".sig") and sig is None:
                    sig = m.name
                    with out.open_output_stream(attempt) as f:
                        for block in _blocks(tar.extractfile(m), COPY_BYTES):
                            f.write(block)
                elif m.isfile() and m.name.endswith(".xml"):
                    texts[m.name] = tar.extractfile(m).read()
        text = texts[description_of(sig, texts)]
    except (*_BROKEN, ValueError) as e:
        if out.get_file_info(attempt).is_file:
            out.delete_file(attempt)
        raise e if isinstance(e, ValueError) else ValueError(f"Error extracting OTB file: {e}") from e
    with out.open_output_stream(f"{place}.xml") as f:
        f.write(text)
    out.move(attempt, f"{place}.sig")
    return stem, out.get_file_info(f"{place}.sig").size


def description_of(sig: str | None, names) -> str:
    if sig is None:
        raise ValueError("No .sig file found in OTB archive")
    xml = os.path.splitext(sig)[0] + ".xml"
    if xml not in names:
        raise ValueError(f"No matching .xml file for {sig}")
    return xml


def _first(attrs: dict, *names: str) -> str:
    return next((attrs[n] for n in names if attrs.get(n)), "")


def parse_xml(text: bytes) -> tuple[dict, list[dict]]:
    """Device attributes, and the channels sorted as they appear with their place in a sample row."""
    root = ET.fromstring(text)
    device = root.find(".//Device")
    device = root if device is None else device
    a = device.attrib
    rate = float(_first(a, "SampleFrequency", "sampleFrequency", "SamplingFrequency", "samplingFrequency") or 0)
    info = {
        "name": _first(a, "Name", "name", "DeviceName", "deviceName"),
        "sampling_frequency": rate,
        "ad_bits": int(_first(a, "ad_bits", "AD_bits", "AdBits", "adBits") or 16),
        "total": int(a.get("DeviceTotalChannels") or 0),
    }
    channels: dict[str, dict] = {}
    holder = device.find(".//Channels")
    for adapter in [] if holder is None else holder.findall(".//Adapter"):
        x = adapter.attrib
        filters = [f"{tag}:{x[key]}Hz" for tag, key in (("HP", "HighPassFilter"), ("LP", "LowPassFilter")) if x.get(key)]
        for channel in adapter.findall(".//Channel"):
            c = channel.attrib
            place = int(x.get("ChannelStartIndex", 0)) + int(c.get("Index", 0))
            kind = kind_of(OTB_KINDS, adapter=x.get("ID", ""), description=c.get("Description", ""), channel_id=c.get("ID", ""))
            gain = float(x.get("Gain", 1.0))
            if kind == "EMG" and gain == 0:
                raise ValueError(f"adapter {x.get('ID', '')} has gain 0")
            channels[f"CH{place + 1}"] = {
                "channel": f"CH{place + 1}", "place": place, "channel_type": kind, "physical_dimension": UNITS.get(kind, OTHER_UNIT),
                "prefilter": " ".join(filters) or "n/a", "sample_frequency": rate, "adapter": x.get("ID", ""), "gain": gain,
                "description": c.get("Description", ""), "muscle": c.get("Muscle", ""),
            }
    return info, list(channels.values())


def unpacked_files(options: dict | None) -> dict[str, tuple[str, int]]:
    """What ``unpack`` returned for each archive, from the options of a load."""
    return json.loads((options or {}).get("unpacked", "{}"))


def header_from(path: str, text: bytes, sig: str, offset: int, size: int, layout: dict) -> Header:
    """A header by the description, and the place and size of the samples."""
    info, channels = parse_xml(text)
    if info["sampling_frequency"] <= 0:
        raise ValueError("the device has no sampling rate above 0")
    width = info["total"] or len(channels)
    if not width or any(c["place"] >= width for c in channels):
        raise ValueError("channel numbers exceed the number of channels of a sample row")
    rows, rest = divmod(size, 2 * width)
    if rest or (info["ad_bits"] == 24 and rows % 2):
        raise ValueError(f"{sig} does not hold whole sample rows of {width} channels")
    meta = [("source_file", path), ("device", info["name"]), ("signal_resolution", info["ad_bits"])]
    return Header(channels, meta, {"offset": offset, "rows": rows, "width": width, "bits": info["ad_bits"], **layout})


class OtbReader(RecordingReader):
    extensions = (".otb", ".otb+")
    unpack = staticmethod(unpack)

    @staticmethod
    def read_header(path: str, options: dict | None = None) -> Header:
        must_exist(path)
        unpacked = unpacked_files(options).get(path)
        if unpacked is not None:
            stem, size = unpacked
            return header_from(path, read_bytes(f"{stem}.xml"), "its .sig file", 0, size, {"data": f"{stem}.sig", "packed": None})
        found, packed = members(path)
        sig = next((n for n in found if n.endswith(".sig")), None)
        text = member_bytes(path, description_of(sig, found), found, packed)
        return header_from(path, text, sig, *found[sig], {"data": path, "packed": sig if packed else None})

    @staticmethod
    def sizes(files: list[tuple[str, int]], options: dict) -> list[tuple[str, int]]:
        """Ranges are those of the samples, where an archive was unpacked."""
        unpacked = unpacked_files(options)
        return [(path, unpacked[path][1] if path in unpacked else size) for path, size in files]

    def units(self) -> tuple[int, int, int, int]:
        lay = self.header.layout
        rows = 2 if lay["bits"] == 24 else 1  # a compressed file has no places to start from
        return lay["rows"] // rows, lay["offset"], 0 if lay["packed"] else 2 * lay["width"] * rows, max(1, BLOCK_SAMPLES * 8 // (lay["width"] * rows))

    def index_range(self, part: Slice, idx: int) -> tuple[float, float]:
        return part.first, part.end

    def read(self, partition: Slice):
        lay = self.header.layout
        samples = 2 if lay["bits"] == 24 else 1
        row = 2 * lay["width"] * samples
        if lay["packed"] is None:
            blocks = iter([read_bytes(lay["data"], lay["offset"] + partition.first * row, (partition.end - partition.first) * row)])
            at = partition.first
        else:  # from the front, a block of whole rows at a time; those without a wanted sample are passed over
            blocks, at = member_blocks(self.path, lay["packed"], row * max(1, BLOCK_SAMPLES // (lay["width"] * samples))), 0
        for raw in blocks:
            part = Slice(at, at + len(raw) // row)
            at = part.end
            if self._holds_some(part):
                self._words = np.frombuffer(raw, dtype="<i2").reshape(-1, lay["width"])
                yield from super().read(part)

    def decode(self, part: Slice, idx: int) -> tuple[int, np.ndarray]:
        ch, bits = self.header.channels[idx], self.header.layout["bits"]
        x = self._words[:, ch["place"]].astype(np.int32)
        if bits == 24:
            x = (x[0::2] << 8) | (x[1::2] & 0xFF)
        scale = millivolts_per_step(bits, ch["gain"]) if ch["channel_type"] == "EMG" else 1.0
        return part.first, x * scale


class OtbSource(RecordingSource):
    """``format("otb")``: partitions are ranges of samples."""

    reader_class = OtbReader

    @classmethod
    def name(cls) -> str:
        return "otb"
