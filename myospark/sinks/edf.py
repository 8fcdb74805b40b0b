"""EDF+ and BDF+ writer: ``df.write.format("edf")`` over placed samples, for one recording or many in one write.

Two scans of the samples: figures for each channel, then codes. A code knows its file, its part (some records of the
file, PART_BYTES or one record) and its slot in that part, so tasks put codes where they belong and need no order within
a part. Memory is one part, however many channels there are. Every attempt of a task writes files of its own; the commit
takes those of the winners, moves or joins them into place, and drops the rest. What is done is told to the logger of this module.
"""

from __future__ import annotations

import json
import logging
import os
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..functions.rules import to_digital
from ..operators.analysis import CHANNEL_ROWS, KEYS, analysis_of, channel_stats, digital_code, file_format, known_rows, scaling, suitability, summary_text, type_summary
from ..sources.edf import SIGNAL_FIELDS
from ..sources.files import locate
from .tsv import edf_header_fields, tsv_text

#: Bytes of a part (at least one record), and parts that one task writes in a row to one attempt file.
PART_BYTES, PARTS_IN_A_ROW = 4 << 20, 16
LOG = logging.getLogger(__name__)


def _field(text: object, width: int) -> bytes:
    return str(text).encode("latin-1", "replace")[:width].ljust(width)


def _number(value: float) -> str:
    """A number in at most 8 characters."""
    for digits in range(12, 0, -1):
        text = f"{value:.{digits}g}"
        if len(text) <= 8:
            return text
    raise ValueError(f"{value} does not fit a header field")


def header_bytes(signals: list[dict], records: int, bdf: bool, duration: float = 1.0) -> bytes:
    """The main header and the signals' headers, with the annotation signal that the plus variants need as the last one."""
    kind = "BDF" if bdf else "EDF"
    notes = {"label": f"{kind} Annotations", "transducer": "", "dimension": "", "pmin": "-1", "pmax": "1", "dmin": signals[0]["dmin"], "dmax": signals[0]["dmax"], "prefilter": "", "samples": ANNOTATION_BYTES // (3 if bdf else 2), "reserved": ""}
    full = [*signals, notes]
    main = (
        (b"\xffBIOSEMI" if bdf else _field("0", 8)) + _field("X X X X", 80) + _field("Startdate 01-JAN-1985 X X X", 80) + _field("01.01.85", 8) + _field("00.00.00", 8)
        + _field(256 * (len(full) + 1), 8) + _field(f"{kind}+C", 44) + _field(records, 8) + _field(f"{duration:g}", 8) + _field(len(full), 4)
    )
    return main + b"".join(_field(s[name], width) for name, width in SIGNAL_FIELDS for s in full)


ANNOTATION_BYTES = 60  # a multiple of 2 and 3


def _annotation(record: int, duration: float) -> bytes:
    return f"+{record * duration:g}\x14\x14\x00".encode().ljust(ANNOTATION_BYTES, b"\x00")


LAYOUT = (
    "recording_id string, channel string, channel_idx int, channel_type string, physical_dimension string, is_zero boolean, range double, dynamic_range_db double, snr_db double, use_bdf boolean, file_bdf boolean, bdf_reason string, "
    "physical_min double, physical_max double, digital_min int, digital_max int, rate int, at int, size int, records_in_part int, parts long, spec string, tsv string, error string"
)


LAYOUT_NAMES = [c.split()[0] for c in LAYOUT.split(", ")]
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
LAYOUT_SCHEMA = pa.schema([(n, _ARROW_TYPES[t]) for n, t in (c.split() for c in LAYOUT.split(", "))])


def lay_out(rows: list[dict], part_bytes: int = PART_BYTES) -> list[dict]:
    """The file of one recording, from its channels' rows in order: limits as the header has them, places in a record, and what a part needs."""
    bdf = bool(rows[0]["file_bdf"])
    limits = [[_number(v) if v is not None and v == v else "nan" for v in (r["physical_min"], r["physical_max"])] for r in rows]
    out = [
        {n: r.get(n) for n in LAYOUT_NAMES} | {"physical_min": float(low), "physical_max": float(high), "rate": int(r["sample_frequency"] or 0), "spec": None, "tsv": None, "error": None}
        for r, (low, high) in zip(rows, limits, strict=True)
    ]
    for wrong, what in (
        ([r["has_nan"] is None or bool(r["has_nan"]) for r in rows], "channels with missing samples cannot be written"),
        ([o["physical_min"] == o["physical_max"] for o in out], "the physical range vanishes in 8 characters"),
        ([o["rate"] < 1 for o in out], "the rate is below 1"),
    ):
        if any(wrong):
            error = f"{what}: {[r['channel'] for r, w in zip(rows, wrong, strict=True) if w]}"
            for o in out:
                o.update({"error": error, "rate": 0, "at": 0, "size": 0, "records_in_part": 0, "parts": 0})
            return out
    size = sum(o["rate"] for o in out)
    width = 3 if bdf else 2
    records = max(-(-int(r["length"]) // o["rate"]) for r, o in zip(rows, out, strict=True))
    in_part = max(1, part_bytes // (width * size))
    heads, channels, at = [], [], 0
    for r, o, (low, high) in zip(rows, out, limits, strict=True):
        o.update({"at": at, "size": size, "records_in_part": in_part, "parts": -(-records // in_part)})
        place = np.rint(to_digital(r["last"], o["physical_min"], o["physical_max"], r["digital_min"], r["digital_max"]))
        channels.append([at, o["rate"], int(r["digital_min"]), int(min(max(place, r["digital_min"]), r["digital_max"]))])
        heads.append({"label": r["label"], "transducer": r["transducer"], "dimension": r["dimension"], "pmin": low, "pmax": high, "dmin": r["digital_min"], "dmax": r["digital_max"], "prefilter": r["prefilter"], "samples": o["rate"], "reserved": ""})
        at += o["rate"]
    out[0]["spec"] = json.dumps({"header": header_bytes(heads, records, bdf).decode("latin-1"), "records": records, "in_part": in_part, "width": width, "size": size, "channels": channels})
    out[0]["tsv"] = tsv_text(rows)
    return out


def laid_out(batches: Iterator[pa.RecordBatch], part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of channels, sorted by recording and place, to LAYOUT: a batch holds many recordings, as a folder may have very many of a few channels."""
    held: list[dict] = []
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if held and held[0]["recording_id"] != row["recording_id"]:
                out += lay_out(held, part_bytes)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=LAYOUT_SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist(lay_out(held, part_bytes), schema=LAYOUT_SCHEMA)


class Part:
    """The codes of some records, put in place as they come."""

    def __init__(self, spec: dict, part: int) -> None:
        self.spec, self.first = spec, part * spec["in_part"]
        self.records = min(spec["in_part"], spec["records"] - self.first)
        self.codes = np.zeros(self.records * spec["size"], dtype=np.int32)
        self.known = np.zeros(len(self.codes), dtype=bool)

    def put(self, slots: np.ndarray, codes: np.ndarray) -> None:
        self.codes[slots], self.known[slots] = codes, True

    def _fill(self) -> None:
        """A missing sample repeats the one before; before the first one it is the digital minimum, and in a part without any the channel's last."""
        codes, known = self.codes.reshape(self.records, -1), self.known.reshape(self.records, -1)
        for at, rate, low, last in self.spec["channels"]:
            there = known[:, at : at + rate].ravel()
            if not there.all():
                before = np.maximum.accumulate(np.where(there, np.arange(len(there)), -1))
                own = codes[:, at : at + rate].ravel()
                codes[:, at : at + rate] = np.where(before < 0, low if there.any() else last, own[before]).reshape(self.records, rate)

    def body(self) -> bytes:
        """The part's bytes: records of all signals, each with its time-keeping annotation; the file's header before the first."""
        if not self.known.all():
            self._fill()
        coded = self.codes.astype("<i4").view(np.uint8).reshape(self.records, self.spec["size"], 4)[:, :, : self.spec["width"]].reshape(self.records, -1)
        notes = np.stack([np.frombuffer(_annotation(k, 1.0), np.uint8) for k in range(self.first, self.first + self.records)])
        return (self.spec["header"].encode("latin-1") if self.first == 0 else b"") + np.concatenate([coded, notes], axis=1).tobytes()


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: name of the file, first part, number of parts, and where."""

    runs: list[tuple[str, int, int, str]] = field(default_factory=list)


class EdfWriter(DataSourceArrowWriter):
    """Writes rows of ``placed_samples``, dealt so that a part is whole in its task and its row with a spec comes first."""

    def __init__(self, folder: str, staging: str, overwrite: bool) -> None:
        self.folder, self.staging, self.overwrite = folder, staging, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, now, part, out = Written(), None, None, None
        system, at = locate(self.staging)
        system.create_dir(at, recursive=True)

        def finish() -> None:
            if now is not None:
                out.write(part if isinstance(part, bytes) else part.body())

        try:
            for batch in iterator:
                names = pc.dictionary_encode(batch.column("file"))
                key = names.indices.to_numpy(), batch.column("part").to_numpy()
                change = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]))
                slots, codes = batch.column("slot").to_numpy(), batch.column("digital").to_numpy()
                for a, b in zip(change.tolist(), [*change[1:].tolist(), batch.num_rows], strict=True):
                    one = names.dictionary[int(key[0][a])].as_py(), int(key[1][a])
                    if one != now:
                        finish()
                        spec = batch.column("spec")[a]
                        if not spec.is_valid:
                            raise ValueError(f"part {one[1]} of {one[0]} does not begin with its spec: write rows of placed_samples")
                        if now is None or now[0] != one[0] or now[1] + 1 != one[1]:
                            if out is not None:
                                out.close()
                            path = f"{at}/{uuid.uuid4().hex}"
                            out = system.open_output_stream(path)
                            done.runs.append((*one, 0, path))
                        done.runs[-1] = (*done.runs[-1][:2], done.runs[-1][2] + 1, done.runs[-1][3])
                        told = json.loads(spec.as_py())
                        now, part, a = one, told["raw"].encode() if "raw" in told else Part(told, one[1]), a + 1
                    if b > a:
                        part.put(slots[a:b], codes[a:b])
            finish()
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Put the winners' files into place: a file of one run is moved, one of several is joined in order."""
        runs: dict[str, list[tuple[int, int, str]]] = {}
        for message in messages:
            for name, first, n, path in message.runs if message else []:
                runs.setdefault(name, []).append((first, n, path))
        source, staged = locate(self.staging)
        target, folder = locate(self.folder)
        made: set[str] = set()
        try:
            for name, own in runs.items():
                at = f"{folder.rstrip('/')}/{name}"
                own.sort()
                if [r[0] for r in own] != list(np.cumsum([0, *[r[1] for r in own[:-1]]])):
                    raise ValueError(f"parts of {name} are missing")
                if not self.overwrite and target.get_file_info(at).type != fs.FileType.NotFound:
                    raise FileExistsError(f"{name} is there already")
                if os.path.dirname(at) not in made:
                    made.add(os.path.dirname(at))
                    target.create_dir(os.path.dirname(at), recursive=True)
                if len(own) == 1 and type(source) is type(target):
                    source.move(own[0][2], at)
                    continue
                with target.open_output_stream(at) as out:
                    for _, _, path in own:
                        with source.open_input_stream(path) as f:
                            while block := f.read(1 << 24):
                                out.write(block)
            LOG.info("Wrote %d files to %s", len(runs), self.folder)
        finally:
            self._drop(source, staged)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*locate(self.staging))

    @staticmethod
    def _drop(system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def _settled(rows: DataFrame, folder: str) -> DataFrame:
    """Per-channel rows, computed once: on the driver up to CHANNEL_ROWS, else as a table beside the staging folder, which stays for the caller."""
    rows = rows.persist()
    try:
        if rows.count() <= CHANNEL_ROWS:
            return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)
        rows.write.parquet(f"{folder}-layout")
    finally:
        rows.unpersist()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}-layout")


def planned_files(signals: DataFrame, channels: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per channel of each recording: figures, the file's format, limits and place (LAYOUT). The samples are reduced once."""
    fields = edf_header_fields(channels, KEYS).drop("sample_frequency", "prefilter", "channel_idx")
    info = channels.select(*KEYS, "channel_idx", "channel_type", "sample_frequency", "physical_dimension", "prefilter").join(fields, KEYS)
    suited = suitability(analysis_of(channel_stats(signals, ends=True))).join(info, KEYS)
    formats = file_format(suited).withColumnRenamed("use_bdf", "file_bdf")
    both = suited.join(formats, "recording_id")
    scaled = scaling(both, F.when(F.col("file_bdf"), 24).otherwise(16), rounded=True)
    # rows of channels are few bytes, and much work: without a number, adaptive execution puts all recordings into one task
    tasks = max(int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions")), scaled.sparkSession.sparkContext.defaultParallelism)
    return scaled.repartition(tasks, "recording_id").sortWithinPartitions("recording_id", "channel_idx").mapInArrow(lambda batches: laid_out(batches, part_bytes), LAYOUT)


def placed_samples(signals: DataFrame, layout: DataFrame) -> DataFrame:
    """What ``format("edf")`` writes: file, part, slot, digital and, in a row of its own before a part's codes, spec.

    ``layout`` has LAYOUT and file, the name without its extension.
    """
    ending = F.concat("file", F.when(F.col("file_bdf"), ".bdf").otherwise(".edf"))
    places = layout.select(*KEYS, ending.alias("file"), "physical_min", "physical_max", "digital_min", "digital_max", "rate", "at", "size", "records_in_part")
    record = F.floor(F.col("sample_index") / F.col("rate"))
    slot = (record % F.col("records_in_part")) * F.col("size") + F.col("at") + F.col("sample_index") % F.col("rate")
    codes = signals.join(known_rows(places), KEYS).select("file", F.floor(record / F.col("records_in_part")).cast("long").alias("part"), slot.cast("int").alias("slot"), digital_code().alias("digital"), F.lit(None).cast("string").alias("spec"))
    heads = layout.where("spec is not null")
    blank = F.lit(0).alias("slot"), F.lit(0).alias("digital")
    starts = heads.select(ending.alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *blank, "spec")
    texts = heads.select(F.concat("file", F.lit("_channels.tsv")).alias("file"), F.lit(0).cast("long").alias("part"), *blank, F.to_json(F.struct(F.col("tsv").alias("raw"))).alias("spec"))
    rows = codes.unionByName(starts).unionByName(texts)
    return rows.repartition("file", F.floor(F.col("part") / PARTS_IN_A_ROW)).sortWithinPartitions("file", "part", F.col("spec").isNull())


def staging_folder(signals: DataFrame, folder: str) -> str:
    """Where tasks and driver meet: the folder that the cluster shares, else one within the target."""
    shared = signals.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared and ("://" not in folder and not signals.sparkSession.sparkContext.master.startswith("local")):
        raise ValueError("name a folder that driver and executors share: set spark.checkpoint.dir, or write to a URI")
    return f"{(shared or folder).rstrip('/')}/_parts-{uuid.uuid4().hex}"


def export_recordings(signals: DataFrame, channels: DataFrame, folder: str, name: Column | None = None, overwrite: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write every recording as EDF+, or BDF+ if a channel of it needs that, and its channels.tsv; one row per channel comes back.

    ``name`` is the file's name without an extension, from recording_id; by default the last part of the id without its
    extension. Two recordings of one name are an error, and so are NaN samples, channels without samples and rates below 1.
    Rates are whole numbers in the file; a data record is a second, and the last one is padded with each channel's last value.
    """
    staging = staging_folder(signals, folder)
    own = F.regexp_extract("recording_id", r"([^/]+?)(\.[^./]*)?$", 1) if name is None else name
    layout = _settled(planned_files(signals, channels, part_bytes).withColumn("file", own), staging)
    wrong = layout.where("error is not null").first()
    if wrong:
        raise ValueError(wrong["error"])
    twice = layout.groupBy("file").agg(F.count_distinct("recording_id").alias("n")).where("n > 1 or file = ''").first()
    if twice:
        raise ValueError(f"{twice['n']} recordings would be written to one file: {twice['file']}")
    placed_samples(signals, layout).write.format("edf").mode("overwrite" if overwrite else "append").option("staging", staging).save(folder)
    return layout


def export_edf(signals: DataFrame, channels: DataFrame, filepath: str, precision_threshold: float = 0.01) -> str:
    """Write one recording; returns the path written. The extension is replaced by that of the format.

    ``precision_threshold`` is accepted and not used.
    """
    stem = os.path.splitext(filepath)[0] if os.path.splitext(filepath)[1] else filepath
    folder, name = stem.rsplit("/", 1) if "/" in stem else (".", stem)
    if channels.limit(1).count() == 0:
        raise ValueError("No signals loaded")
    layout = export_recordings(signals, channels, folder or "/", F.lit(name))
    first = layout.where("spec is not null").first()
    if first is None:
        raise ValueError("No signals loaded")
    target = stem + (".bdf" if first["file_bdf"] else ".edf")
    if first["file_bdf"]:
        warnings.warn(f"Using BDF format to preserve precision. Reason: {first['bdf_reason']}", stacklevel=2)
    LOG.info("Signal analysis:%s", summary_text(type_summary(layout)))
    LOG.info("Wrote %s with %d channels", target, layout.count())
    return target
