"""Queries that read and write files: made from the given tables in a scratch folder, read back by the sources, compared with SQL on the tables."""

from __future__ import annotations

import atexit
import contextlib
import gzip
import tarfile
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.adapters import with_ordinal
from .recording import Recording
from .sinks.edf import ANNOTATION_BYTES, header_bytes
from .sources.files import locate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _drop(folder: str) -> None:
    with contextlib.suppress(Exception):
        system, at = locate(folder)
        system.delete_dir(at)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares one, or a temporary one on a local master; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    system, at = locate(folder)
    system.create_dir(at)
    atexit.register(_drop, folder)
    return folder


def _join(folder: str, name: str, head: bytes, parts: Iterable[str], tail: bytes = b"") -> str:
    """One file of a head, parts in order and a tail, copied as a stream; the folder of the parts goes."""
    system, at = locate(folder)
    with system.open_output_stream(f"{at}/{name}") as out:
        out.write(head)
        for part in parts:
            with system.open_input_stream(part) as f:
                while block := f.read(4 << 20):
                    out.write(block)
        out.write(tail)
    system.delete_dir(f"{at}/parts")
    return f"{folder}/{name}"


def scratch_binary(spark: SparkSession, name: str, head: bytes, rows: DataFrame, encode: Callable[[np.ndarray], bytes], tail: bytes = b"") -> str:
    """A new file of a head, what ``encode`` makes of rows of whole numbers in order of the first column, and a tail.

    Tasks write a part each, under a name of the attempt; the driver gets one row a part.
    """
    folder = scratch_folder(spark)
    system, at = locate(folder)
    system.create_dir(f"{at}/parts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = locate(folder)
        path, first = f"{at}/parts/{uuid.uuid4().hex}", None
        with system.open_output_stream(path) as out:
            for batch in batches:
                if batch.num_rows:
                    table = np.stack([c.to_numpy() for c in batch.columns])
                    first = int(table[0, 0]) if first is None else first
                    out.write(encode(table))
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [first], "path": [path]})

    longs = rows.select(*[F.col(c).cast("long").alias(c) for c in rows.columns])
    parts = longs.orderBy(rows.columns[0]).mapInArrow(write, "first long, path string").collect()  # one row a part
    return _join(folder, name, head, [r["path"] for r in sorted(parts)], tail)


#: Label lines and the header of a text of two channels, with a repeated time column.
_TEXT_HEAD = b'Label: EMG1 Sampling frequency: 2000.0 Unit: mV Domain: time\nLabel: ACC 1 Sampling frequency: 148.1481 Unit: g Domain: time\n\nX[s],"EMG1","X[s]","ACC 1"\n'


def _text_lines(rows: DataFrame, first: str, second: str, filled: Column) -> DataFrame:
    """Lines of both channels; the second one's cell is blank but where it is filled."""
    return rows.select(F.concat_ws(",", F.lit("0"), first, F.lit("0"), F.when(filled, F.col(second).cast("string")).otherwise("")))


_US = "epoch_us(ts)"
_NUMBERED = f"n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, ({_US} - (SELECT min({_US}) FROM events)) / 1e6 AS since FROM events)"


def _samples(rec: Recording) -> DataFrame:
    return rec.signals.join(F.broadcast(rec.channels.select("channel", "channel_type", "physical_dimension", "prefilter")), "channel").where(~F.isnan("value")).select(
        "channel", "channel_type", "physical_dimension", "prefilter", "sample_index", F.round("t", 9).alias("t"), (F.round("value", 9) + F.lit(0.0)).alias("value")
    )  # a row per channel


@_query(
    f"""WITH {_NUMBERED} SELECT 'EMG1' AS channel, 'EMG' AS channel_type, 'mV' AS physical_dimension, 'n/a' AS prefilter, i AS sample_index, round(i / 2000e0, 9) AS t, round(value, 9) + 0e0 AS value FROM n
    UNION ALL SELECT 'ACC 1', 'ACC', 'g', 'n/a', i, round(i / 2000e0, 9), user_id FROM n WHERE event_type <> 'error'"""
)
def trigno_read(spark, d):
    """A text of all events: label lines, a repeated time column, and a column with blank cells."""

    rows = spark.read.parquet(f"{d}/events.parquet").orderBy("event_id")
    return _samples(Recording.from_file(spark, scratch_text(spark, "t.csv", _TEXT_HEAD, _text_lines(rows, "value", "user_id", F.col("event_type") != "error")), "trigno"))


def spark_path(folder: str) -> str:
    """A plain path is local, as it is for the readers of files; Spark needs to be told."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def scratch_text(spark: SparkSession, name: str, head: bytes, lines: DataFrame) -> str:
    """A new file of a head and the lines that tasks wrote, partition by partition, in the order of these."""
    folder = scratch_folder(spark)
    lines.write.text(f"{spark_path(folder)}/parts")
    system, at = locate(folder)
    parts = sorted(i.path for i in system.get_file_info(fs.FileSelector(f"{at}/parts")) if i.path.rsplit("/", 1)[1].startswith("part-"))
    return _join(folder, name, head, parts)


#: The first two repeat in the tables; with the others, equal rows are equal lines.
_IN_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"]
_LINES = f"WITH n AS (SELECT *, row_number() OVER (ORDER BY {", ".join(_IN_ORDER)}) - 1 AS i FROM lineitem)"
_LINES_SQL = f"""{_LINES} SELECT 'EMG1' AS channel, 'EMG' AS channel_type, 'mV' AS physical_dimension, 'n/a' AS prefilter, i AS sample_index, round(i / 2000e0, 9) AS t, round(l_extendedprice, 9) + 0e0 AS value FROM n
    UNION ALL SELECT 'ACC 1', 'ACC', 'g', 'n/a', i, round(i / 2000e0, 9), l_quantity FROM n WHERE l_returnflag <> 'R'"""


def _lines_recording(spark: SparkSession, d: str) -> Recording:
    """A text of all rows of lineitem, in order, read by ranges of a quarter of a megabyte."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").orderBy(*_IN_ORDER)
    lines = _text_lines(rows, "l_extendedprice", "l_quantity", F.col("l_returnflag") != "R")
    return Recording.from_file(spark, scratch_text(spark, "lines.csv", _TEXT_HEAD, lines), "trigno", pack_bytes=1 << 18)


@_query(_LINES_SQL)
def trigno_read_ranges(spark, d):
    """A large text in many partitions: tasks count the rows of each range, then read ranges with the ordinals of their first rows."""
    return _samples(_lines_recording(spark, d))


@_query(f"SELECT * FROM ({_LINES_SQL}) WHERE channel = 'ACC 1' AND sample_index BETWEEN 20000 AND 40000")
def trigno_read_some_ranges(spark, d):
    """A channel and a range of samples: ranges of the text without them are not opened, and other columns are not parsed."""
    return _samples(_lines_recording(spark, d).select_channels("ACC 1").between(20_000, 40_000, by="sample_index"))


def _words(bits: int) -> Callable[[np.ndarray], bytes]:
    """Sample rows of two channels from ids of events and users; with 24 bits a sample is a row of high words and one of low ones."""

    def encode(rows: np.ndarray) -> bytes:
        e, u = rows
        words = np.stack([e * 37 % 2001 - 1000, u % 100], axis=1)
        if bits == 24:
            words = np.stack([e * 91 % 65536 - 32768, u * 17 % 65536 - 32768, e * 7 % 256, u % 256], axis=1)
        return words.astype("<i2").tobytes()

    return encode


def otb_ends(size: int, bits: int) -> tuple[bytes, bytes]:
    """What an archive has before and after ``size`` bytes of samples: their entry, and that of their description."""
    xml = f"""<Device Name="Q" SampleFrequency="2000" ad_bits="{bits}" DeviceTotalChannels="2"><Channels>
    <Adapter ID="Due" Gain="200" ChannelStartIndex="0" HighPassFilter="10" LowPassFilter="500"><Channel Index="0" Muscle="TA"/></Adapter>
    <Adapter ID="Aux" ChannelStartIndex="1"><Channel Index="0" Description="Acceleration X"/></Adapter></Channels></Device>""".encode()
    entries = []
    for name, n in (("s.sig", size), ("s.xml", len(xml))):
        info = tarfile.TarInfo(name)
        info.size = n
        entries.append(info.tobuf())
    return entries[0], b"\0" * (-size % 512) + entries[1] + xml + b"\0" * (-len(xml) % 512 + 1024)


def _otb_file(spark: SparkSession, d: str, bits: int, packed: bool = False) -> str:
    """An archive of all events; a compressed one is a member for each batch of samples."""
    events = spark.read.parquet(f"{d}/events.parquet")
    encode = _words(bits)
    head, tail = otb_ends(events.count() * (8 if bits == 24 else 4), bits)
    if packed:
        head, tail = gzip.compress(head), gzip.compress(tail)
    return scratch_binary(spark, "s.otb+", head, events.select("event_id", "user_id"), (lambda rows: gzip.compress(encode(rows))) if packed else encode, tail)


def _otb(spark: SparkSession, d: str, bits: int, packed: bool = False) -> DataFrame:
    return _samples(Recording.from_file(spark, _otb_file(spark, d, bits, packed), "otb"))


def _otb_sql(bits: int, first: str, second: str) -> str:
    head = "i AS sample_index, round(i / 2000e0, 9) AS t"
    return f"""WITH {_NUMBERED} SELECT 'CH1' AS channel, 'EMG' AS channel_type, 'mV' AS physical_dimension, 'HP:10Hz LP:500Hz' AS prefilter, {head}, round(({first}) * (3.3e0 / {2**bits} * 1000) / 200, 9) + 0e0 AS value FROM n
    UNION ALL SELECT 'CH2', 'ACC', 'g', 'n/a', {head}, ({second})::DOUBLE FROM n"""


_OTB_16 = _otb_sql(16, "event_id * 37 % 2001 - 1000", "user_id % 100")


@_query(_OTB_16)
def otb_read_16(spark, d):
    return _otb(spark, d, 16)


@_query(_OTB_16)
def otb_read_compressed(spark, d):
    return _otb(spark, d, 16, True)


@_query(_OTB_16)
def otb_read_unpacked(spark, d):
    """A compressed archive that a task unpacks first, read in ranges of a sixteenth of a megabyte."""
    return _samples(Recording.from_file(spark, [_otb_file(spark, d, 16, True)], "otb", pack_bytes=1 << 16, unpack_folder=scratch_folder(spark)))


@_query(_otb_sql(24, "(event_id * 91 % 65536 - 32768) * 256 + event_id * 7 % 256", "(user_id * 17 % 65536 - 32768) * 256 + user_id % 256"))
def otb_read_24(spark, d):
    """A value is two consecutive words of its channel: the signed high one, and one whose low byte counts."""
    return _otb(spark, d, 24)


def edf_file(spark: SparkSession, d: str, bdf: bool = False, gaps: bool = False) -> str:
    """A record for each event, of one sample of each of two channels; with ``gaps`` it begins when the event did."""
    top, width, kind = (2**23, 3, b"BDF") if bdf else (2**15, 2, b"EDF")
    signal = {"dimension": "mV", "pmin": "-2.5", "pmax": "2.5", "dmin": -top, "dmax": top - 1, "samples": 1, "reserved": ""}
    heads = [signal | {"label": "EMG1", "transducer": "EMG sensor", "prefilter": "HP:20Hz LP:500Hz"}, signal | {"label": "left", "transducer": "Accelerometer", "prefilter": "", "dimension": "g"}]
    events = spark.read.parquet(f"{d}/events.parquet")
    head = header_bytes(heads, events.count(), bdf)
    if gaps:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        rows = events.select("event_id", "user_id", (us - events.agg(F.min(us)).first()[0]).alias("since"))
    else:
        rows = with_ordinal(events.select("event_id", "user_id"), [], ["event_id"], F.floor(F.col("event_id") / 65_536))

    def encode(rows: np.ndarray) -> bytes:
        e, u, at = rows
        codes = np.stack([e * 31 % (2 * top) - top, u * 1009 % (2 * top) - top], axis=1).astype("<i4").view(np.uint8).reshape(len(e), 2, 4)[:, :, :width].reshape(len(e), -1)
        onsets = [f"+{x // 1_000_000}.{x % 1_000_000:06d}" if gaps else f"+{x}" for x in at.tolist()]
        notes = [f"{o}\x14\x14\x00".encode().ljust(ANNOTATION_BYTES, b"\0") for o in onsets]
        return np.concatenate([codes, np.frombuffer(b"".join(notes), np.uint8).reshape(len(e), -1)], axis=1).tobytes()

    return scratch_binary(spark, "a.bdf" if bdf else "a.edf", head.replace(kind + b"+C", kind + b"+D") if gaps else head, rows, encode)


def _edf_sql(top: int, t: str = "i / 1e0") -> str:
    value = f"round((({{x}}) + {top}) * 5e0 / {2 * top - 1} - 2.5e0, 9) + 0e0"
    head = f"i AS sample_index, round({t}, 9) AS t"
    return f"""WITH {_NUMBERED} SELECT 'EMG1' AS channel, 'EMG' AS channel_type, 'mV' AS physical_dimension, 'HP:20Hz LP:500Hz' AS prefilter, {head}, {value.format(x=f"event_id * 31 % {2 * top} - {top}")} AS value FROM n
    UNION ALL SELECT 'left', 'ACC', 'g', 'n/a', {head}, {value.format(x=f"user_id * 1009 % {2 * top} - {top}")} FROM n"""


@_query(_edf_sql(2**15))
def edf_read(spark, d):
    return _samples(Recording.from_file(spark, edf_file(spark, d), "edf"))


@_query(_edf_sql(2**23))
def bdf_read(spark, d):
    return _samples(Recording.from_file(spark, edf_file(spark, d, bdf=True), "edf"))


_READ = _edf_sql(2**15)
_TWO_SQL = f"""SELECT a.sample_index, a.value AS emg, b.value AS acc FROM ({_READ}) a JOIN ({_READ}) b USING (sample_index)
    WHERE a.channel = 'EMG1' AND b.channel = 'left' AND a.t >= 1e2"""


@_query(_TWO_SQL)
def edf_two_channels(spark, d):
    """Two channels of one loaded table side by side: each of its scans has filters of its own."""
    signals = Recording.from_file(spark, edf_file(spark, d), "edf").signals
    one, other = (signals.where(F.col("channel") == c).select("sample_index", "t", (F.round("value", 9) + F.lit(0.0)).alias(v)) for c, v in (("EMG1", "emg"), ("left", "acc")))
    return one.where("t >= 1e2").drop("t").join(other.drop("t"), "sample_index")


def _between(rec: Recording, low: float, high: float) -> Recording:
    return rec.select_channels("left").between(low, high)


@_query(f"SELECT * FROM ({_edf_sql(2**15)}) WHERE channel = 'left' AND t BETWEEN 1e2 AND 4e2")
def edf_read_a_second(spark, d):
    """A channel and a range of time: both reach the reader."""
    return _samples(_between(Recording.from_file(spark, edf_file(spark, d), "edf"), 100.0, 400.0))


@_query(_edf_sql(2**15, "since"))
def edf_read_gaps(spark, d):
    """A discontinuous file: every event is a record with an onset of its own."""
    return _samples(Recording.from_file(spark, edf_file(spark, d, gaps=True), "edf"))


@_query(f"SELECT * FROM ({_edf_sql(2**23, 'since')}) WHERE channel = 'left' AND t BETWEEN 1e5 AND 1.5e6")
def bdf_read_gaps_a_range(spark, d):
    """Bounds on time in a discontinuous file become a range of records, found by bisection."""
    return _samples(_between(Recording.from_file(spark, edf_file(spark, d, bdf=True, gaps=True), "edf"), 1e5, 1.5e6))


@_query(
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id::VARCHAR AS recording, event_type AS channel, n AS n_written, max(n) OVER (PARTITION BY user_id) AS n_read, true AS within_a_step FROM n"""
)
def folder_round_trip(spark, d):
    """Events of each user as a recording: all written in one go, and the folder read as one table."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = with_ordinal(e, ["user_id", "event_type"], ["us", "event_id"], F.floor(F.col("us") / 3_600_000_000))
    signals = e.select(F.concat(F.lit("user-"), "user_id").alias("recording_id"), F.col("event_type").alias("channel"), F.lit(0).alias("channel_idx"), "sample_index", F.col("sample_index").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    place = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("channel"))
    channels = signals.select("recording_id", "channel").distinct().select("recording_id", "channel", (place - 1).alias("channel_idx"), F.lit("EMG").alias("channel_type"), F.lit(1.0).alias("sample_frequency"), F.lit("mV").alias("physical_dimension"), F.lit("n/a").alias("prefilter"))
    folder = scratch_folder(spark)
    Recording(spark, signals, channels).to_edf_folder(folder)
    back = Recording.from_file(spark, folder, "edf")
    name = F.regexp_extract("recording_id", r"user-(\d+)\.edf$", 1)
    steps = back.channels.select("recording_id", "channel", ((F.col("physical_max") - F.col("physical_min")) / (F.col("digital_max") - F.col("digital_min")) * 1.001 + (F.col("physical_max") - F.col("physical_min")) * 1e-5 + 1e-9).alias("step"))
    read = back.signals.join(steps, ["recording_id", "channel"]).select(name.alias("recording"), "channel", "sample_index", F.col("value").alias("read"), "step")
    was = signals.select(F.substring("recording_id", 6, 20).alias("recording"), "channel", "sample_index", "value")
    both = read.join(was, ["recording", "channel", "sample_index"], "left")
    return both.groupBy("recording", "channel").agg(
        F.count("value").alias("n_written"), F.count(F.lit(1)).alias("n_read"), F.bool_and(F.abs(F.col("read") - F.col("value")) <= F.col("step")).alias("within_a_step")
    )


def _events_recording(spark: SparkSession, d: str, factor: float) -> Recording:
    from .queries import events

    data = events(spark, d, index=True).withColumn("value", F.col("value") * F.lit(factor))
    names = sorted(r["channel"] for r in data.select("channel").distinct().collect())  # a handful of event types
    channels = spark.createDataFrame([("recording", i, c, "EMG", 1000.0, "mV", "n/a", *[None] * 9) for i, c in enumerate(names)], Recording(spark).channels.schema)
    return Recording(spark, data.join(F.broadcast(channels.select("channel", "channel_idx")), "channel"), channels)


_BACK_SQL = "SELECT event_type AS channel, 'EMG' AS channel_type, count(*) AS n, true AS within_a_step, true AS padded_to_a_second, '{kind}' AS format FROM events GROUP BY event_type"


def _there_and_back(spark: SparkSession, d: str, factor: float) -> DataFrame:
    """Limits have 8 characters in a header, so values at the ends may lie beyond them by some millionths of the range."""
    rec = _events_recording(spark, d, factor)
    path = rec.to_edf(f"{scratch_folder(spark)}/out.dat")
    back = Recording.from_file(spark, path, "edf")
    limits = back.channels.select("channel", "channel_type", ((F.col("physical_max") - F.col("physical_min")) / (F.col("digital_max") - F.col("digital_min"))).alias("step"), ((F.col("physical_max") - F.col("physical_min")) * 1e-5).alias("limit"))
    both = back.signals.select("channel", "sample_index", F.col("value").alias("read")).join(rec.signals.select("channel", "sample_index", "value"), ["channel", "sample_index"], "left").join(F.broadcast(limits), "channel")
    out = both.groupBy("channel", "channel_type").agg(
        F.count("value").alias("n"),
        F.bool_and(F.abs(F.col("read") - F.col("value")) <= F.col("step") * 1.001 + F.col("limit")).alias("within_a_step"),
        (F.count(F.lit(1)) % 1000 == 0).alias("padded_to_a_second"),
    )
    return out.withColumn("format", F.lit(path.rsplit(".", 1)[1]))


@_query(_BACK_SQL.format(kind="edf"))
def edf_round_trip(spark, d):
    """Events written as EDF+ and read back: the format choice, the writer and the reader."""
    return _there_and_back(spark, d, 1.0)


@_query(_BACK_SQL.format(kind="bdf"))
def bdf_round_trip(spark, d):
    """The same, at an amplitude that needs BDF+."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _there_and_back(spark, d, 2e4)


_STORED = """WITH n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM events),
    s AS (SELECT event_type AS channel, i AS sample_index, CASE WHEN event_type = 'error' THEN (us - min(us) OVER ()) / 1e6 WHEN event_type = 'click' THEN i / 50e0 ELSE i / 1000e0 END AS t, value::DOUBLE AS value FROM n)
    SELECT channel, sample_index, round(t, 9) AS t, value FROM s"""


def _stored_events(spark: SparkSession, d: str) -> Recording:
    """Events kept in a store: one type with the times that they have, one at a rate of its own, the others at the first one's."""
    from .queries import events

    data = events(spark, d, index=True).drop("t")
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    origin = e.agg(F.min("us")).first()[0]
    since = with_ordinal(e.where("event_type = 'error'"), ["event_type"], ["us"], F.floor(F.col("us") / 3_600_000_000)).select(F.col("event_type").alias("channel"), "sample_index", ((F.col("us") - origin) / 1e6).alias("_since"))
    names = sorted(r["channel"] for r in data.select("channel").distinct().collect())  # a handful of event types
    names.sort(key=lambda c: (c == "click", c))
    channels = spark.createDataFrame([("recording", i, c, "EMG", 50.0 if c == "click" else 1000.0, "mV", "n/a", *[None] * 9) for i, c in enumerate(names)], Recording(spark).channels.schema)
    timed = data.join(since, ["channel", "sample_index"], "left").join(F.broadcast(channels.select("channel", "channel_idx", "sample_frequency")), "channel")
    timed = timed.withColumn("t", F.coalesce("_since", F.col("sample_index") / F.col("sample_frequency"))).drop("_since", "sample_frequency")
    return Recording.from_store(spark, Recording(spark, timed, channels).to_store(f"{spark_path(scratch_folder(spark))}/store"))


def _stored_rows(rec: Recording) -> DataFrame:
    return rec.signals.select("channel", "sample_index", F.round("t", 9).alias("t"), "value")


@_query(_STORED)
def store_round_trip(spark, d):
    """All events kept in Parquet by channel and time, and read back: times that follow a rate are not stored."""
    return _stored_rows(_stored_events(spark, d))


@_query(f"SELECT * FROM ({_STORED}) WHERE channel IN ('click', 'error') AND t BETWEEN 2e0 AND 2e5")
def store_between(spark, d):
    """Two channels and a range of time: bounds on sample_index for each rate, and on the times that are stored, reach the scan."""
    return _stored_rows(_stored_events(spark, d).select_channels(["click", "error"]).between(2.0, 2e5))
