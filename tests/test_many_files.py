"""Folders of recordings, discontinuous files, and the writer as a data source."""

import csv
import io
import json
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from myospark.recording import Recording
from myospark.schema import CHANNELS
from myospark.sinks import edf as sink
from myospark.sinks.edf import ANNOTATION_BYTES, header_bytes
from myospark.sources import base
from myospark.sources.edf import EdfReader, RecordClock, parse_header
from myospark.sources.files import list_files
from myospark.sources.trigno import TrignoReader, line_blocks


def sessions(spark, n, channels=2, samples=2500, rate=1000.0):
    """n recordings of sines and ramps, of different lengths."""
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("recording_id"), (F.lit(samples) + F.col("id") * 10).alias("m"), "id")
    rows = rows.select("recording_id", "id", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel_idx"), "m")
    rows = rows.select("recording_id", "channel_idx", F.concat(F.lit("EMG"), "channel_idx").alias("channel"), "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("sample_index"))
    signals = rows.select("recording_id", "channel_idx", "channel", "sample_index", (F.col("sample_index") / rate).alias("t"), (F.sin(F.col("sample_index") / 7) * 5 + F.col("id") + F.col("channel_idx")).alias("value"))
    chans = [(f"s{i}", c, f"EMG{c}", "EMG", rate, "mV", "n/a", *[None] * 9) for i in range(n) for c in range(channels)]
    return Recording(spark, signals, spark.createDataFrame(chans, CHANNELS))


def test_many_recordings_there_and_back(spark, tmp_path):
    rec = sessions(spark, 12)
    layout = rec.to_edf_folder(str(tmp_path / "out"))
    assert {r["file"] for r in layout.collect()} == {f"s{i}" for i in range(12)}
    assert sorted(os.listdir(tmp_path / "out")) == sorted([f"s{i}.edf" for i in range(12)] + [f"s{i}_channels.tsv" for i in range(12)])
    back = Recording.from_file(spark, str(tmp_path / "out"), "edf")
    assert back.channels.count() == 24 and back.channels.select("recording_id").distinct().count() == 12
    assert {r["value"] for r in back.metadata.where("key = 'number_of_signals'").collect()} == {"2"}
    name = F.regexp_extract("recording_id", r"([^/]+)\.edf$", 1)
    both = back.signals.withColumn("recording_id", name).join(rec.signals.withColumnRenamed("value", "was").drop("t", "channel_idx"), ["recording_id", "channel", "sample_index"])
    assert both.count() == rec.signals.count()
    assert both.agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] < 12 / 65535
    one = Recording.from_file(spark, str(tmp_path / "out" / "s3.edf"), "edf")
    assert one.signals.orderBy("channel", "sample_index").collect() == back.signals.where(F.col("recording_id").endswith("/s3.edf")).orderBy("channel", "sample_index").collect()
    assert back.select_channels(channel_type="EMG").signals.count() == back.signals.count()


def test_names_of_files(tmp_path):
    for name in ("a.edf", "b.BDF", "c.csv", ".d.edf", "_e/f.edf", "g/h.edf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    short = lambda found: [(os.path.relpath(p, tmp_path), n) for p, n in found]
    assert short(list_files(str(tmp_path), EdfReader.extensions)) == [("a.edf", 5), ("b.BDF", 5), ("g/h.edf", 7)]
    assert short(list_files(f"{tmp_path}/*.edf", ())) == [(".d.edf", 6), ("a.edf", 5)]
    assert short(list_files([f"{tmp_path}/c.csv", f"{tmp_path}/?/*"], ())) == [("c.csv", 5), ("g/h.edf", 7)]
    with pytest.raises(FileNotFoundError):
        list_files(f"{tmp_path}/*.otb", ())


def test_packs_are_even_and_headers_stay_unread(spark, tmp_path, monkeypatch):
    sessions(spark, 6).to_edf_folder(str(tmp_path / "o"))
    files = list_files(str(tmp_path / "o"), EdfReader.extensions)
    monkeypatch.setattr(EdfReader, "read_header", staticmethod(lambda path, options=None: pytest.fail("a header was read on the driver")))
    reader = base.FolderReader(EdfReader, files, {"packbytes": "9000", "opencost": "100"})
    packs = reader.partitions()
    assert sorted(r for p in packs for r in p.ranges) == sorted((path, a, min(a + 9000, n)) for path, n in files for a in range(0, n, 9000))
    assert max(sum(b - a + 100 for _, a, b in p.ranges) for p in packs) <= 9100 and len(packs) < sum(len(p.ranges) for p in packs)
    reader = base.FolderReader(EdfReader, files, {"packbytes": "9000", "recordings": json.dumps([files[2][0]])})
    assert {r[0] for p in reader.partitions() for r in p.ranges} == {files[2][0]}


@pytest.mark.parametrize("size", [3000, 5000, 10**6])
def test_byte_ranges_cover_every_record_once(spark, tmp_path, size):
    sessions(spark, 3).to_edf_folder(str(tmp_path / "o"))
    whole = Recording.from_file(spark, f"{tmp_path}/o/*.edf", "edf").signals
    cut = spark.read.format("edf").option("packbytes", size).load(str(tmp_path / "o"))
    order = ["recording_id", "channel", "sample_index"]
    assert cut.orderBy(*order).collect() == whole.orderBy(*order).collect()
    assert cut.where("channel = 'EMG1' and t >= 1.5 and t < 1.6").count() == 300


def test_a_broken_file_is_an_error(spark, tmp_path):
    sessions(spark, 2).to_edf_folder(str(tmp_path / "o"))
    (tmp_path / "o" / "z.edf").write_bytes(b"nothing")
    with pytest.raises(Exception, match="shorter than a header"):
        Recording.from_file(spark, str(tmp_path / "o"), "edf").signals.count()


def gapped(path, onsets, bdf=False, notes=True):
    """A discontinuous file of one channel at 4 Hz; sample k has the code k."""
    kind = "BDF" if bdf else "EDF"
    sig = {"label": "EMG1", "transducer": "", "dimension": "mV", "pmin": "0", "pmax": "1000", "dmin": 0, "dmax": 1000, "prefilter": "", "samples": 4, "reserved": ""}
    head = header_bytes([sig], len(onsets), bdf).replace(f"{kind}+C".encode(), f"{kind}+D".encode())
    body = b""
    for k, onset in enumerate(onsets):
        body += b"".join(int(4 * k + i).to_bytes(3 if bdf else 2, "little") for i in range(4))
        body += (f"+{onset}\x14\x14\x00+{onset}\x15{1}\x14note\x14\x00" if notes else "").encode().ljust(ANNOTATION_BYTES, b"\x00")
    path.write_bytes(head + body)
    return str(path)


ONSETS = [0.25, 1.25, 7.5, 8.5, 100, 3600.125]


@pytest.mark.parametrize("bdf", [False, True])
def test_times_of_a_discontinuous_file(spark, tmp_path, bdf):
    rec = Recording.from_file(spark, gapped(tmp_path / "d.edf", ONSETS, bdf), "edf")
    rows = rec.signals.orderBy("sample_index").collect()
    assert [r["t"] for r in rows] == [o + i / 4 for o in ONSETS for i in range(4)]
    assert [r["value"] for r in rows] == pytest.approx(range(24))
    assert [r["sample_index"] for r in rec.signals.where("t between 7.75 and 100.3").orderBy("t").collect()] == list(range(9, 18))
    assert rec.signals.where("t > 8.5 and sample_index < 20").count() == 7


def test_bounds_on_time_choose_records(tmp_path, monkeypatch):
    from myospark.sources import edf as source

    monkeypatch.setattr(source, "BLOCK_SAMPLES", 1)
    path = gapped(tmp_path / "d.edf", [k * 10 for k in range(1000)])
    for low, high in ((5000.0, 5020.0), (-5.0, 0.5), (1e9, 2e9), (9990.5, 1e9)):
        reader = EdfReader(path, {"fromtime": str(low), "totime": str(high)})
        want = {k for k in range(1000) if k * 10 + 0.75 >= low and k * 10 <= high}
        got = [k for p in reader.partitions() for k in range(p.first, p.end)]
        assert want <= set(got) and len(got) <= len(want) + 2
    clock = RecordClock(path, EdfReader.read_header(path).layout)
    assert clock.first_from(5000) == 501 and len(clock.known) <= 11


def test_a_record_without_its_time_is_an_error(spark, tmp_path):
    rec = Recording.from_file(spark, gapped(tmp_path / "d.edf", ONSETS, notes=False), "edf")
    with pytest.raises(Exception, match="does not say when it begins"):
        rec.signals.count()


def test_parts_in_several_tasks_make_one_file(spark, tmp_path, monkeypatch):
    rec = sessions(spark, 2, channels=3, samples=9500)
    plain = rec.to_edf_folder(str(tmp_path / "a"))
    monkeypatch.setattr(sink, "PARTS_IN_A_ROW", 2)
    layout = rec.to_edf_folder(str(tmp_path / "b"), part_bytes=7000)
    assert plain.first()["parts"] == 1 and layout.first()["parts"] == 10
    for name in os.listdir(tmp_path / "a"):
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes()


def test_memory_of_a_part_does_not_grow_with_channels():
    import tracemalloc

    def peak(channels, rate=2000):
        size = channels * rate
        spec = {"header": "", "records": 1000, "in_part": max(1, sink.PART_BYTES // (2 * size)), "width": 2, "size": size, "channels": [[c * rate, rate, 0, 0] for c in range(channels)]}
        tracemalloc.start()
        part = sink.Part(spec, 0)
        part.put(np.arange(0, len(part.codes), 2), np.ones(-(-len(part.codes) // 2), dtype=np.int32))
        part.body()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top / 1e6

    assert peak(64) < 100 and peak(512) < 100


def test_names_that_meet_and_targets_that_are_there(spark, tmp_path):
    rec = sessions(spark, 2)
    with pytest.raises(ValueError, match="one file"):
        rec.to_edf_folder(str(tmp_path / "o"), name=F.lit("same"))
    rec.to_edf_folder(str(tmp_path / "o"))
    with pytest.raises(Exception, match="is there already"):
        rec.to_edf_folder(str(tmp_path / "o"), overwrite=False)
    with pytest.raises(Exception, match="placed_samples"):
        rec.signals.write.format("edf").mode("append").save(str(tmp_path / "o"))


RETRY = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from tests.test_many_files import sessions
from myospark.sinks import edf as sink
from myospark.sources.registry import register

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://{tmp}/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
register(spark)
rec = sessions(spark, 4)
layout = sink._settled(sink.planned_files(rec.signals, rec.channels).withColumn("file", F.col("recording_id")), "{tmp}/x")
placed = sink.placed_samples(rec.signals, layout)
def flaky(batches):
    yield from batches
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost after all was handed on")
placed.mapInArrow(flaky, placed.schema).write.format("edf").mode("overwrite").option("staging", "{tmp}/shared/p").save("{tmp}/out")
print(sorted(__import__("os").listdir("{tmp}/out")), [n for n in __import__("os").listdir("{tmp}/shared") if n == "p"])
"""


def test_a_write_survives_a_lost_task(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(RETRY).format(root=root, tmp=tmp_path)
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip() == f"{sorted([f's{i}.edf' for i in range(4)] + [f's{i}_channels.tsv' for i in range(4)])} []", run.stderr[-2000:]
    sessions(spark, 4).to_edf_folder(str(tmp_path / "plain"))
    for name in os.listdir(tmp_path / "plain"):
        assert (tmp_path / "plain" / name).read_bytes() == (tmp_path / "out" / name).read_bytes()
    assert parse_header(str(tmp_path / "out" / "s0.edf"))["records"] == 3


LABELS = "Label: EMG1 Sampling frequency: 2000.0 Unit: mV Domain: time\nLabel: ACC 1 Sampling frequency: 148.1481 Unit: g Domain: time\n\nX[s],\"EMG1\",\"X[s]\",\"ACC 1\"\n"


def row_by_row(text):
    """Samples of a text, by the csv module over the whole of it."""
    rows = list(csv.reader(io.StringIO(text[len(LABELS) :])))
    rows = [r for r in rows if any(c.strip() for c in r)]
    return [(i, *(float(r[at]) if at < len(r) and r[at].strip() else None for at in (1, 3))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("time_base", ["shared", "channel"])
def test_texts_by_ranges(spark, tmp_path, end, time_base):
    lines = []
    for i in range(300):
        lines.append(f"{i},{i * 0.5 - 3},{i},{'' if i % 7 == 0 or i > 230 else i}")
        if i % 50 == 3:
            lines += ["", " , ,,", '"","","",""']
        if i % 90 == 5:
            lines += [f"{i},1e3", f'{i},"{i}",0,+7.5,9,9', f" {i} , {i} ,0, 4"]
    text = LABELS + end.join(lines)
    p = tmp_path / "a.csv"
    p.write_bytes(b"\xef\xbb\xbf" + text.encode())
    want = row_by_row(text)
    lasts = [len(want)] * 2 if time_base == "shared" else [max(i for i, *v in want if v[k] is not None) + 1 for k in range(2)]
    for most in (1 << 20, 500, 120):
        rec = Recording.from_file(spark, str(p), "trigno", time_base, pack_bytes=most)
        if most == 500:
            assert rec.signals.rdd.getNumPartitions() > 5
        for k, name in enumerate(("EMG1", "ACC 1")):
            got = [(r[0], None if np.isnan(r[1]) else r[1]) for r in rec.signals.where(F.col("channel") == name).orderBy("sample_index").select("sample_index", "value").collect()]
            assert got == [(i, v[k]) for i, *v in want][: lasts[k]]
        if most > 120:
            (tmp_path / f"f{most}").mkdir()
            (tmp_path / f"f{most}" / "b.csv").write_bytes(p.read_bytes())
            (tmp_path / f"f{most}" / "c.csv").write_text(LABELS + "0,1,0,2")
            both = Recording.from_file(spark, str(tmp_path / f"f{most}"), "trigno", time_base, pack_bytes=most).signals
            assert both.where(F.col("recording_id").endswith("b.csv")).drop("recording_id").exceptAll(rec.signals.drop("recording_id")).count() == 0
            assert both.count() == rec.signals.count() + 2


def test_ranges_of_a_text_that_bounds_leave(tmp_path):
    p = str(tmp_path / "a.csv")
    with open(p, "w") as f:
        f.write(LABELS + "".join(f"0,{i},0,1\n" for i in range(1000)))
    counts = json.dumps({p: {"begin": [0, 1000, 5000], "rows": [100, 500, 400], "lengths": [1000, 1000]}})
    reader = TrignoReader(p, {"rowcounts": counts})
    assert [(s.first, s.last) for s in reader.within()] == [(0, 100), (100, 600), (600, 1000)]
    reader = TrignoReader(p, {"rowcounts": counts, "fromsample": "200", "totime": "0.25"})
    assert [(s.first, s.last) for s in reader.within()] == [(100, 600)]


def test_a_line_break_within_quotes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(LABELS + '0,"1\n2",0,1\n')
    with pytest.raises(Exception, match="line break within quotes"):
        Recording.from_file(spark, str(p)).signals.count()
    with pytest.raises(Exception, match="line break within quotes"):
        Recording.from_file(spark, str(p), pack_bytes=len(LABELS)).signals.count()


def test_lines_longer_than_a_block(tmp_path):
    p = tmp_path / "a.csv"
    lines = [b"a" * n + b"\n" for n in (3, 50, 0, 7, 200, 1)] + [b"end"]
    p.write_bytes(b"".join(lines))
    size = p.stat().st_size
    for most in (1, 5, 64, 1000):
        for block in (4, 33, 1000):
            got = [b"".join(line_blocks(str(p), a, min(size, a + most), block)) for a in range(0, size, most)]
            assert b"".join(got) == b"".join(lines)
            assert all(not g or g.endswith((b"\n", b"end")) for g in got)


@pytest.mark.parametrize(("kind", "pack"), [("trigno", 600), ("edf", 1 << 20)])
def test_scans_of_one_table_do_not_narrow_each_other(spark, tmp_path, kind, pack):
    """Filters, joins and unions over one recording, and parts of it, in any order."""
    if kind == "edf":
        sessions(spark, 1, samples=3000).to_edf_folder(str(tmp_path / "o"))
        p, names, n = str(tmp_path / "o" / "s0.edf"), ("EMG0", "EMG1"), 3000
    else:
        p, names, n = str(tmp_path / "a.csv"), ("EMG1", "ACC 1"), 500
        (tmp_path / "a.csv").write_text(LABELS + "".join(f"0,{i},0,{-i}\n" for i in range(n)))
    rec = Recording.from_file(spark, p, kind, pack_bytes=pack)
    a, b = (rec.signals.where(F.col("channel") == c) for c in names)
    early = rec.signals.where("sample_index < 10")
    each = lambda df: {r["channel"]: r["count"] for r in df.groupBy("channel").count().collect()}
    for _ in range(2):
        assert (a.count(), b.count(), early.count(), rec.signals.count()) == (n, n, 20, 2 * n)
        assert each(a.unionByName(b)) == dict.fromkeys(names, n) == each(rec.signals)
        assert each(early.unionByName(a)) == {names[0]: n + 10, names[1]: 10}
        assert a.select("sample_index").join(b.where("sample_index >= 7").select("sample_index"), "sample_index").count() == n - 7
    part = rec.select_channels(names[1]).between(5, 20, by="sample_index")
    late = part.between(10, 1000, by="sample_index").between(0.0)
    assert (part.signals.count(), late.signals.count(), rec.signals.count()) == (16, 11, 2 * n)
    assert part.select_channels([names[1]]).signals.count() == 16
    t = late.signals.agg(F.min("t"), F.max("t")).first()
    assert rec.between(t[0], t[1]).signals.count() == 22 and rec.between().signals.count() == 2 * n
    assert rec.plot_frame([names[0]], time_range=(t[0], t[1])).count() == 11
    both = rec.select_channels(list(names))
    both.select_channels(names[0], inplace=True)
    assert each(both.signals) == {names[0]: n} and each(both.between(high=3, by="sample_index").signals) == {names[0]: 4}
    rec.signals = rec.signals.where("sample_index < 3")
    assert rec.select_channels(names[0]).signals.count() == 3
    with pytest.raises(ValueError, match="by t or by sample_index"):
        rec.between(0, 1, by="value")


@pytest.mark.parametrize("name", ["trigno_read", "edf_read", "bdf_read_gaps_a_range", "edf_two_channels", "otb_read_24", "otb_read_unpacked"])
def test_rows_of_files_do_not_pass_the_driver(spark, monkeypatch, name):
    """Files of all events are made by tasks: the driver gets a row a part."""
    from myospark.file_queries import QUERIES

    kind, seen = type(spark.range(1)), []

    def counted(call):
        whole = getattr(kind, call)

        def rows(df, *args, **kwargs):
            got = list(whole(df, *args, **kwargs))
            seen.append(len(got))
            return got if call == "collect" else iter(got)

        return rows

    for call in ("collect", "toLocalIterator"):
        monkeypatch.setattr(kind, call, counted(call))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sum(seen) < 50


def test_parts_of_a_file_are_in_order(spark):
    from myospark.file_queries import scratch_binary

    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 5_000, 1, 7).selectExpr("4999 - id AS a", "id AS b")
        path = scratch_binary(spark, "x.bin", b"head", rows, lambda table: table.T.astype("<i8").tobytes(), b"tail")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    data = open(path.removeprefix("file://"), "rb").read()
    assert data[:4] == b"head" and data[-4:] == b"tail"
    got = np.frombuffer(data[4:-4], "<i8").reshape(-1, 2)
    assert (got[:, 0] == np.arange(5_000)).all() and (got.sum(axis=1) == 4_999).all()
    assert len(os.listdir(os.path.dirname(path.removeprefix("file://")))) == 1


def test_recordings_are_laid_out_by_many_tasks(spark):
    """Rows of channels are few bytes, but each recording costs work: they do not meet in one task."""
    signals = spark.range(400).selectExpr("concat('r', id % 40) AS recording_id", "0 AS channel_idx", "'a' AS channel", "id div 40 AS sample_index", "double(id div 40) AS t", "double(id) AS value")
    rows = [(f"r{k}", 0, "a", "EMG", 1.0, "mV", "n/a", *[None] * 9) for k in range(40)]
    kept = sink.planned_files(signals, spark.createDataFrame(rows, CHANNELS)).persist()
    assert kept.count() == len(rows)
    layout = kept.withColumn("task", F.spark_partition_id()).collect()
    kept.unpersist()
    assert sorted(r["recording_id"] for r in layout) == sorted(r[0] for r in rows) and all(r["parts"] == 1 and r["spec"] for r in layout)
    assert len({r["task"] for r in layout}) > 1
