"""Sources and sinks over files built byte by byte."""

import io
import os
import tarfile
import warnings

import numpy as np
import pytest

from myospark.recording import Recording
from myospark.sinks.edf import header_bytes
from myospark.sources.edf import parse_header
from myospark.sources.trigno import csv_structure

TRIGNO = """Label: EMG1 Sampling frequency: 1000.0 Unit: mV Domain: time
Label: EMG2 Sampling frequency: 1000.0 Unit: mV Domain: time
Label: ACC1 Sampling frequency: 1000.0 Unit: g Domain: time

X[s],"EMG1","EMG2","ACC1","lost","X[s]"
0.000,1.0,2.0,0.5,9,0
0.001,1.5,2.5,,9,0
0.002,-1.0,3.0,0.7,9,
"""


def samples(rec, channel):
    return [r["value"] for r in rec.signals.where(f"channel = '{channel}'").orderBy("sample_index").collect()]


def test_trigno(spark, tmp_path):  # SRC-3..5
    p = tmp_path / "a.csv"
    p.write_text(TRIGNO)
    assert csv_structure(TRIGNO)[1] == 5
    r = Recording.from_file(spark, str(p))
    chans = r.channels.orderBy("channel_idx").collect()
    assert [(c["channel"], c["channel_type"], c["physical_dimension"]) for c in chans] == [("EMG1", "EMG", "mV"), ("EMG2", "EMG", "mV"), ("ACC1", "ACC", "g")]
    assert samples(r, "EMG1") == [1.0, 1.5, -1.0]
    acc = samples(r, "ACC1")
    assert acc[0] == 0.5 and np.isnan(acc[1]) and acc[2] == 0.7
    assert r.get_metadata("device") == "Delsys Trigno" and r.get_metadata("source_file") == str(p)


def test_trigno_errors(spark, tmp_path):  # B21, B22, B24
    with pytest.raises(FileNotFoundError):
        Recording.from_file(spark, str(tmp_path / "none.csv"))
    bad = tmp_path / "bad.csv"
    bad.write_text("Label: x\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        Recording.from_file(spark, str(bad))
    bad.write_text("Label: EMG1 Sampling frequency: 10 Unit: mV\nX[s],EMG1\n0,1\n")
    with pytest.raises(ValueError, match="incomplete"):
        Recording.from_file(spark, str(bad))


def test_unknown_importer(spark):  # SRC-1
    with pytest.raises(ValueError, match="trigno"):
        Recording.from_file(spark, "x", "noraxon")


def otb(path, words, bits=16, xml=None, names=("d.sig", "d.xml")):
    xml = xml or f"""<Device Name="Q" SampleFrequency="2000" ad_bits="{bits}"><Channels>
    <Adapter ID="Due" Gain="200" ChannelStartIndex="0" HighPassFilter="10" LowPassFilter="500"><Channel Index="0" Muscle="TA"/></Adapter>
    <Adapter ID="Aux" ChannelStartIndex="1"><Channel Index="0" Description="Acceleration X"/></Adapter></Channels></Device>"""
    with tarfile.open(path, "w") as tar:
        for name, data in zip(names, (np.asarray(words, "<i2").tobytes(), xml.encode()), strict=True):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def test_otb_16(spark, tmp_path):  # SRC-6..9, FN-4, FN-7, FN-8
    r = Recording.from_file(spark, otb(tmp_path / "a.otb+", [[100, 1], [-100, 2], [50, 3]]), "otb")
    c = {x["channel"]: x for x in r.channels.collect()}
    assert c["CH1"]["channel_type"] == "EMG" and c["CH1"]["prefilter"] == "HP:10Hz LP:500Hz" and c["CH1"]["muscle"] == "TA"
    assert c["CH2"]["channel_type"] == "ACC" and c["CH2"]["physical_dimension"] == "g" and c["CH2"]["prefilter"] == "n/a"
    assert samples(r, "CH1") == pytest.approx([100 * 3.3 / 65536 * 5, -100 * 3.3 / 65536 * 5, 50 * 3.3 / 65536 * 5])
    assert samples(r, "CH2") == [1, 2, 3]
    assert r.signals.where("channel = 'CH2' AND sample_index = 2").first()["t"] == pytest.approx(0.001)


def test_otb_24(spark, tmp_path):  # FN-2
    pairs = [(-1, 255), (32767, -1), (-32768, 0), (0, 128)]
    words = [[0, w] for p in pairs for w in p]
    r = Recording.from_file(spark, otb(tmp_path / "b.otb+", words, 24), "otb")
    assert samples(r, "CH2") == [-1, 8388607, -8388608, 128]


def test_otb_errors(spark, tmp_path):  # B17, B19, B24, B32
    with pytest.raises(FileNotFoundError):
        Recording.from_file(spark, str(tmp_path / "no.otb"), "otb")
    junk = tmp_path / "junk.otb"
    junk.write_bytes(b"not a tar at all" * 100)
    with pytest.raises(ValueError):
        Recording.from_file(spark, str(junk), "otb")
    with pytest.raises(ValueError, match="No .sig"):
        Recording.from_file(spark, otb(tmp_path / "c.otb", [[1, 2]], names=("d.bin", "d.xml")), "otb")
    with pytest.raises(ValueError, match="xml"):
        Recording.from_file(spark, otb(tmp_path / "c.otb", [[1, 2]], names=("d.sig", "e.xml")), "otb")
    with pytest.raises(ValueError, match="whole sample rows"):
        Recording.from_file(spark, otb(tmp_path / "c.otb", [1, 2, 3]), "otb")
    with pytest.raises(ValueError, match="gain 0"):
        Recording.from_file(spark, otb(tmp_path / "c.otb", [[1]], xml='<D SampleFrequency="10"><Channels><Adapter ID="Due" Gain="0"><Channel/></Adapter></Channels></D>'), "otb")
    with pytest.raises(ValueError, match="rate"):
        Recording.from_file(spark, otb(tmp_path / "c.otb", [[1]], xml='<D><Channels><Adapter ID="Aux"><Channel/></Adapter></Channels></D>'), "otb")


def edf(path, bdf=False):
    sig = {"transducer": "EMG sensor", "dimension": "mV", "pmin": "-1", "pmax": "1", "dmin": -32768, "dmax": 32767, "prefilter": "", "samples": 4, "reserved": ""}
    head = header_bytes([sig | {"label": "EMG1"}, sig | {"label": "left", "transducer": "Accelerometer"}], 2, bdf)
    word = lambda x: int(x).to_bytes(3 if bdf else 2, "little", signed=True)
    body = b""
    for k in range(2):
        body += b"".join(word(x + k) for x in (-32768, 0, 100, 32767 - k)) + b"".join(word(x) for x in (1, 2, 3, 4)) + b"\x00" * 60
    path.write_bytes(head + body)
    return str(path)


@pytest.mark.parametrize("bdf", [False, True])
def test_edf_read(spark, tmp_path, bdf):  # SRC-10..12
    p = edf(tmp_path / "a.edf", bdf)
    r = Recording.from_file(spark, p, "edf")
    assert [(c["channel"], c["channel_type"], c["prefilter"], c["sample_frequency"]) for c in r.channels.orderBy("channel_idx").collect()] == [("EMG1", "EMG", "n/a", 4.0), ("left", "ACC", "n/a", 4.0)]
    gain = 2 / 65535
    assert samples(r, "EMG1") == pytest.approx([(x + 32768) * gain - 1 for x in (-32768, 0, 100, 32767, -32767, 1, 101, 32767)])
    assert r.get_metadata("number_of_signals") == 2 and r.get_metadata("gender") is None
    assert r.get_metadata("filetype") == (3 if bdf else 1) and r.get_metadata("datarecord_duration") == 1.0 and r.get_metadata("startdate").year == 1985


def test_edf_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Error reading EDF file"):
        Recording.from_file(spark, str(tmp_path / "none.edf"), "edf")
    bad = tmp_path / "bad.edf"
    bad.write_bytes(b"x" * 600)
    with pytest.raises(ValueError, match="Error reading EDF file"):
        Recording.from_file(spark, str(bad), "edf")


def test_channel_filter_reaches_the_reader(spark, tmp_path):
    r = Recording.from_file(spark, edf(tmp_path / "a.edf"), "edf")
    q = r.signals.where("channel = 'left'")
    assert q.count() == 8 and {x["channel"] for x in q.select("channel").distinct().collect()} == {"left"}


def make(spark, scale=1000.0, n=2500):
    t = np.arange(n) / 1000
    r = Recording(spark)
    r.add_channel("EMG1", scale * np.sin(2 * np.pi * 10 * t), 1000, "uV", "HP 20Hz")
    r.add_channel("a channel with a long name", np.cos(2 * np.pi * 5 * t), 1000, "g", channel_type="ACC")
    return r


def test_round_trip_edf(spark, tmp_path):  # SNK-1..3, AGG-12, B11, B13
    r = make(spark)
    out = r.to_edf(str(tmp_path / "x.dat"))
    assert out.endswith("x.edf") and os.path.exists(out)
    h = parse_header(out)
    assert h["records"] == 3 and h["reserved"] == "EDF+C" and h["signals"][0]["transducer"] == "EMG sensor"
    back = Recording.from_file(spark, out, "edf")
    assert [c["channel"] for c in back.channels.orderBy("channel_idx").collect()] == ["EMG1", "a channel with a"]
    assert [c["channel_type"] for c in back.channels.orderBy("channel_idx").collect()] == ["EMG", "OTHER"]
    typed = Recording.from_file(spark, out, "edf", sidecar=True)
    assert [c["channel_type"] for c in typed.channels.orderBy("channel_idx").collect()] == ["EMG", "ACC"]
    a, b = np.array(samples(r, "EMG1")), np.array(samples(back, "EMG1"))
    assert len(b) == 3000 and np.abs(a - b[:2500]).max() <= 2000 / 65535
    tsv = (tmp_path / "x_channels.tsv").read_text().splitlines()
    assert tsv[0].split("\t") == ["name", "channel_type", "physical_dimension", "sample_frequency", "reference", "status"]
    assert tsv[2].split("\t") == ["a channel with a long name", "ACC", "g", "1000.0", "n/a", "good"]
    assert not [f for f in os.listdir(tmp_path) if ".parts-" in f]


def test_round_trip_bdf(spark, tmp_path):
    r = make(spark, 1e6)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = r.to_edf(str(tmp_path / "y.edf"))
    assert out.endswith(".bdf") and any("BDF" in str(w.message) for w in seen)
    a, b = np.array(samples(r, "EMG1")), np.array(samples(Recording.from_file(spark, out, "edf"), "EMG1"))[:2500]
    assert np.corrcoef(a, b)[0, 1] > 0.99 and np.abs(a - b).max() < 1


def test_export_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="No signals"):
        Recording(spark).to_edf(str(tmp_path / "z.edf"))
    r = Recording(spark).add_channel("n", [1.0, float("nan"), 3.0], 10, "mV")
    with pytest.raises(ValueError, match="missing samples"):
        r.to_edf(str(tmp_path / "z.edf"))


def test_a_part_without_samples_is_written(spark, tmp_path):
    """Records that hold no sample of any channel still count."""
    r = Recording(spark).add_channel("a", np.sin(np.arange(1400) / 9), 10, "mV")
    kept = r.signals.where("sample_index < 10 or sample_index >= 1390")
    out = Recording(spark, kept.withColumn("sample_index", kept["sample_index"]), r.channels).to_edf(str(tmp_path / "gap.edf"))
    h = parse_header(out)
    assert os.path.getsize(out) == h["header_bytes"] + h["records"] * h["record_bytes"]


def test_bounds_choose_slices(spark, tmp_path, monkeypatch):
    from myospark.sources import edf as source

    monkeypatch.setattr(source, "BLOCK_SAMPLES", 1)
    reader = source.EdfReader(edf(tmp_path / "a.edf"), {})
    assert len(reader.partitions()) == 2
    reader = source.EdfReader(reader.path, {"fromsample": "4"})
    assert [(p.first, p.end) for p in reader.partitions()] == [(1, 2)]
    timed = source.EdfReader(edf(tmp_path / "b.edf"), {"totime": "0.499"})
    assert [(p.first, p.end) for p in timed.partitions()] == [(0, 1)]


@pytest.mark.parametrize("how", ["gz", "bz2", "xz"])
def test_compressed_otb(spark, tmp_path, how):
    import bz2
    import gzip
    import lzma

    plain = otb(tmp_path / "a.otb+", [[100, 1], [-100, 2], [50, 3]])
    packed = tmp_path / "b.otb+"
    packed.write_bytes({"gz": gzip, "bz2": bz2, "xz": lzma}[how].compress(open(plain, "rb").read()))
    r = Recording.from_file(spark, str(packed), "otb")
    assert samples(r, "CH2") == [1, 2, 3] and samples(r, "CH1") == samples(Recording.from_file(spark, plain, "otb"), "CH1")
    u = Recording.from_file(spark, str(packed), "otb", unpack_folder=str(tmp_path / "unpacked"))
    assert sorted(u.signals.collect()) == sorted(r.signals.collect()) and u.channels.collect() == r.channels.collect() and u.metadata.collect() == r.metadata.collect()


def big_otb(tmp_path, n=3000, **how):
    import gzip

    plain = otb(tmp_path / "a.otb+", [[k % 1000 - 500, k % 77] for k in range(n)], **how)
    packed = tmp_path / "b.otb+"
    data = open(plain, "rb").read()
    packed.write_bytes(gzip.compress(data[:1000]) + gzip.compress(data[1000:]))  # two members
    return plain, str(packed)


def test_unpacked_archives_are_read_in_ranges(spark, tmp_path):
    """Also beside plain ones; what is there is used again, and a changed archive is unpacked anew."""
    plain, packed = big_otb(tmp_path)
    folder = str(tmp_path / "unpacked")
    r = Recording.from_file(spark, [plain, packed], "otb", pack_bytes=2000, unpack_folder=folder)
    parts = r.signals.where(f"recording_id = '{packed}'").selectExpr("spark_partition_id() AS p").distinct().count()
    assert parts >= 6
    assert sorted(os.listdir(folder)) == sorted(f"{os.listdir(folder)[0].split('.')[0]}.{x}" for x in ("sig", "xml"))
    rows = lambda rec, path: sorted(tuple(x)[1:] for x in rec.signals.where(f"recording_id = '{path}'").collect())
    assert rows(r, packed) == rows(r, plain) and len(rows(r, packed)) == 6000
    ranged = r.select_channels("CH2").between(100, 150, by="sample_index")
    assert ranged.signals.where(f"recording_id = '{packed}'").count() == 51
    before = {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in os.listdir(folder)}
    Recording.from_file(spark, packed, "otb", unpack_folder=folder)
    assert before == {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in os.listdir(folder)}
    big_otb(tmp_path, 50)
    assert Recording.from_file(spark, packed, "otb", unpack_folder=folder).signals.count() == 100


def test_compressed_archives_stream_by_blocks(tmp_path, monkeypatch):
    from myospark.sources import otb as source

    plain, packed = big_otb(tmp_path)
    monkeypatch.setattr(source, "BLOCK_SAMPLES", 200)
    held = []
    frombuffer = np.frombuffer
    monkeypatch.setattr(source.np, "frombuffer", lambda raw, **k: held.append(len(raw)) or frombuffer(raw, **k))
    read = lambda path, **options: [tuple(r.values()) for reader in [source.OtbReader(path, options)] for p in reader.partitions() for b in reader.read(p) for r in b.drop_columns(["recording_id"]).to_pylist()]
    assert sorted(read(packed)) == sorted(read(plain)) and max(held[: len(held) // 2]) == 400
    held.clear()
    some = read(packed, fromsample="1010", tosample="1020")
    assert {r[2] for r in some} >= set(range(1010, 1021)) and held == [400]


def test_broken_archives_are_not_unpacked(spark, tmp_path):
    import gzip

    from myospark.sources.otb import unpack

    _, packed = big_otb(tmp_path)
    data = open(packed, "rb").read()
    cut = tmp_path / "cut.otb+"
    cut.write_bytes(data[: len(data) // 2])
    other = tmp_path / "other.otb+"
    other.write_bytes(b"no archive" * 100)
    empty = tmp_path / "empty.otb+"
    empty.write_bytes(gzip.compress(b"\0" * 10240))
    for path in (cut, other, empty):
        with pytest.raises(ValueError):
            unpack(str(path), str(tmp_path / "unpacked"))
    left = os.listdir(tmp_path / "unpacked")
    assert not [f for f in left if not f.endswith(".xml")]
    with pytest.raises(FileNotFoundError):
        Recording.from_file(spark, str(tmp_path / "none.otb+"), "otb", unpack_folder=str(tmp_path / "unpacked"))


def test_the_export_is_logged(spark, tmp_path, caplog):  # SNK-4
    with caplog.at_level("INFO", logger="myospark"):
        make(spark).to_edf(str(tmp_path / "log.edf"))
    assert "Channel Type: EMG (1 channels)" in caplog.text and "log.edf" in caplog.text
