"""Decisions on odd behaviour, by their numbers in the survey's register."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from myospark.functions import scalar as fn
from myospark.operators.analysis import analyze, channel_stats, digitize, scaling, suitability
from myospark.plans.adapters import from_wide, with_ordinal
from myospark.recording import Recording, latest_metadata
from myospark.sources.edf import parse_header

from .test_files import edf, make, otb, samples


def test_b1_b11_b14_export_options(spark, tmp_path):
    r = Recording(spark).add_channel("EMG1", np.sin(np.arange(300) / 7), 99.9, "mV")
    h = parse_header(r.to_edf(str(tmp_path / "a.edf"), precision_threshold=5))
    assert h["signals"][0]["samples"] == 99 and h["patient"] == "X X X X"
    assert "99.9" in (tmp_path / "a_channels.tsv").read_text()


def test_b4_snr_is_constant(spark):
    rng = np.random.default_rng(0)
    r = Recording(spark)
    for k in range(3):
        r.add_channel(f"c{k}", rng.normal(0, 10**k, 200), 100, "mV")
    assert [x["snr_db"] for x in analyze(r.signals).collect()] == pytest.approx([20 * np.log10(np.sqrt(2))] * 3)


def test_b5_dynamic_range_branches(spark):
    a = spark.createDataFrame([("a", False, 1.0, 90.0, 3.0), ("b", False, 1.0, 90.1, 3.0), ("c", False, 1.0, 138.1, 3.0), ("d", False, 2e5, 1.0, 3.0)], "channel string, is_zero boolean, range double, dynamic_range_db double, snr_db double")
    got = {r["channel"]: (r["use_bdf"], r["reason"]) for r in suitability(a).collect()}
    assert got["a"] == (False, "EDF dynamic range (96 dB) is sufficient") and got["b"] == (True, "Signal requires BDF format (DR: 90.1 dB)")
    assert got["c"] == (True, "Signal may require higher resolution than BDF (DR: 138.1 dB)") and got["d"][0]


def test_b10_digitizing_clamps(spark):
    r = Recording(spark).add_channel("c", [-1.0, 0.0, 2.0], 10, "mV")
    limits = scaling(channel_stats(r.signals), 16).withColumn("physical_max", F.lit(1.0))
    assert [x["digital"] for x in digitize(r.signals, limits).orderBy("sample_index").collect()] == [-32768, 0, 32767]


def test_b15_one_format_for_all(spark, tmp_path):
    r = make(spark, 1e6)
    with pytest.warns(UserWarning, match="BDF"):
        out = r.to_edf(str(tmp_path / "b.edf"))
    assert {int(s["dmax"]) for s in parse_header(out)["signals"]} == {8388607}
    assert "1 channels using EDF, 0 channels using BDF" in r.summary()


def test_b17_b20_b23_declared_channels(spark, tmp_path):
    xml = '<Device SampleFrequency="10" DeviceTotalChannels="3"><Channels><Adapter ID="GYRO"><Channel Index="2"/></Adapter></Channels></Device>'
    r = Recording.from_file(spark, otb(tmp_path / "a.otb", [[1, 2, 3], [4, 5, 6]], xml=xml), "otb")
    assert samples(r, "CH3") == [3, 6] and r.channels.first()["physical_dimension"] == "g"


def test_b13_b24_missing_files(spark, tmp_path):
    for name, error in (("trigno", FileNotFoundError), ("otb", FileNotFoundError), ("edf", ValueError)):
        with pytest.raises(error):
            Recording.from_file(spark, str(tmp_path / "none"), name)


def test_b27_names_are_not_positions(spark):
    r = Recording(spark)
    for name in ("CH1", "CH39", "CH70"):
        r.add_channel(name, [1.0, 2.0], 10, "mV")
    picked = r.select_channels(["CH70", "CH1"]).channels.orderBy("channel_idx").collect()
    assert [(c["channel"], c["channel_idx"]) for c in picked] == [("CH70", 0), ("CH1", 1)]


def test_b31_plot_takes_a_name(spark):
    r = Recording(spark).add_channel("EMG1", [1.0, 2.0], 10, "mV")
    assert r.plot_frame("EMG1").count() == 2


def test_b33_repeated_labels(spark, tmp_path):
    p = tmp_path / "d.edf"
    edf(p)
    raw = p.read_bytes().replace(b"left".ljust(16), b"EMG1".ljust(16))
    p.write_bytes(raw)
    r = Recording.from_file(spark, str(p), "edf")
    assert r.channels.count() == 1 and samples(r, "EMG1")[0] == pytest.approx((1 + 32768) * 2 / 65535 - 1)


def test_with_ordinal_matches_a_global_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.permutation(500), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = with_ordinal(df, ["g"], ["x"], F.floor(F.col("x") / 37)).collect()
    for g in range(3):
        own = sorted((r["x"], r["sample_index"]) for r in got if r["g"] == g)
        assert [i for _, i in own] == list(range(len(own)))


def test_pruning_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double").write.parquet(str(tmp_path / "w"))
    plan = from_wide(spark.read.parquet(str(tmp_path / "w")), ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:double>" in plan


def test_latest_metadata_and_functions(spark):
    m = spark.createDataFrame([("r", "k", "1", 1), ("r", "k", "2", 5), ("r", "k", "3", 3)], "recording_id string, key string, value string, seq long")
    assert latest_metadata(m).first()["value"] == "2"
    words = spark.createDataFrame([(-1, 255), (32767, -1), (-32768, 0), (0, 128)], "hi short, lo short")
    assert [r[0] for r in words.select(fn.combine_24bit(F.col("hi"), F.col("lo"))).collect()] == [-1, 8388607, -8388608, 128]
    with pytest.raises(Exception, match="gain is 0"):
        words.select(fn.otb_gain_scale(F.col("hi"), F.lit("EMG"), 16, F.lit(0.0))).collect()
