
from datetime import date, datetime

import numpy as np
import pytest

from myospark.operators.analysis import channel_stats, precision_loss, quantize, scaling
from myospark.recording import Recording, latest_metadata


@pytest.fixture()
def rec(spark):
    t = np.linspace(0, 1, 1000)
    r = Recording(spark)
    r.add_channel("EMG1", np.sin(2 * np.pi * 10 * t), 1000, "mV")
    r.add_channel("ACC1", np.cos(2 * np.pi * 5 * t), 1000, "g", channel_type="ACC")
    return r


def values(r, channel):
    return [x["value"] for x in r.signals.where(f"channel = '{channel}'").orderBy("sample_index").collect()]


def test_add_channel_and_time_index(rec):  # SRC-14, FN-1
    row = rec.signals.where("channel = 'EMG1' AND sample_index = 10").first()
    assert row["t"] == pytest.approx(0.01)
    assert rec.channels.count() == 2
    rec.add_channel("EMG1", np.zeros(1000), 1000, "uV")
    assert rec.channels.where("channel = 'EMG1'").first()["physical_dimension"] == "uV"
    assert max(values(rec, "EMG1")) == 0


def test_length_mismatch_and_other_rate(rec):
    with pytest.raises(ValueError):
        rec.add_channel("X", np.zeros(5), 1000, "mV")
    rec.add_channel("Y", np.zeros(1000), 2000, "mV")  # accepted; the time base stays the first channel's
    assert rec.signals.where("channel = 'Y'").agg({"t": "max"}).first()[0] == pytest.approx(0.999)
    with pytest.raises(ValueError):
        rec.add_channel("Z", np.zeros(1000), 0, "mV")


def test_select(rec):  # PRJ-1
    one = rec.select_channels("ACC1")
    assert [c["channel"] for c in one.channels.collect()] == ["ACC1"]
    both = rec.select_channels(["ACC1", "EMG1", "ACC1"])
    assert [c["channel"] for c in both.channels.orderBy("channel_idx").collect()] == ["ACC1", "EMG1"]
    assert rec.select_channels(channel_type="EMG").get_channels_by_type("EMG") == ["EMG1"]
    assert rec.channels.count() == 2
    assert rec.select_channels("EMG1", inplace=True) is rec
    assert rec.channels.count() == 1


def test_select_errors(rec, spark):
    with pytest.raises(ValueError, match="No signals"):
        Recording(spark).select_channels("A")
    with pytest.raises(ValueError, match="not found"):
        rec.select_channels(["EMG1", "NOPE"])
    with pytest.raises(ValueError, match="of type"):
        rec.select_channels(channel_type="GYRO")
    with pytest.raises(ValueError, match="None of the selected"):
        rec.select_channels(["EMG1"], "ACC")
    with pytest.raises(ValueError):
        rec.select_channels()  # B16


def test_types_and_counts(rec):  # AGG-1, PRJ-2, AGG-10
    assert rec.get_channel_types() == ["ACC", "EMG"]
    assert rec.get_channels_by_type("TRIG") == []
    assert {r["channel_type"]: r["count"] for r in rec.channel_counts().collect()} == {"ACC": 1, "EMG": 1}


def test_metadata(rec):  # PRJ-4, PRJ-5
    rec.set_metadata("subject", "S1")
    rec.set_metadata("subject", "S2")
    assert rec.get_metadata("subject") == "S2"
    for value in (5, 2.5, True, None, [1, "a"], {"k": 1}, datetime(2020, 1, 2, 3, 4), date(2020, 1, 2)):
        rec.set_metadata("any", value)
        got = rec.get_metadata("any")
        assert got == value and type(got) is type(value)
    assert rec.get_metadata("nothing") is None


def test_plot_frame(rec, spark):  # VIS-1, PRJ-3, FN-12, FN-13
    f = rec.plot_frame(time_range=(0.1, 0.2))
    assert f.where("channel = 'EMG1'").count() == 101
    assert {r["channel"]: r["offset"] for r in f.select("channel", "offset").distinct().collect()} == {"EMG1": 1.0, "ACC1": 0.0}
    y = [r["y"] for r in rec.plot_frame("EMG1", uniform_scale=False, detrend=True).collect()]
    assert max(y) - min(y) == pytest.approx(0.8)
    with pytest.raises(ValueError, match="not found"):
        rec.plot_frame(["NOPE"])
    flat = Recording(spark).add_channel("C", [3.0] * 20, 100, "mV")
    assert {r["y"] for r in flat.plot_frame().collect()} == {0.0}  # B29


class FakePlot:
    def __init__(self):
        self.calls = []

    def subplots(self, **kw):
        self.calls.append(("subplots", kw))
        return self, self

    def __getattr__(self, name):
        return lambda *a, **kw: self.calls.append((name, a, kw))


def test_render(rec):  # VIS-1a
    plt = FakePlot()
    rec.plot_signals(["ACC1", "EMG1"], plt_module=plt, title="x", show=True)
    names = [c[0] for c in plt.calls]
    assert names.count("plot") == 2 and "show" in names and "grid" in names
    assert next(c for c in plt.calls if c[0] == "set_ylim")[1] == (-0.5, 1.5)


def test_analysis_edges(spark):  # AGG-2, FN-9, B4, B6, B7
    r = Recording(spark)
    r.add_channel("zero", [0.0] * 4, 10, "mV")
    r.add_channel("const", [5.0] * 4, 10, "mV")
    r.add_channel("nan", [1.0, float("nan"), 2.0, 3.0], 10, "mV")
    r.add_channel("big", [0.0, 2e5, 0.0, 1.0], 10, "mV")
    got = {x["channel"]: x for x in r.analysis().collect()}
    assert got["zero"]["is_zero"] and got["zero"]["snr_db"] is None and got["zero"]["snr"] == 0.0
    assert got["const"]["dynamic_range_db"] == float("-inf") and not got["const"]["use_bdf"]
    assert np.isnan(got["nan"]["range"]) and got["nan"]["use_bdf"] and "higher resolution" in got["nan"]["reason"]
    assert got["big"]["use_bdf"] and got["big"]["reason"].startswith("Large amplitude")
    assert got["big"]["snr_db"] == pytest.approx(20 * np.log10(np.sqrt(2)))
    text = r.select_channels(["zero", "big"]).summary()
    assert "Channel Type: EMG (2 channels)" in text and "0 channels using EDF, 1 channels using BDF" in text
    assert "All channels contain zero signal" in r.select_channels("zero").summary()


def limits(spark, data, bits):
    r = Recording(spark).add_channel("c", data, 10, "mV")
    return r, scaling(channel_stats(r.signals), bits, rounded=True).first()


@pytest.mark.parametrize(("bits", "factor"), [(16, 32767.0), (24, 8388607.0)])
def test_scaling(spark, bits, factor):  # FN-10
    _, s = limits(spark, [-1.0, 1.0], bits)
    assert s["scaling_factor"] == factor and (s["physical_min"], s["physical_max"]) == (-1, 1)


def test_scaling_flat(spark):
    _, s = limits(spark, [1.0, 1.0], 16)
    assert s["physical_max"] - s["physical_min"] == pytest.approx(0.002)
    _, s = limits(spark, [0.0, 0.0], 16)
    assert (s["physical_min"], s["physical_max"]) == (-1, 1)
    _, s = limits(spark, [1000.0, 1000.005], 16)  # B8
    assert s["physical_max"] > 1000.9


def test_round_physical(spark):  # FN-11, B9
    import random

    from pyspark.sql import functions as F

    from myospark.functions.scalar import round_physical

    def widest(value):
        fits = [round(value, d) for d in range(7) if len(f"{round(value, d):g}") <= 8]
        return fits[-1] if fits else float(round(value))

    rng = random.Random(1)
    values = [5e-7, 123456.789, -1.2345678, 0.1234567, 0.0, 1e6, -999999.7, 1234567.8, 1.23e7, -1.23e7, 1e100, -1.2e100, -0.123456, -0.0001234, 9.9e-5, -0.9999996]
    values += [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 9) for _ in range(2000)] + [round(rng.uniform(-1e8, 1e8), rng.choice([-6, -5, -4, -3, 0, 2])) for _ in range(500)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*values, float("nan")])], "i int, v double").select("i", round_physical(F.col("v")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows[:-1]] == [widest(float(v)) for v in values] and np.isnan(rows[-1]["r"])


def test_quantization(spark):  # AGG-3
    rng = np.random.default_rng(1)
    data = np.sin(np.linspace(0, 60, 1000)) + rng.normal(0, 0.01, 1000)
    r = Recording(spark).add_channel("c", data, 1000, "mV")
    a, b = quantize(r.signals, 16).first(), quantize(r.signals, 24).first()
    assert b["snr"] > a["snr"] and b["rmse"] < a["rmse"]
    step = (data.max() - data.min()) / 2**16
    assert a["max_error"] == pytest.approx(np.abs(data - np.round(data / step) * step).max())


def test_precision_loss(spark):  # AGG-4, B12, B30
    r, _ = limits(spark, [-1, -0.5, 0, 0.5, 1], 16)
    full = precision_loss(r.signals, scaling(channel_stats(r.signals), 16)).first()["precision_loss"]
    assert 0 < full < 0.01
    zero, _ = limits(spark, [0.0] * 5, 16)
    assert precision_loss(zero.signals, scaling(channel_stats(zero.signals), 16)).first()["precision_loss"] == 0.0
    ramp, _ = limits(spark, np.linspace(0, 1, 100), 16)
    assert precision_loss(ramp.signals, scaling(channel_stats(ramp.signals), 16)).first()["precision_loss"] == pytest.approx(50, abs=5)


def test_figures_of_several_depths_in_two_scans(spark, monkeypatch):
    n = 400
    r = Recording(spark)
    r.add_channel("a", np.sin(np.arange(n) / 9) * 3, 100.0, "mV")
    r.add_channel("flat", np.full(n, 2.0), 100.0, "mV")
    r.add_channel("zero", np.zeros(n), 100.0, "mV")
    r.add_channel("gap", np.where(np.arange(n) == 7, np.nan, np.arange(n) - 50.0), 100.0, "mV")
    got = {(x["channel"], x["bits"]): x for x in r.export_figures().collect()}
    assert len(got) == 8
    for bits in (16, 24):
        one = {x["channel"]: x for x in r.quantization(bits).collect()}
        loss = {x["channel"]: x["precision_loss"] for x in r.precision_loss(bits).collect()}
        for c in ("a", "flat", "zero", "gap"):
            have = got[c, bits]
            assert [have[k] for k in ("step_size", "max_error", "rmse", "snr")] == pytest.approx([one[c][k] for k in ("step_size", "max_error", "rmse", "snr")], nan_ok=True)
            assert have["precision_loss"] == pytest.approx(loss[c], nan_ok=True)
    assert Recording(spark, r.signals.where("false"), r.channels).export_figures().count() == 0


def test_many_metadata_calls_are_one_union(rec):
    rec.set_metadata("first", 1)
    plan = lambda: rec.metadata._jdf.queryExecution().optimizedPlan().toString().count("\n")
    depth = plan()
    for i in range(300):
        rec.set_metadata(f"k{i % 100}", i)
    assert plan() == depth and rec.metadata.where("key like 'k%'").count() == 100
    assert rec.get_metadata("k7") == 207 and rec.get_metadata("first") == 1
    part = rec.select_channels([rec.get_channels_by_type("EMG")[0]])
    part.set_metadata("k7", "mine")
    assert (part.get_metadata("k7"), part.get_metadata("k8"), rec.get_metadata("k7")) == ("mine", 208, 207)
    assert latest_metadata(part.metadata).where("key = 'k7'").first()["value"] == "mine"
    rec.metadata = part.metadata
    assert rec.get_metadata("k7") == "mine"


def test_figures_below_the_least_noise(spark):
    """By NumPy: an RMSE smaller than the floor of the SNR's noise stays as it is."""
    v = np.arange(200) % 11 / 1000.0
    r = Recording(spark).add_channel("a", v, 100.0, "mV")
    both = {x["bits"]: x for x in r.export_figures().collect()}
    for bits in (16, 24):
        step = (v.max() - v.min()) / 2.0**bits
        e = v - np.rint(v / step) * step
        noise = np.mean(e * e)
        want = [step, np.abs(e).max(), np.sqrt(noise), 10 * np.log10(np.mean(v * v) / max(noise, np.finfo(float).eps))]
        for row in (both[bits], r.quantization(bits).first()):
            assert [row[k] for k in ("step_size", "max_error", "rmse", "snr")] == pytest.approx(want, rel=1e-6)
