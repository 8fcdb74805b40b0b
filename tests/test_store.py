"""The Parquet store: layout, bounds, and what reaches the scan."""

import math

import pytest
from pyspark.sql import functions as F

from myospark.plans import store
from myospark.recording import Recording
from myospark.schema import CHANNELS, SIGNALS


def channel_row(rec, idx, name, rate, kind="EMG"):
    return (rec, idx, name, kind, rate, "mV", "n/a", *[None] * 9)


def long_recording(spark, n=200_000):
    """Two recordings: one at one time base, one with a channel at a rate of its own and one with a gap."""
    base = spark.range(n).withColumnRenamed("id", "sample_index")
    parts = []
    for rec, idx, name, t in (
        ("a", 0, "x", F.col("sample_index") / 2000.0),
        ("a", 1, "y", F.col("sample_index") / 2000.0),
        ("b", 0, "x", F.col("sample_index") / 1000.0),
        ("b", 1, "slow", F.col("sample_index") / 148.1481),
        ("b", 2, "gap", F.col("sample_index") / 1000.0 + F.when(F.col("sample_index") >= 1000, 500.0).otherwise(0.25)),
    ):
        parts.append(base.select(F.lit(rec).alias("recording_id"), F.lit(idx).alias("channel_idx"), F.lit(name).alias("channel"), "sample_index", t.alias("t"), F.sin(F.col("sample_index") * (idx + 1)).alias("value")))
    signals = parts[0]
    for p in parts[1:]:
        signals = signals.unionByName(p)
    rows = [channel_row("a", 0, "x", 2000.0), channel_row("a", 1, "y", 148.0, "ACC"), channel_row("b", 0, "x", 1000.0), channel_row("b", 1, "slow", 148.1481, "ACC"), channel_row("b", 2, "gap", 1000.0)]
    return Recording(spark, signals, spark.createDataFrame(rows, CHANNELS))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rec = long_recording(spark)
    rec.set_metadata("subject", 7)
    folder = rec.to_store(f"file://{tmp_path_factory.mktemp('store')}/s", files=6, row_group_bytes=64 << 10)
    return rec, folder


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def scanned(df):
    """Rows that the scan of a plan without a shuffle gave out."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    leaf = plan.executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_there_and_back(spark, kept):
    rec, folder = kept
    back = Recording.from_store(spark, folder)
    assert same(back.signals, rec.signals) and same(back.channels, rec.channels)
    assert back.get_metadata("subject") == 7
    stored = spark.read.parquet(f"{folder}/signals")
    times = {tuple(r) for r in stored.where("sample_index > 0").groupBy("recording_id", "channel", "rate").agg(F.count("t") > 0).collect()}
    assert times == {("a", "x", 2000.0, False), ("a", "y", 2000.0, False), ("b", "x", 1000.0, False), ("b", "slow", 148.1481, False), ("b", "gap", None, True)}


@pytest.mark.parametrize("low,high", [(10.0, 12.0), (None, 0.5), (99.9995, None), (500.9, 501.5), (-5.0, -1.0), (0.3, 0.3), (-math.inf, math.inf), (1e300, None)])
def test_bounds_on_time(spark, kept, low, high):
    rec, folder = kept
    assert same(Recording.from_store(spark, folder).between(low, high).signals, rec.between(low, high).signals)


def test_bounds_reach_the_scan(spark, kept):
    _, folder = kept
    back = Recording.from_store(spark, folder)
    some = back.select_channels("slow").between(100.0, 101.0)
    assert some.signals.count() == 148 and scanned(some.signals) < 40_000
    gap = back.select_channels("gap").between(501.5, 502.0)
    assert gap.signals.count() == 501 and scanned(gap.signals) < 40_000
    plan = some.signals._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "EqualTo(channel,slow)" in pushed and "Or(" in pushed and "EqualTo(rate,148.0)" in pushed
    assert "t:double" not in back.signals.select("channel", "value")._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]


def test_bounds_by_index_and_plots(spark, kept):
    rec, folder = kept
    back = Recording.from_store(spark, folder)
    assert same(back.between(1000, 1010.5, by="sample_index").signals, rec.between(1000, 1010.5, by="sample_index").signals)
    twice = back.between(10.0, 20.0).between(15.0, 30.0).signals
    assert same(twice, rec.between(15.0, 20.0).signals)
    assert same(back.select_channels(channel_type="ACC").between(3.0, 4.0).signals, rec.select_channels(channel_type="ACC").between(3.0, 4.0).signals)
    assert same(back.plot_frame(["x"], (1.0, 1.5)), rec.plot_frame(["x"], (1.0, 1.5)))


def test_many_rates_have_one_range(spark, tmp_path):
    """Beyond MOST_RATES one range of sample indices holds those of all rates."""
    n = store.MOST_RATES + 4
    rows = [("r", i, f"c{i}", k, k / (10.0 + i), float(k)) for i in range(n) for k in range(100)]
    rec = Recording(spark, spark.createDataFrame(rows, SIGNALS), spark.createDataFrame([channel_row("r", i, f"c{i}", 10.0 + i) for i in range(n)], CHANNELS))
    back = Recording.from_store(spark, rec.to_store(f"file://{tmp_path}/s"))
    assert spark.read.parquet(f"file://{tmp_path}/s/signals").where("t is not null").isEmpty()
    assert same(back.between(2.0, 2.5).signals, rec.between(2.0, 2.5).signals)


def test_odd_rows(spark, tmp_path):
    """Null and NaN times, null indices, channels without a row or a rate, repeated rows and repeated channel rows."""
    nan = math.nan
    rows = [("r", 0, "a", 0, 0.0, 1.0), ("r", 0, "a", 1, None, 2.0), ("r", 0, "a", None, None, 3.0), ("r", 0, "a", 2, nan, nan), ("r", 0, "a", 3, 0.3, None), ("r", 0, "a", 3, 0.3, None)]
    rows += [("r", 1, "no row", 5, 5.0, 1.0), ("r", 2, "no rate", 5, 0.5, 1.0), ("r", 3, "rate 0", 5, 5.0, 1.0), (None, 0, "a", 1, 0.1, 1.0)]
    chans = [channel_row("r", 0, "a", 10.0), channel_row("r", 0, "a", 10.0), channel_row("r", 2, "no rate", None), channel_row("r", 3, "rate 0", 0.0)]
    rec = Recording(spark, spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(chans, CHANNELS))
    back = Recording.from_store(spark, rec.to_store(f"file://{tmp_path}/s"))
    assert same(back.signals, rec.signals)
    assert same(back.between(0.05, 0.6).signals, rec.between(0.05, 0.6).signals)


def test_an_empty_recording(spark, tmp_path):
    rec = Recording(spark, spark.createDataFrame([], SIGNALS))
    back = Recording.from_store(spark, rec.to_store(f"file://{tmp_path}/s"))
    assert back.signals.isEmpty() and back.between(1.0, 2.0).signals.isEmpty() and back.channels.isEmpty()
    with pytest.raises(ValueError, match="No signals"):
        Recording(spark).to_store(f"file://{tmp_path}/none")
