"""Signal analysis, format choice, scaling, quantization and precision loss: one row per channel.

All take samples with ``keys`` (by default recording_id and channel) and value; they reduce with partial aggregation and
join per-channel rows back, so that no channel has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import to_digital, to_physical
from ..functions.scalar import FLOAT32_EPS, FLOAT64_EPS, is_close, log10_signed, round_physical

KEYS = ["recording_id", "channel"]
NAN = float("nan")
DIGITAL = {16: (-32768, 32767), 24: (-8388608, 8388607)}
EDF_RANGE_DB, BDF_RANGE_DB, MARGIN_DB, LARGE = 96, 144, 6, 1e5


#: Per-channel rows come to the driver, and are broadcast from there, up to this number.
CHANNEL_ROWS = 100_000


def known_rows(rows: DataFrame) -> DataFrame:
    """Per-channel rows, computed once: samples then stay where they are, as the other side of a join is known to be small.

    Beyond CHANNEL_ROWS the rows stay a plan of their own, and samples are shuffled over that many channels.
    """
    few = rows.limit(CHANNEL_ROWS + 1).collect()
    return rows if len(few) > CHANNEL_ROWS else F.broadcast(rows.sparkSession.createDataFrame(few, rows.schema))


def channel_stats(signals: DataFrame, keys: list[str] | None = None, ends: bool = False) -> DataFrame:
    """n, has_nan, min, max, mean, std and largest magnitude in one pass. NaN samples make all of a channel's figures NaN.

    With ``ends`` also length (the last sample_index plus 1) and the last value.
    """
    v = F.col("value")
    more = [(F.max("sample_index") + 1).alias("length"), F.max_by(v, "sample_index").alias("last")] if ends else []
    out = signals.groupBy(*(keys or KEYS)).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.isnan(v) | v.isNull()), F.lit(False)).alias("has_nan"),
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.avg(v).alias("v_mean"),
        F.stddev_pop(v).alias("v_std"),
        F.max(F.abs(v)).alias("v_abs"),
        *more,
    )
    cols = {c: F.when(F.col("has_nan"), F.lit(NAN)).otherwise(F.col(c)) for c in ("v_min", "v_max", "v_mean", "v_std", "v_abs")}
    return out.withColumns(cols)


def analysis_of(stats: DataFrame) -> DataFrame:
    """Add is_zero, range, noise_floor, dynamic_range_db and snr_db (null for zero channels) to ``channel_stats``."""
    zero = ~F.col("has_nan") & (F.col("v_abs") <= 1e-8)
    span = F.col("v_max") - F.col("v_min")
    std = F.when(span == 0, F.lit(0.0)).otherwise(F.col("v_std"))
    noise = F.greatest(std / F.sqrt(F.lit(2.0)), F.lit(FLOAT64_EPS))
    out = stats.withColumns({"is_zero": zero, "_std": std, "_noise": noise, "_span": span})
    return out.withColumns(
        {
            "range": F.when(F.col("is_zero"), 0.0).otherwise(F.col("_span")),
            "noise_floor": F.when(F.col("is_zero"), FLOAT64_EPS).otherwise(F.col("_noise")),
            "dynamic_range_db": F.when(F.col("is_zero"), 0.0).otherwise(20 * log10_signed(F.col("_span") / F.col("_noise"))),
            "snr_db": F.when(~F.col("is_zero"), 20 * log10_signed(F.col("_std") / F.col("_noise"))),
        }
    ).drop("_std", "_noise", "_span")


def analyze(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return analysis_of(channel_stats(signals, keys))


def suitability(analysis: DataFrame) -> DataFrame:
    """Add use_bdf, reason and snr. NaN figures compare false everywhere and end in the last branch."""
    dr, span = F.col("dynamic_range_db"), F.col("range")
    nan = F.isnan(span) | F.isnan(dr)
    large = ~F.isnan(span) & (span > LARGE)
    edf = ~nan & (dr <= EDF_RANGE_DB - MARGIN_DB)
    bdf = ~nan & (dr <= BDF_RANGE_DB - MARGIN_DB)
    zero = F.col("is_zero")
    db = F.when(F.isnan(dr), F.lit("nan")).otherwise(F.format_string("%.1f", dr))
    reason = (
        F.when(zero, F.lit("Zero signal, using EDF format"))
        .when(large, F.concat(F.lit("Large amplitude signal ("), F.format_string("%.1f", span), F.lit("), using BDF")))
        .when(edf, F.lit(f"EDF dynamic range ({EDF_RANGE_DB} dB) is sufficient"))
        .when(bdf, F.concat(F.lit("Signal requires BDF format (DR: "), db, F.lit(" dB)")))
        .otherwise(F.concat(F.lit("Signal may require higher resolution than BDF (DR: "), db, F.lit(" dB)")))
    )
    use = F.when(zero, False).when(large, True).when(edf, False).otherwise(True)
    return analysis.withColumns({"use_bdf": use, "reason": reason, "snr": F.when(zero, 0.0).otherwise(F.col("snr_db"))})


def file_format(suited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per recording: BDF if any channel needs it; the reason is that of the first such channel by channel_idx."""
    need = F.col("use_bdf")
    reason = F.concat(F.lit("Channel "), F.col("channel"), F.lit(": "), F.col("reason"))
    return suited.groupBy(*(by or ["recording_id"])).agg(F.bool_or(need).alias("use_bdf"), F.min_by(F.when(need, reason), F.when(need, F.col("channel_idx"))).alias("bdf_reason"))


def scaling(stats: DataFrame, bits: int | Column, rounded: bool = False) -> DataFrame:
    """Add physical_min, physical_max, digital_min, digital_max and scaling_factor for 16 or 24 bits (or a column of these).

    Constant channels get a small range around their value, or -1 to 1 at zero. The factor comes from the unrounded limits.
    """
    lo, hi = F.least("v_min", "v_max"), F.greatest("v_min", "v_max")
    flat = is_close(lo, hi)
    margin = F.abs(lo) * 0.001
    pmin = F.when(flat, F.when(is_close(lo, F.lit(0.0)), F.lit(-1.0)).otherwise(lo - margin)).otherwise(lo)
    pmax = F.when(flat, F.when(is_close(lo, F.lit(0.0)), F.lit(1.0)).otherwise(hi + margin)).otherwise(hi)
    wide = (bits == 24) if isinstance(bits, Column) else F.lit(bits == 24)
    dmin = F.when(wide, DIGITAL[24][0]).otherwise(DIGITAL[16][0])
    dmax = F.when(wide, DIGITAL[24][1]).otherwise(DIGITAL[16][1])
    out = stats.withColumns({"physical_min": pmin, "physical_max": pmax, "digital_min": dmin, "digital_max": dmax})
    out = out.withColumn("scaling_factor", (F.col("digital_max") - F.col("digital_min") - 1) / (F.col("physical_max") - F.col("physical_min")))
    if rounded:
        out = out.withColumns({"physical_min": round_physical(F.col("physical_min")), "physical_max": round_physical(F.col("physical_max"))})
    return out


def _step_size(bits: int) -> Column:
    return (F.col("v_max") - F.col("v_min")) / 2.0**bits


def _rounding_sums(step: Column) -> list[Column]:
    """Of samples rounded to steps: the largest error, and the mean squares of errors and of samples."""
    v = F.col("value")
    e = v - F.when(step == 0, F.lit(NAN)).otherwise(F.rint(v / F.nullif(step, F.lit(0.0))) * step)
    return [F.max(F.abs(e)), F.avg(e * e), F.avg(v * v)]


def _rounding_figures(noise: Column, power: Column) -> tuple[Column, Column]:
    """RMSE, and SNR over a noise of no less than the smallest step of a double."""
    least = F.when(F.isnan(noise), noise).otherwise(F.greatest(noise, F.lit(FLOAT64_EPS)))
    return F.sqrt(noise), 10 * log10_signed(power / least)


def _loss_sums(factor: Column, low: Column, high: Column) -> list[Column]:
    """Of samples scaled, rounded, clipped and scaled back: whether any is above the bound, the largest relative error, whether any differs."""
    v = F.col("value")
    back = F.greatest(F.least(F.rint(v * factor), high.cast("double")), low.cast("double")) / factor
    above = F.abs(v) > FLOAT32_EPS * 1e3
    inner = (F.col("sample_index") >= 5) & (F.col("sample_index") < F.col("n") - 5)
    diff = F.abs(v - back)
    return [F.bool_or(above), F.max(F.when(above & inner, diff / F.nullif(F.abs(v), F.lit(0.0))).otherwise(0.0)), F.bool_or(diff > 0)]


def _loss_figure(some: Column, loss: Column, differs: Column) -> Column:
    pct = loss * 100
    return F.when(~some, 0.0).when((pct < FLOAT32_EPS) & differs, 1e-6).otherwise(pct)


def quantize(signals: DataFrame, bits: int, keys: list[str] | None = None) -> DataFrame:
    """Step size, largest error, RMSE and SNR of rounding to 2^bits steps of the channel's range. A flat channel has NaN errors."""
    keys = keys or KEYS
    steps = channel_stats(signals, keys).select(*keys, _step_size(bits).alias("step_size"))
    sums = [c.alias(name) for c, name in zip(_rounding_sums(F.col("step_size")), ("max_error", "_noise", "_power"), strict=True)]
    out = signals.join(known_rows(steps), keys).groupBy(*keys, "step_size").agg(*sums)
    rmse, snr = _rounding_figures(F.col("_noise"), F.col("_power"))
    return out.select(*keys, "step_size", "max_error", rmse.alias("rmse"), snr.alias("snr"))


def precision_loss(signals: DataFrame, limits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest relative error, in percent, of samples above 1.19e-4 outside the first and last five, after scaling and clipping.

    ``limits`` has the keys, n, scaling_factor, digital_min and digital_max. No offset is applied, so a one-sided signal
    clips. 0 if no sample is above the bound; 1e-6 if no such error shows but some sample differs.
    """
    keys = keys or KEYS
    joined = signals.join(known_rows(limits.select(*keys, "n", "scaling_factor", "digital_min", "digital_max")), keys)
    sums = [c.alias(name) for c, name in zip(_loss_sums(F.col("scaling_factor"), F.col("digital_min"), F.col("digital_max")), ("_any", "_loss", "_diff"), strict=True)]
    return joined.groupBy(*keys).agg(*sums).select(*keys, _loss_figure(F.col("_any"), F.col("_loss"), F.col("_diff")).alias("precision_loss"))


def export_figures(signals: DataFrame, depths: tuple[int, ...] = (16, 24), keys: list[str] | None = None) -> DataFrame:
    """What ``quantize`` and ``precision_loss`` tell at several bit depths, one row per channel and depth, from two scans in all.

    The first scan finds the channels' ranges, and so the limits at every depth; the second sums for all depths at once.
    """
    keys = keys or KEYS
    stats = channel_stats(signals, keys)
    for b in depths:
        at = F.struct(_step_size(b).alias("step"), F.col("scaling_factor").alias("factor"), F.col("digital_min").alias("low"), F.col("digital_max").alias("high"))
        stats = scaling(stats, b).select(*stats.columns, at.alias(f"_at{b}"))
    limits = stats.select(*keys, "n", *[f"_at{b}" for b in depths])
    sums = []
    for b in depths:
        at = F.col(f"_at{b}")
        sums += [F.first(at.step).alias(f"step{b}")]
        sums += [c.alias(f"sum{b}_{k}") for k, c in enumerate(_rounding_sums(at.step) + _loss_sums(at.factor, at.low, at.high))]
    rows = []
    for b in depths:
        error, noise, power, *loss = (F.col(f"sum{b}_{k}") for k in range(6))
        rmse, snr = _rounding_figures(noise, power)
        rows.append(F.struct(F.lit(b).alias("bits"), F.col(f"step{b}").alias("step_size"), error.alias("max_error"), rmse.alias("rmse"), snr.alias("snr"), _loss_figure(*loss).alias("precision_loss")))
    return signals.join(known_rows(limits), keys).groupBy(*keys).agg(*sums).select(*keys, F.inline(F.array(*rows)))


def digital_code() -> Column:
    """The sample on the digital scale between its channel's physical limits, rounded half to even and clamped."""
    x = to_digital(*(F.col(c) for c in ("value", "physical_min", "physical_max", "digital_min", "digital_max")))
    return F.least(F.greatest(F.rint(x), F.col("digital_min").cast("double")), F.col("digital_max").cast("double")).cast("int")


def digitize(signals: DataFrame, limits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add digital, the ``digital_code`` of each sample."""
    keys = keys or KEYS
    lim = limits.select(*keys, "physical_min", "physical_max", "digital_min", "digital_max")
    return signals.join(known_rows(lim), keys).withColumn("digital", digital_code())


def physical(digital: Column, pmin: Column, pmax: Column, dmin: Column, dmax: Column) -> Column:
    return to_physical(digital, pmin, pmax, dmin, dmax)


def type_summary(suited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per channel type: counts, unit of the first channel, and range, dynamic range and SNR over non-zero channels."""
    live = ~F.col("is_zero")
    parts = [F.count(F.lit(1)).alias("n_channels"), F.count_if(live).alias("n_nonzero"), F.min_by("physical_dimension", "channel_idx").alias("unit"), F.min("channel_idx").alias("first_idx")]
    for c, name in (("range", "range"), ("dynamic_range_db", "dr"), ("snr_db", "snr")):
        x = F.when(live, F.col(c))
        parts += [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean")]
    parts += [F.count_if(live & ~F.col("use_bdf")).alias("n_edf"), F.count_if(live & F.col("use_bdf")).alias("n_bdf")]
    return suited.groupBy(*(by or []), "channel_type").agg(*parts)


def summary_text(summary: DataFrame) -> str:
    """The summary as text; one line group for each type, of which there are few."""
    lines = []
    for r in summary.orderBy("first_idx").collect():
        lines.append(f"\nChannel Type: {r['channel_type']} ({r['n_channels']} channels)")
        if not r["n_nonzero"]:
            lines.append("All channels contain zero signal")
            continue
        lines += [
            f"Range: {r['range_min']:.2f} to {r['range_max']:.2f} (mean: {r['range_mean']:.2f}) {r['unit']}",
            f"Dynamic Range: {r['dr_min']:.1f} to {r['dr_max']:.1f} (mean: {r['dr_mean']:.1f}) dB",
            f"SNR: {r['snr_min']:.1f} to {r['snr_max']:.1f} (mean: {r['snr_mean']:.1f}) dB",
            f"Format: {r['n_edf']} channels using EDF, {r['n_bdf']} channels using BDF",
        ]
    return "\n".join(lines)
