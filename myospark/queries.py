"""Queries of the engine over the shared test tables, with the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import analysis as an
from .operators import plotframe
from .plans.adapters import from_arrays, from_long, from_wide, with_ordinal
from .recording import Recording, latest_metadata
from .sinks.tsv import channels_tsv, edf_header_fields

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_TYPE = {"l_quantity": "EMG", "l_extendedprice": "ACC", "l_discount": "OTHER", "l_tax": "OTHER"}
LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
RATE = 1000.0


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark: SparkSession, d: str, channels: list[str] | None = None) -> DataFrame:
    return from_wide(_t(spark, d, "lineitem"), channels or LI)


def lineitem_channels(spark: SparkSession) -> DataFrame:
    rows = [(c, i, LI_TYPE[c], RATE, "mV" if LI_TYPE[c] == "EMG" else "g", "n/a") for i, c in enumerate(LI)]
    return spark.createDataFrame(rows, "channel string, channel_idx int, channel_type string, sample_frequency double, physical_dimension string, prefilter string")


def _micros(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def events(spark: SparkSession, d: str, index: bool = False) -> DataFrame:
    """Events as channels by type, in the order of time; the index is numbered by hours."""
    e = _t(spark, d, "events").withColumn("us", _micros())
    if index:
        e = with_ordinal(e, ["event_type"], ["us"], F.floor(F.col("us") / 3_600_000_000))
        return from_long(e, "event_type", "value", keep=["sample_index"]).withColumn("t", fn.sample_time(F.col("sample_index"), F.lit(RATE)))
    return from_long(e, "event_type", "value")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return from_arrays(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")


def _r(name: str, digits: int = 6):
    """Rounded, with -0.0 as 0.0."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


# --- SQL building blocks -------------------------------------------------------------------------------------------

_LI_SQL = "li AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {i} AS channel_idx, {c}::DOUBLE AS value FROM lineitem" for i, c in enumerate(LI)) + ")"
_EV_SQL = "ev AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS sample_index, value::DOUBLE AS value FROM events)"
_EM_SQL = "em AS (SELECT vec_id::VARCHAR AS channel, label::VARCHAR AS channel_type, unnest(range(len(embedding))) AS sample_index, unnest(embedding)::DOUBLE AS value FROM embeddings)"
_EPS64, _EPS32 = repr(fn.FLOAT64_EPS), repr(fn.FLOAT32_EPS)


def _stats_sql(src: str, name: str = "st", keys: str = "channel") -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS n, min(value) AS v_min, max(value) AS v_max, avg(value) AS v_mean, stddev_pop(value) AS v_std, max(abs(value)) AS v_abs FROM {src} GROUP BY {keys})"""


_LOG = "CASE WHEN ({x}) = 0 THEN '-inf'::DOUBLE ELSE log10({x}) END"


def _analysis_sql(st: str = "st", name: str = "an", keys: str = "channel") -> str:
    noise = f"greatest(CASE WHEN v_max = v_min THEN 0e0 ELSE v_std END / sqrt(2e0), {_EPS64})"
    return f"""{name} AS (SELECT {keys}, n, v_abs <= 1e-8 AS is_zero, CASE WHEN v_abs <= 1e-8 THEN 0e0 ELSE v_max - v_min END AS range,
      CASE WHEN v_abs <= 1e-8 THEN {_EPS64} ELSE {noise} END AS noise_floor,
      CASE WHEN v_abs <= 1e-8 THEN 0e0 ELSE 20 * {_LOG.format(x=f"(v_max - v_min) / {noise}")} END AS dynamic_range_db,
      CASE WHEN v_abs <= 1e-8 THEN NULL ELSE 20 * {_LOG.format(x=f"CASE WHEN v_max = v_min THEN 0e0 ELSE v_std END / {noise}")} END AS snr_db FROM {st})"""


def _suit_sql(an: str = "an", name: str = "su", keys: str = "channel") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN is_zero THEN false WHEN range > 1e5 THEN true WHEN dynamic_range_db <= 90 THEN false ELSE true END AS use_bdf,
      CASE WHEN is_zero THEN 'Zero signal, using EDF format' WHEN range > 1e5 THEN printf('Large amplitude signal (%.1f), using BDF', range)
           WHEN dynamic_range_db <= 90 THEN 'EDF dynamic range (96 dB) is sufficient'
           WHEN dynamic_range_db <= 138 THEN printf('Signal requires BDF format (DR: %.1f dB)', dynamic_range_db)
           ELSE printf('Signal may require higher resolution than BDF (DR: %.1f dB)', dynamic_range_db) END AS reason FROM {an})"""


def _scale_sql(bits: int, st: str = "st", name: str = "sc") -> str:
    dmin, dmax = an.DIGITAL[bits]
    flat, zero = "abs(v_min - v_max) <= 1e-8 + 1e-5 * abs(v_max)", "abs(v_min) <= 1e-8"
    pmin = f"CASE WHEN {flat} THEN CASE WHEN {zero} THEN -1e0 ELSE v_min - abs(v_min) * 1e-3 END ELSE v_min END"
    pmax = f"CASE WHEN {flat} THEN CASE WHEN {zero} THEN 1e0 ELSE v_max + abs(v_min) * 1e-3 END ELSE v_max END"
    return f"""{name} AS (SELECT channel, n, {pmin} AS physical_min, {pmax} AS physical_max, {dmin}::INTEGER AS digital_min, {dmax}::INTEGER AS digital_max,
      {dmax - dmin - 1} / ({pmax} - {pmin}) AS scaling_factor FROM {st})"""


# --- queries -------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"WITH {_EV_SQL} SELECT channel, sample_index, sample_index / {RATE}e0 AS t, value FROM ev")
def add_channel_time_index(spark, d):
    return events(spark, d, index=True).select("channel", "sample_index", "t", "value")


@_query(f"WITH {_LI_SQL} SELECT channel, channel_idx::INTEGER AS channel_idx, value FROM li")
def wide_to_long(spark, d):
    return lineitem(spark, d).select("channel", "channel_idx", "value")


@_query(f"WITH {_LI_SQL} SELECT channel, CASE channel WHEN 'l_tax' THEN 0 ELSE 1 END::INTEGER AS channel_idx, count(*) AS n, round(sum(value), 4) AS total FROM li WHERE channel IN ('l_tax', 'l_quantity') GROUP BY ALL")
def select_by_name(spark, d):
    names = ["l_tax", "l_quantity"]
    rec = Recording(spark, lineitem(spark, d), lineitem_channels(spark)).select_channels(names)
    return rec.signals.groupBy("channel", "channel_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("channel", "channel_idx", "n", _r("total", 4))


def embeddings_recording(spark: SparkSession, d: str) -> Recording:
    channels = _t(spark, d, "embeddings").select(F.lit("recording").alias("recording_id"), F.col("vec_id").cast("int").alias("channel_idx"), F.col("vec_id").cast("string").alias("channel"), F.col("label").cast("string").alias("channel_type"))
    return Recording(spark, embeddings(spark, d), channels)


@_query("WITH " + _EM_SQL + " SELECT channel, sample_index, value FROM em WHERE channel_type = '1'")
def select_by_type(spark, d):
    return embeddings_recording(spark, d).select_channels(channel_type="1").signals.select("channel", "sample_index", "value")


@_query("WITH " + _EM_SQL + " SELECT channel, sample_index, value FROM em WHERE channel_type = '1' AND channel IN ('1', '2', '3', '5', '8', '13', '21')")
def select_name_and_type(spark, d):
    rec = embeddings_recording(spark, d)
    try:
        rec = rec.select_channels(["1", "2", "3", "5", "8", "13", "21"], "1")
    except ValueError:  # none of them is of the type
        return rec.signals.where("false").select("channel", "sample_index", "value")
    return rec.signals.select("channel", "sample_index", "value")


@_query("SELECT DISTINCT label::VARCHAR AS channel_type FROM embeddings")
def channel_types(spark, d):
    return embeddings_recording(spark, d).channel_types()


@_query("SELECT vec_id::VARCHAR AS channel FROM embeddings WHERE label = 2")
def channels_by_type(spark, d):
    return embeddings_recording(spark, d).channels_of_type("2").select("channel")


@_query("SELECT label::VARCHAR AS channel_type, count(*) AS n FROM embeddings GROUP BY label")
def channel_counts(spark, d):
    return embeddings_recording(spark, d).channel_counts().withColumnRenamed("count", "n")


@_query("SELECT user_id::VARCHAR AS recording_id, 'k' AS key, arg_max(json_extract_string(props, '$.k'), ts) AS value FROM events GROUP BY user_id")
def metadata_upsert_lookup(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("recording_id"), F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value"), _micros().alias("seq"))
    return latest_metadata(rows)


@_query(f"WITH {_EV_SQL} SELECT channel, sample_index, value FROM ev WHERE sample_index / {RATE}e0 BETWEEN 0.1 AND 0.25")
def time_range(spark, d):
    return plotframe.time_range(events(spark, d, index=True), 0.1, 0.25).select("channel", "sample_index", "value")


@_query(
    f"""WITH {_EV_SQL}, b AS (SELECT channel, max(sample_index) / {RATE}e0 AS t1 FROM ev GROUP BY channel),
    p AS (SELECT channel, sample_index, value, floor(sample_index / {RATE}e0 / (SELECT max(t1) FROM b) * 200) AS px FROM ev),
    x AS (SELECT channel, min(sample_index) AS a, max(sample_index) AS b, arg_min(sample_index, (value, sample_index)) AS c, arg_min(sample_index, (-value, sample_index)) AS d FROM p GROUP BY channel, least(px, 199))
    SELECT DISTINCT channel, sample_index, value FROM (SELECT channel, unnest([a, b, c, d]) AS sample_index FROM x) JOIN ev USING (channel, sample_index)"""
)
def plot_in_pixels(spark, d):
    """First, last, least and largest sample of each of 200 pixel columns: what a plot of that width shows of all samples."""
    return plotframe.in_pixels(events(spark, d, index=True), 200).select("channel", "sample_index", "value")


@_query(f"WITH {_EV_SQL}, m AS (SELECT channel, avg(value) AS m FROM ev GROUP BY channel) SELECT channel, sample_index, round(value - m, 6) + 0e0 AS value FROM ev JOIN m USING (channel)")
def detrend(spark, d):
    return plotframe.detrended(events(spark, d, index=True)).select("channel", "sample_index", _r("value"))


def _order(spark: SparkSession, d: str) -> DataFrame:
    kinds = _t(spark, d, "events").select(F.col("event_type").alias("channel")).distinct()
    ordered = F.array_sort(F.collect_list("channel"))
    one = kinds.agg(ordered.alias("all"))  # a handful of event types
    return one.select(F.posexplode("all").alias("pos", "channel"), F.size("all").alias("n"))


_PLOT = """WITH {ev}, m AS (SELECT channel, avg(value) AS m, max(value) - min(value) AS span FROM ev GROUP BY channel),
o AS (SELECT channel, m, span, row_number() OVER (ORDER BY channel) - 1 AS pos, count(*) OVER () AS n, max(span) OVER () AS widest FROM m)
SELECT channel, sample_index, (n - pos - 1)::DOUBLE AS "offset", round({value} * (0.8 / {span}) + (n - pos - 1), 6) + 0e0 AS y FROM ev JOIN o USING (channel)"""


@_query(_PLOT.format(ev=_EV_SQL, value="(value - m)", span="widest"))
def plot_uniform(spark, d):
    return plotframe.plot_frame(events(spark, d, index=True), _order(spark, d), detrend=True).select("channel", "sample_index", "offset", _r("y"))


@_query(_PLOT.format(ev=_EV_SQL, value="value", span="span"))
def plot_per_channel(spark, d):
    return plotframe.plot_frame(events(spark, d, index=True), _order(spark, d), uniform_scale=False).select("channel", "sample_index", "offset", _r("y"))


_STACK = "WITH {ev}, o AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS pos FROM (SELECT DISTINCT channel FROM ev)) SELECT channel, sample_index, round({y}, 6) + 0e0 AS y FROM ev JOIN o USING (channel)"


@_query(_STACK.format(ev=_EV_SQL, y="value / 2 / (SELECT max(abs(value)) FROM ev) - pos"))
def plot_stacked_normalized(spark, d):
    return plotframe.stacked_normalized(events(spark, d, index=True), _order(spark, d)).select("channel", "sample_index", _r("y"))


@_query(_STACK.format(ev=_EV_SQL, y="value - pos * 2.5e0"))
def plot_stacked_shifted(spark, d):
    return plotframe.stacked_shifted(events(spark, d, index=True), _order(spark, d), 2.5).select("channel", "sample_index", _r("y"))


def _shared(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """Rows that the query and its oracle derive from a given table by the same statement."""
    for name in ("customer", "events", "lineitem", "orders", "part", "supplier"):
        if f"FROM {name}" in sql:
            return spark.sql(sql.replace(f"FROM {name}", "FROM {given}"), given=_t(spark, d, name))
    raise ValueError(sql)


_PLACES = "SELECT DISTINCT concat('CH', user_id + 1) AS name FROM events"


@_query(f"SELECT name, TRY_CAST(substr(name, 3) AS INTEGER) - 1 AS place FROM ({_PLACES})")
def channel_place(spark, d):
    return _shared(spark, d, _PLACES).withColumn("place", fn.channel_place(F.col("name")))


_BLANKS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat(' ', o_orderpriority, ' ') WHEN 1 THEN '' WHEN 2 THEN '   ' END AS x FROM orders"


@_query(f"SELECT o_orderkey, coalesce(nullif(trim(x), ''), 'n/a') AS x FROM ({_BLANKS})")
def blank_as_na(spark, d):
    return _shared(spark, d, _BLANKS).select("o_orderkey", fn.or_na(F.col("x")).alias("x"))


_AN_COLS = "n, is_zero, round(range, 6) + 0e0 AS range, round(noise_floor, 6) + 0e0 AS noise_floor, round(dynamic_range_db, 6) + 0e0 AS dynamic_range_db, round(snr_db, 6) + 0e0 AS snr_db"


def _rounded_analysis(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", "is_zero", _r("range"), _r("noise_floor"), _r("dynamic_range_db"), _r("snr_db"))


@_query(f"WITH {_LI_SQL}, {_stats_sql('li')}, {_analysis_sql()} SELECT channel, {_AN_COLS} FROM an")
def analyze_signal(spark, d):
    return _rounded_analysis(an.analyze(lineitem(spark, d)), "channel")


@_query(f"WITH {_EM_SQL}, {_stats_sql('em')}, {_analysis_sql()} SELECT channel, {_AN_COLS} FROM an")
def analyze_frames(spark, d):
    return _rounded_analysis(an.analyze(embeddings(spark, d)), "channel")


_EDGE = """SELECT CASE l_orderkey % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'constant' WHEN 2 THEN 'nan' ELSE 'ramp' END AS channel,
    CASE l_orderkey % 4 WHEN 0 THEN l_tax * 1e-9 WHEN 1 THEN 5e0 WHEN 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END ELSE l_quantity - 20 END AS value FROM lineitem"""


@_query(
    f"""WITH e AS ({_EDGE}), {_stats_sql("(SELECT * FROM e WHERE channel <> 'nan')")}, {_analysis_sql()}, {_suit_sql()}
    SELECT channel, {_AN_COLS}, use_bdf, reason FROM su UNION ALL
    SELECT channel, count(*), false, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, true, 'Signal may require higher resolution than BDF (DR: nan dB)' FROM e WHERE channel = 'nan' GROUP BY channel HAVING bool_or(isnan(value))"""
)
def analyze_edge_cases(spark, d):
    """All-zero, constant and one-sided channels, and one with NaN samples."""
    out = an.suitability(an.analyze(_shared(spark, d, _EDGE), ["channel"]))
    return out.select("channel", "n", "is_zero", _r("range"), _r("noise_floor"), _r("dynamic_range_db"), _r("snr_db"), "use_bdf", "reason")


@_query(f"WITH {_LI_SQL}, {_stats_sql('li')}, {_analysis_sql()}, {_suit_sql()} SELECT channel, use_bdf, reason FROM su")
def format_suitability(spark, d):
    return an.suitability(an.analyze(lineitem(spark, d))).select("channel", "use_bdf", "reason")


@_query(
    f"""WITH {_LI_SQL}, {_stats_sql('li', keys='channel, channel_idx')}, {_analysis_sql(keys='channel, channel_idx')}, {_suit_sql()}
    SELECT 'recording' AS recording_id, bool_or(use_bdf) AS use_bdf, arg_min('Channel ' || channel || ': ' || reason, channel_idx) FILTER (WHERE use_bdf) AS bdf_reason FROM su"""
)
def file_format_decision(spark, d):
    suited = an.suitability(an.analyze(lineitem(spark, d), ["recording_id", "channel", "channel_idx"]))
    return an.file_format(suited)


_SCALE_COLS = "channel, round(physical_min, 6) + 0e0 AS physical_min, round(physical_max, 6) + 0e0 AS physical_max, digital_min, digital_max, round(scaling_factor, 6) + 0e0 AS scaling_factor"


def _rounded_scaling(df: DataFrame) -> DataFrame:
    return df.select("channel", _r("physical_min"), _r("physical_max"), "digital_min", "digital_max", _r("scaling_factor"))


@_query(f"WITH {_LI_SQL}, {_stats_sql('li')}, {_scale_sql(16)} SELECT {_SCALE_COLS} FROM sc")
def scaling_factors_16(spark, d):
    return _rounded_scaling(an.scaling(an.channel_stats(lineitem(spark, d)), 16))


@_query(f"WITH {_EV_SQL}, {_stats_sql('ev')}, {_scale_sql(24)} SELECT {_SCALE_COLS} FROM sc")
def scaling_factors_24(spark, d):
    return _rounded_scaling(an.scaling(an.channel_stats(events(spark, d)), 24))


def _phys_round_sql(c: str) -> str:
    cases = " ".join(f"WHEN length(format('{{:g}}', round_even({c}, {k}))) <= 8 THEN round_even({c}, {k})" for k in range(6, -1, -1))
    return f"CASE {cases} ELSE round_even({c}, 0) END"


@_query(f"WITH {_LI_SQL}, {_stats_sql('li')}, {_scale_sql(16)} SELECT channel, {_phys_round_sql('physical_min')} AS physical_min, {_phys_round_sql('physical_max')} AS physical_max FROM sc")
def physical_limits_rounded(spark, d):
    return an.scaling(an.channel_stats(lineitem(spark, d)), 16, rounded=True).select("channel", "physical_min", "physical_max")


def _quant_sql(bits: int, rows: str = _LI_SQL, table: str = "li") -> str:
    return f"""WITH {rows}, s AS (SELECT channel, (max(value) - min(value)) / {2.0**bits}e0 AS step_size FROM {table} GROUP BY channel),
    e AS (SELECT channel, step_size, value, value - round_even(value / step_size, 0) * step_size AS e FROM {table} JOIN s USING (channel)),
    a AS (SELECT channel, step_size, max(abs(e)) AS max_error, avg(e * e) AS noise, avg(value * value) AS power FROM e GROUP BY ALL)
    SELECT channel, round(step_size, 9) AS step_size, round(max_error, 9) AS max_error, round(sqrt(noise), 9) AS rmse, round(10 * log10(power / greatest(noise, {_EPS64})), 4) AS snr FROM a"""


def _quant(spark, d, bits):
    return an.quantize(lineitem(spark, d), bits).select("channel", _r("step_size", 9), _r("max_error", 9), _r("rmse", 9), _r("snr", 4))


@_query(_quant_sql(16))
def quantization_16(spark, d):
    return _quant(spark, d, 16)


@_query(_quant_sql(24))
def quantization_24(spark, d):
    return _quant(spark, d, 24)


def _loss_sql(bits: int) -> str:
    return f"""WITH {_EV_SQL}, {_stats_sql('ev')}, {_scale_sql(bits)},
    x AS (SELECT channel, sample_index, n, value, greatest(least(round_even(value * scaling_factor, 0), digital_max), digital_min) / scaling_factor AS back FROM ev JOIN sc USING (channel)),
    a AS (SELECT channel, bool_or(abs(value) > {_EPS32} * 1e3) AS above, bool_or(abs(value - back) > 0) AS diff,
          max(CASE WHEN abs(value) > {_EPS32} * 1e3 AND sample_index >= 5 AND sample_index < n - 5 THEN abs(value - back) / abs(value) ELSE 0 END) * 100 AS pct FROM x GROUP BY channel)
    SELECT channel, round(CASE WHEN NOT above THEN 0e0 WHEN pct < {_EPS32} AND diff THEN 1e-6 ELSE pct END, 6) AS precision_loss FROM a"""


@_query(_loss_sql(16))
def precision_loss(spark, d):
    return an.precision_loss(events(spark, d, index=True), an.scaling(an.channel_stats(events(spark, d)), 16)).select("channel", _r("precision_loss"))


@_query(" UNION ALL ".join(f"SELECT channel, {b} AS bits, step_size, max_error, rmse, snr, precision_loss FROM ({_quant_sql(b, _EV_SQL, 'ev')}) JOIN ({_loss_sql(b)}) USING (channel)" for b in (16, 24)))
def export_figures(spark, d):
    """Both bit depths, errors and loss, from one scan for ranges and one for sums."""
    return an.export_figures(events(spark, d, index=True)).select("channel", "bits", _r("step_size", 9), _r("max_error", 9), _r("rmse", 9), _r("snr", 4), _r("precision_loss"))


def _digit_sql(bits: int, tail: str) -> str:
    return f"""WITH {_EV_SQL}, {_stats_sql('ev')}, {_scale_sql(bits)},
    g AS (SELECT channel, sample_index, value, sc.* EXCLUDE (channel, n), least(greatest(round_even((value - physical_min) * (digital_max - digital_min) / (physical_max - physical_min) + digital_min, 0), digital_min), digital_max)::INTEGER AS digital FROM ev JOIN sc USING (channel)) {tail}"""


def _digits(spark, d, bits):
    return an.digitize(events(spark, d, index=True), an.scaling(an.channel_stats(events(spark, d)), bits))


@_query(_digit_sql(16, "SELECT channel, sample_index, digital FROM g"))
def digitize_16(spark, d):
    return _digits(spark, d, 16).select("channel", "sample_index", "digital")


@_query(_digit_sql(24, "SELECT channel, sample_index, digital FROM g"))
def digitize_24(spark, d):
    return _digits(spark, d, 24).select("channel", "sample_index", "digital")


@_query(_digit_sql(16, "SELECT channel, round(corr(value, (digital - digital_min) * (physical_max - physical_min) / (digital_max - digital_min) + physical_min), 9) AS r FROM g GROUP BY channel"))
def roundtrip_corr(spark, d):
    g = _digits(spark, d, 16)
    back = fn_physical()
    return g.groupBy("channel").agg(F.corr("value", back).alias("r")).select("channel", _r("r", 9))


def fn_physical():
    return an.physical(F.col("digital"), F.col("physical_min"), F.col("physical_max"), F.col("digital_min"), F.col("digital_max"))


@_query(
    f"""WITH {_EM_SQL}, {_stats_sql('em', keys='channel, channel_type')}, {_analysis_sql(keys='channel, channel_type')}, {_suit_sql()}
    SELECT channel_type, count(*) AS n_channels, round(min(range) FILTER (WHERE NOT is_zero), 6) AS range_min, round(max(range) FILTER (WHERE NOT is_zero), 6) AS range_max,
    round(avg(range) FILTER (WHERE NOT is_zero), 6) AS range_mean, arg_min('unit ' || channel, channel::INTEGER) AS unit, round(min(dynamic_range_db) FILTER (WHERE NOT is_zero), 6) AS dr_min, round(max(dynamic_range_db) FILTER (WHERE NOT is_zero), 6) AS dr_max,
    round(avg(dynamic_range_db) FILTER (WHERE NOT is_zero), 6) AS dr_mean, round(min(snr_db) FILTER (WHERE NOT is_zero), 6) AS snr_min, round(max(snr_db) FILTER (WHERE NOT is_zero), 6) AS snr_max, round(avg(snr_db) FILTER (WHERE NOT is_zero), 6) AS snr_mean, count(*) FILTER (WHERE NOT is_zero AND NOT use_bdf) AS n_edf, count(*) FILTER (WHERE NOT is_zero AND use_bdf) AS n_bdf FROM su GROUP BY channel_type"""
)
def type_summary(spark, d):
    suited = an.suitability(an.analyze(embeddings(spark, d), ["channel", "channel_type"])).withColumns({"channel_idx": F.col("channel").cast("int"), "physical_dimension": F.concat(F.lit("unit "), "channel")})
    figures = [f"{of}_{what}" for of in ("range", "dr", "snr") for what in ("min", "max", "mean")]
    return an.type_summary(suited).select("channel_type", "n_channels", "unit", *[_r(c) for c in figures], "n_edf", "n_bdf")


@_query(
    f"""WITH {_LI_SQL} SELECT channel, round(max(CASE channel WHEN 'l_quantity' THEN value * (3.3e0 / 65536 * 1000) / 200 ELSE value END), 9) AS top,
    round(sum(CASE channel WHEN 'l_quantity' THEN value * (3.3e0 / 65536 * 1000) / 200 ELSE value END), 4) AS total FROM li GROUP BY channel"""
)
def otb_gain_scale(spark, d):
    kind = F.when(F.col("channel") == "l_quantity", "EMG").otherwise("OTHER")
    x = lineitem(spark, d).withColumn("mv", fn.otb_gain_scale(F.col("value"), kind, 16, F.lit(200.0)))
    return x.groupBy("channel").agg(F.max("mv").alias("top"), F.sum("mv").alias("total")).select("channel", _r("top", 9), _r("total", 4))


@_query("SELECT l_orderkey, l_linenumber, (((l_partkey % 65536 - 32768) * 256) + (l_suppkey & 255))::INTEGER AS value FROM lineitem")
def combine_24bit(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.combine_24bit(F.col("l_partkey") % 65536 - 32768, F.col("l_suppkey")).alias("value"))


_LABELS = """SELECT event_id, concat(CASE event_id % 6 WHEN 0 THEN 'EMG' WHEN 1 THEN 'acc ' WHEN 2 THEN 'ACC' WHEN 3 THEN 'GYRO' WHEN 4 THEN 'Trig' ELSE '' END, event_type, event_id) AS label,
    CASE user_id % 7 WHEN 0 THEN 'EMG sensor' WHEN 1 THEN 'Accelerometer' WHEN 2 THEN 'ACC sensor' WHEN 3 THEN 'gyroscope' WHEN 4 THEN 'trigger box' WHEN 5 THEN 'n/a' ELSE '' END AS transducer FROM events"""


@_query(
    f"""SELECT label, transducer, CASE WHEN contains(upper(label), 'EMG') OR contains(upper(transducer), 'EMG') THEN 'EMG' WHEN contains(upper(label), 'ACC') OR contains(upper(transducer), 'ACCELEROMETER') THEN 'ACC'
    WHEN contains(upper(label), 'GYRO') OR contains(upper(transducer), 'GYROSCOPE') THEN 'GYRO' WHEN contains(upper(label), 'TRIG') OR contains(upper(transducer), 'TRIGGER') THEN 'TRIG' ELSE 'OTHER' END AS channel_type FROM ({_LABELS})"""
)
def classify_edf(spark, d):
    return _shared(spark, d, _LABELS).select("label", "transducer", fn.classify_edf(F.col("label"), F.col("transducer")).alias("channel_type"))


@_query(f"SELECT label, CASE WHEN contains(label, 'EMG') THEN 'EMG' WHEN contains(label, 'ACC') THEN 'ACC' WHEN contains(label, 'GYRO') THEN 'GYRO' ELSE 'OTHER' END AS channel_type FROM ({_LABELS})")
def classify_trigno(spark, d):
    return _shared(spark, d, _LABELS).select("label", fn.classify_trigno(F.col("label")).alias("channel_type"))


_ADAPTERS = """SELECT event_id, concat(CASE user_id % 8 WHEN 0 THEN 'Due+' WHEN 1 THEN 'Sessantaquattro' WHEN 2 THEN 'ACC' WHEN 3 THEN 'GYRO' WHEN 4 THEN 'Control' ELSE 'Aux' END, user_id) AS adapter,
    CASE event_id % 5 WHEN 0 THEN 'Acceleration X' WHEN 1 THEN 'Gyroscope' ELSE event_type END AS description, CASE event_id % 3 WHEN 0 THEN 'Quaternion 1' ELSE '' END AS channel_id FROM events"""
_OTB_KIND = "CASE WHEN regexp_matches(adapter, 'Due|Muovi|Sessantaquattro|Novecento|Quattro|Quattrocento') THEN 'EMG' WHEN contains(adapter, 'ACC') OR contains(description, 'Acceleration') THEN 'ACC' WHEN contains(adapter, 'GYRO') OR contains(description, 'Gyroscope') THEN 'GYRO' WHEN contains(channel_id, 'Quaternion') THEN 'QUAT' WHEN contains(adapter, 'Control') THEN 'CTRL' ELSE 'OTHER' END"


@_query(f"SELECT event_id, adapter, description, channel_id, {_OTB_KIND} AS channel_type FROM ({_ADAPTERS})")
def classify_otb(spark, d):
    return _shared(spark, d, _ADAPTERS).withColumn("channel_type", fn.classify_otb(F.col("adapter"), F.col("description"), F.col("channel_id")))


@_query(f"SELECT t AS channel_type, CASE WHEN t = 'EMG' THEN 'mV' WHEN t IN ('ACC', 'GYRO') THEN 'g' WHEN t = 'QUAT' THEN 'rad' ELSE 'a.u.' END AS unit FROM (SELECT DISTINCT {_OTB_KIND} AS t FROM ({_ADAPTERS}))")
def unit_by_type(spark, d):
    kinds = _shared(spark, d, _ADAPTERS).select(fn.classify_otb(F.col("adapter"), F.col("description"), F.col("channel_id")).alias("channel_type")).distinct()
    return kinds.withColumn("unit", fn.unit_of(F.col("channel_type")))


_LINES = """SELECT CASE c_custkey % 4 WHEN 0 THEN concat('Label: ', c_name, ' Sampling frequency: ', c_custkey + 1000, '.5 Unit: mV Domain: ', c_nationkey)
    WHEN 1 THEN concat('Label: ACC ', c_name, ' Sampling frequency: 148.148 Hz Unit: ', c_mktsegment, ' Domain: 2') WHEN 2 THEN c_name ELSE concat('Label: ', c_name) END AS line FROM customer"""


@_query(f"SELECT nullif(trim(regexp_extract(line, 'Label:(.*?)Sampling', 1)), '') AS name, TRY_CAST(regexp_extract(line, 'frequency:\\s*(\\S+)', 1) AS DOUBLE) AS sample_frequency, nullif(trim(regexp_extract(line, 'Unit:(.*?)Domain', 1)), '') AS physical_dimension FROM ({_LINES}) WHERE starts_with(line, 'Label:')")
def trigno_label_parse(spark, d):
    lines = _shared(spark, d, _LINES).where(F.col("line").startswith("Label:"))
    return lines.select(*[fn.label_part(F.col("line"), p).alias(p) for p in ("name", "sample_frequency", "physical_dimension")])


_FILTERS = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '') WHEN 1 THEN '' END AS hp, CASE p_partkey % 5 WHEN 0 THEN concat(p_size * 10, '') WHEN 1 THEN '' WHEN 2 THEN concat(p_partkey, '') END AS lp FROM part"


@_query(f"SELECT id, coalesce(nullif(concat_ws(' ', 'HP:' || nullif(hp, '') || 'Hz', 'LP:' || nullif(lp, '') || 'Hz'), ''), 'n/a') AS prefilter FROM ({_FILTERS})")
def otb_prefilter_text(spark, d):
    return _shared(spark, d, _FILTERS).select("id", fn.prefilter_text(F.col("hp"), F.col("lp")).alias("prefilter"))


_CHANNELS = """SELECT 'recording' AS recording_id, concat(s_name, ' of nation ', s_nationkey) AS channel, CAST(s_suppkey AS INTEGER) AS channel_idx, CASE s_nationkey % 3 WHEN 0 THEN 'EMG' WHEN 1 THEN 'ACC' ELSE 'OTHER' END AS channel_type,
    CAST(s_nationkey AS DOUBLE) + 1000.75 AS sample_frequency, CASE s_nationkey % 3 WHEN 0 THEN 'mV' ELSE 'g' END AS physical_dimension, 'n/a' AS prefilter FROM supplier"""


@_query(f"SELECT channel_idx, substr(channel, 1, 16) AS label, physical_dimension AS dimension, trunc(sample_frequency)::INTEGER AS sample_frequency, prefilter, channel_type || ' sensor' AS transducer FROM ({_CHANNELS})")
def edf_header_projection(spark, d):
    return edf_header_fields(_shared(spark, d, _CHANNELS))


@_query(f"SELECT channel AS name, channel_type, physical_dimension, sample_frequency, 'n/a' AS reference, 'good' AS status FROM ({_CHANNELS})")
def channels_tsv_rows(spark, d):
    return channels_tsv(_shared(spark, d, _CHANNELS))


@_query(f"WITH {_LI_SQL} SELECT max(abs(value)) AS v_abs FROM li")
def global_abs_max(spark, d):
    """One figure over all channels, for normalised stacked plots."""
    return lineitem(spark, d).agg(F.max(F.abs("value")).alias("v_abs"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Analysis and format of every lineitem channel."""
    return an.suitability(an.analyze(lineitem(spark, d))).select("channel", "n", "range", "noise_floor", "dynamic_range_db", "use_bdf", "reason")
