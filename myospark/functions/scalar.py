"""Row functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import EDF_KINDS, LABEL_PARTS, OTB_KINDS, OTHER_UNIT, TRIGNO_KINDS, UNITS, kind_column, millivolts_per_step

FLOAT64_EPS, FLOAT32_EPS = 2.0**-52, 2.0**-23


def sample_time(sample_index: Column, rate: Column) -> Column:
    return sample_index / rate


def log10_signed(x: Column) -> Column:
    """log10 with -inf at 0, where SQL gives null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def is_close(a: Column, b: Column) -> Column:
    """Relative tolerance 1e-5 of b, absolute 1e-8."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def combine_24bit(hi: Column, lo: Column) -> Column:
    """A signed 24-bit value from a signed high word and the low byte of the next word."""
    return F.shiftleft(hi.cast("int"), 8) + lo.cast("int").bitwiseAND(F.lit(255))


def otb_gain_scale(raw: Column, channel_type: Column, bits: int, gain: Column) -> Column:
    """Millivolts at the electrode for muscle channels (3.3 V supply); other types keep raw units. A gain of 0 is an error."""
    safe = F.when(gain == 0, F.raise_error(F.lit("adapter gain is 0"))).otherwise(gain)
    return F.when(channel_type == "EMG", raw * millivolts_per_step(bits, safe)).otherwise(raw.cast("double"))


def classify_edf(label: Column, transducer: Column) -> Column:
    """Channel type from label and transducer, in any case."""
    return kind_column(EDF_KINDS, label=F.upper(label), transducer=F.upper(transducer))


def classify_trigno(label: Column) -> Column:
    return kind_column(TRIGNO_KINDS, label=label)


def classify_otb(adapter: Column, description: Column, channel_id: Column) -> Column:
    return kind_column(OTB_KINDS, adapter=adapter, description=description, channel_id=channel_id)


def unit_of(channel_type: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(units, channel_type), F.lit(OTHER_UNIT))


def prefilter_text(highpass: Column, lowpass: Column) -> Column:
    hp = F.when(F.coalesce(highpass, F.lit("")) != "", F.concat(F.lit("HP:"), highpass, F.lit("Hz")))
    lp = F.when(F.coalesce(lowpass, F.lit("")) != "", F.concat(F.lit("LP:"), lowpass, F.lit("Hz")))
    return F.coalesce(F.nullif(F.concat_ws(" ", hp, lp), F.lit("")), F.lit("n/a"))


def or_na(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("n/a"))


def channel_place(name: Column) -> Column:
    """The place, from 0, of a channel called CH1, CH2, ..."""
    return F.substring(name, 3, 10).try_cast("int") - 1


def label_part(line: Column, part: str) -> Column:
    """name, sample_frequency or physical_dimension of a label line; null where the line lacks the marker."""
    got = F.nullif(F.trim(F.regexp_extract(line, LABEL_PARTS[part], 1)), F.lit(""))
    return got.try_cast("double") if part == "sample_frequency" else got


def round_physical(value: Column) -> Column:
    """The value rounded to the most decimals, 6 at most, at which its general format (6 digits) has up to 8 characters.

    Between 1 and a million any value fits with its sign, and so do tiny ones, whose 6 decimals leave two digits. A sign
    before ``0.123456`` is one character too many, so such values get 5 decimals. From a million on the format has an
    exponent: few digits fit as they are, and others are rounded to whole numbers.
    """
    known = F.when(F.isnan(value), F.lit(0.0)).otherwise(value)
    six = F.bround(known, 6)
    size, sign = F.abs(six), F.when(six < 0, 1).otherwise(0)
    fraction = (sign == 1) & (size >= 1e-4) & (size < 1) & (F.abs(F.bround(known, 5) - six) > 5e-7)
    power = F.floor(F.log10(size)).cast("double")
    lead = F.rint(size / F.pow(F.lit(10.0), power - 5))  # the six digits shown; 1e6 if they round up
    digits = F.when(lead % 100000 == 0, 1).when(lead % 10000 == 0, 2).when(lead % 1000 == 0, 3).otherwise(6)
    shown = power + F.when(lead >= 1e6, 1).otherwise(0)
    chars = sign + digits + F.when(digits > 1, 1).otherwise(0) + F.when(shown >= 100, 5).otherwise(4)
    large = (size >= 999999.5) & (chars > 8)
    return F.when(F.isnan(value), value).when(fraction, F.bround(known, 5)).when(large, F.bround(known, 0)).otherwise(six)
