"""Rules on header texts, stated once: readers apply them to strings, queries to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amplifier models whose adapters carry muscle signals.
EMG_ADAPTERS = ["Due", "Muovi", "Sessantaquattro", "Novecento", "Quattro", "Quattrocento"]

#: Channel types, with the words that name them and the fields these stand in. The first that fits counts.
EDF_KINDS = [
    ("EMG", [("label", "EMG"), ("transducer", "EMG")]),
    ("ACC", [("label", "ACC"), ("transducer", "ACCELEROMETER")]),
    ("GYRO", [("label", "GYRO"), ("transducer", "GYROSCOPE")]),
    ("TRIG", [("label", "TRIG"), ("transducer", "TRIGGER")]),
]
TRIGNO_KINDS = [(kind, [("label", kind)]) for kind in ("EMG", "ACC", "GYRO")]
OTB_KINDS = [
    ("EMG", [("adapter", model) for model in EMG_ADAPTERS]),
    ("ACC", [("adapter", "ACC"), ("description", "Acceleration")]),
    ("GYRO", [("adapter", "GYRO"), ("description", "Gyroscope")]),
    ("QUAT", [("channel_id", "Quaternion")]),
    ("CTRL", [("adapter", "Control")]),
]
#: Units by channel type, and the parts of a label line.
UNITS, OTHER_UNIT = {"EMG": "mV", "ACC": "g", "GYRO": "g", "QUAT": "rad"}, "a.u."
LABEL_PARTS = {"name": r"Label:(.*?)Sampling", "sample_frequency": r"frequency:\s*(\S+)", "physical_dimension": r"Unit:(.*?)Domain"}
SUPPLY_VOLTS = 3.3


def kind_of(kinds: list, **texts: str) -> str:
    """The channel type that the texts name, OTHER if none."""
    return next((kind for kind, words in kinds if any(word in texts[where] for where, word in words)), "OTHER")


def kind_column(kinds: list, **texts: Column) -> Column:
    """``kind_of`` as a column expression; null texts name nothing."""
    known = {name: F.coalesce(text, F.lit("")) for name, text in texts.items()}
    fits = lambda words: reduce(lambda a, b: a | b, [known[where].contains(word) for where, word in words])
    return reduce(lambda rest, rule: F.when(fits(rule[1]), rule[0]).otherwise(rest), reversed(kinds), F.lit("OTHER"))


def millivolts_per_step(bits: int, gain: float | Column) -> float | Column:
    """What one digital step is at the electrode."""
    return SUPPLY_VOLTS / 2**bits * 1000 / gain


def to_digital(value, pmin, pmax, dmin, dmax):
    """The place of a value on the digital scale, not rounded; numbers, arrays or columns."""
    return (value - pmin) * (dmax - dmin) / (pmax - pmin) + dmin


def to_physical(digital, pmin, pmax, dmin, dmax):
    """The physical value of a digital one; numbers, arrays or columns."""
    return (digital - dmin) * (pmax - pmin) / (dmax - dmin) + pmin
