"""Column functions for pitch, keys and salience. Null and non-positive frequencies are unpitched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
SCALE_STEPS = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
FIRST_BIN_CENTS = 1997.3794084376191


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hz_to_midi(hz) -> Column:
    hz = _c(hz)
    return F.when(hz > 0, F.lit(69.0) + 12 * F.log2(hz / 440))


def midi_to_hz(midi) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (_c(midi) - 69) / 12)


def note_name(midi) -> Column:
    m = _c(midi).cast("int")
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(m, F.lit(12)) + 1), (F.floor(m / 12) - 1).cast("string"))


def parse_key(key) -> Column:
    """struct(root, mode) of names such as "G major", "Bb" or "F#m"; null for another first letter."""
    k = F.trim(_c(key))
    low = F.lower(k)
    minor = low.rlike("min(or)?$") | (k.endswith("m") & ~low.endswith("major"))
    tonic = F.when(k.contains(" "), F.split_part(k, F.lit(" "), F.lit(1))).otherwise(F.regexp_replace(k, "m+$", ""))
    letter, marks = F.upper(F.substring(tonic, 1, 1)), F.substring(tonic, 2, 1000)
    base = F.array_position(F.array(*map(F.lit, NOTE_NAMES)), letter) - 1
    count = lambda ch: F.length(marks) - F.length(F.replace(marks, F.lit(ch), F.lit("")))
    root = F.when(base >= 0, F.pmod(base + count("#") - count("b"), F.lit(12))).cast("int")
    return F.struct(root.alias("root"), F.when(minor, "minor").otherwise("major").alias("mode"))


def in_scale(midi, root, mode) -> Column:
    """Whether the nearest semitone is in the key."""
    step = F.pmod(F.rint(_c(midi)) - _c(root), F.lit(12)).cast("int")
    steps = {m: F.array(*map(F.lit, s)) for m, s in SCALE_STEPS.items()}
    return F.array_contains(F.when(_c(mode) == "minor", steps["minor"]).otherwise(steps["major"]), step)


def transpose(hz, semitones) -> Column:
    return _c(hz) * F.pow(F.lit(2.0), (semitones if isinstance(semitones, Column) else F.lit(float(semitones))) / 12)


def coarse_pitch(hz, low: float = 50.0, high: float = 1100.0) -> Column:
    """1..255 on a mel scale; 1 for unpitched."""
    import math

    mel = lambda f: 1127 * math.log(1 + f / 700)
    m = 1127 * F.log1p(_c(hz) / 700)
    scaled = F.when(m > 0, (m - mel(low)) * 254 / (mel(high) - mel(low)) + 1).otherwise(m)
    return F.rint(F.greatest(F.lit(1.0), F.least(F.lit(255.0), scaled))).cast("int")


def pitch_bin(midi) -> Column:
    """Index of the 20-cent bin, null when unvoiced."""
    cents = 1200 * F.log2(midi_to_hz(midi) / 10)
    return F.rint((cents - FIRST_BIN_CENTS) / 20).cast("int")


def cents_off(midi) -> Column:
    m = _c(midi)
    return (m - F.floor(m + 0.5)) * 100


def cents_class(midi) -> Column:
    off = F.abs(cents_off(midi))
    return F.when(off < 15, "good").when(off < 30, "warn").otherwise("bad")


def decode_salience(sal, threshold: float | None = None, edge: str = "clip") -> Column:
    """struct(f0, conf): the weighted mean of the cents of the bins within four of the first peak. edge says what lies
    beyond the ends: "clip" repeats the end bins, "zero" and "truncate" have no weight there."""
    sal = _c(sal)
    top = F.array_max(sal).cast("double")
    at = (F.array_position(sal, F.array_max(sal)) - 1).cast("int")
    offsets = F.sequence(at - 4, at + 4)
    last = F.size(sal) - 1
    if edge == "clip":
        where = F.transform(offsets, lambda i: F.least(F.greatest(i, F.lit(0)), last))
    else:
        where = F.filter(offsets, lambda i: (i >= 0) & (i <= last))
    pairs = F.transform(where, lambda i: F.struct(F.get(sal, i).cast("double").alias("w"), (i * 20 + FIRST_BIN_CENTS).alias("c")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + f(x))
    weight = total(lambda x: x["w"])
    hz = F.when(weight != 0, 10 * F.pow(F.lit(2.0), total(lambda x: x["w"] * x["c"]) / weight / 1200))
    if threshold is not None:
        hz = F.when(top <= threshold, F.lit(0.0)).otherwise(hz)
    return F.struct(hz.alias("f0"), top.alias("conf"))
