"""Voicing, tuning, key and range of tracks from their pitch frames (track_id, idx, f0, conf, rms_db, ...).

Every step keeps the partitioning by track_id: one shuffle serves the windows and the aggregates of a track.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from ..functions.stats import quantile


@dataclass(frozen=True)
class Settings:
    """Thresholds of the song-to-notes steps."""

    conf_threshold: float = 0.4
    silence_db: float = 45.0
    min_pitch: int = 36
    max_pitch: int = 96
    autotune: str = "auto"
    on_note_cut: float = 0.55
    #: For quantiles of tracks; None for exact ones.
    accuracy: int | None = None


def soft_voicing(frames: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """frames with midi, voice_p and voiced: confident, loud enough against the track's 99th percentile, in range."""
    ref = quantile("rms_db", 0.99, cfg.accuracy).over(Window.partitionBy("track_id"))
    t = frames.withColumns({"midi": music.hz_to_midi("f0"), "_ref": ref})
    loud = F.col("rms_db") > F.col("_ref") - cfg.silence_db
    inside = F.coalesce((F.col("midi") >= cfg.min_pitch - 0.5) & (F.col("midi") <= cfg.max_pitch + 0.5), F.lit(False))
    p = F.when(loud & inside, 1 / (1 + F.exp(-(F.col("conf") - cfg.conf_threshold) / 0.08))).otherwise(F.lit(0.0))
    t = t.withColumn("voice_p", p)
    return t.withColumn("voiced", F.col("voice_p") > 0.5).drop("_ref")


def estimate_tuning(frames: DataFrame, value: str = "midi", by: str = "track_id") -> DataFrame:
    """Circular mean of the fractions of a semitone, 0 for tracks without pitched frames."""
    turn = 2 * F.pi() * (F.col(value) - F.rint(value))
    angle = F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))) / (2 * F.pi())
    return frames.groupBy(by).agg(F.coalesce(angle, F.lit(0.0)).alias("tuning"))


def on_note_ratio(frames: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Share of voiced frames within a tenth of a semitone of a note, and whether that means pitch correction."""
    near = F.avg((F.abs(F.col("midi") - F.rint("midi")) < 0.1).cast("double"))
    t = frames.filter("voiced").groupBy("track_id").agg(near.alias("on_note"))
    auto = {"on": F.lit(True), "off": F.lit(False)}.get(cfg.autotune, F.col("on_note") >= cfg.on_note_cut)
    return t.withColumn("autotuned", auto)


def pitch_class_histogram(frames: DataFrame) -> DataFrame:
    """Rows (track_id, pc, n) with all twelve classes of every track."""
    pc = F.pmod(F.rint("midi"), F.lit(12)).cast("int")
    counts = [F.count(F.when(pc == k, 1)).alias(str(k)) for k in range(12)]  # one aggregate row a track, zeros included
    wide = frames.filter(F.col("midi").isNotNull()).groupBy("track_id").agg(*counts)
    pairs = F.array(*[F.struct(F.lit(k).alias("pc"), F.col(str(k)).alias("n")) for k in range(12)])
    return wide.select("track_id", F.inline(pairs))


def profiles(spark) -> DataFrame:
    """24 rotated key profiles of 12 classes: 288 rows."""
    rows = [(r, m, pc, p[(pc - r) % 12]) for m, p in (("major", music.MAJOR_PROFILE), ("minor", music.MINOR_PROFILE)) for r in range(12) for pc in range(12)]
    return spark.createDataFrame(rows, "root int, mode string, pc int, weight double")


def detect_key(hist: DataFrame, highest: bool = False) -> DataFrame:
    """The key whose profile correlates best with a histogram. Ties go to the lowest root, major first; with highest to
    the highest root and mode, as for backing tracks. Constant histograms correlate with nothing: the same tie rule."""
    # With 12 classes in each group, sums give the correlation.
    c = hist.join(F.broadcast(profiles(hist.sparkSession)), "pc").groupBy("track_id", "root", "mode").agg(F.corr("n", "weight").alias("r"))
    r = F.coalesce(F.nanvl("r", F.lit(-2.0)), F.lit(-2.0))
    r = F.bround(r, 12)  # equal up to rounding is a tie
    minor = (F.col("mode") == "minor").cast("int")
    order = F.struct(r, F.col("root"), minor) if highest else F.struct(r, -F.col("root"), -minor)
    return c.groupBy("track_id").agg(F.max_by(F.struct("root", "mode", "r"), order).alias("k")).select("track_id", F.col("k.root").alias("root"), F.col("k.mode").alias("mode"), F.col("k.r").alias("r"))


def average_chroma(chroma: DataFrame, key: str = "track_id", vec: str = "chroma") -> DataFrame:
    """Means of the elements of a track's vectors as rows (track_id, pc, n)."""
    return chroma.select(F.col(key).alias("track_id"), F.posexplode(vec).alias("pc", "v")).groupBy("track_id", "pc").agg(F.avg(F.col("v").cast("double")).alias("n"))


def track_summary(notes: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Number of notes and the lowest and highest with name and frequency; with a profile (see track_profile) also the tuning in
    cents, the key, and whether and how much the track is on its notes, null for tracks without one."""
    low, high = F.min("pitch"), F.max("pitch")
    t = notes.groupBy("track_id").agg(
        F.count("*").alias("n_notes"), low.alias("low"), high.alias("high"), music.note_name(low).alias("low_name"), music.note_name(high).alias("high_name"),
        music.midi_to_hz(low).alias("low_hz"), music.midi_to_hz(high).alias("high_hz"),
    )
    if profile is None:
        return t
    names = F.array(*[F.lit(n) for n in music.NOTE_NAMES])
    key = F.concat_ws(" ", F.element_at(names, F.col("root") + 1), "mode")
    return t.join(profile.select("track_id", (F.col("tuning") * 100).alias("tuning_cents"), key.alias("key"), "on_note", "autotuned"), "track_id", "left")


def track_profile(frames: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Tuning, key and on-note share of every track with voiced frames."""
    v = soft_voicing(frames, cfg).filter("voiced")
    key = detect_key(pitch_class_histogram(v))
    return estimate_tuning(v).join(on_note_ratio(v, cfg), "track_id").join(key, "track_id")


def display_range(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """Lowest and highest of note pitches and of the 1st and 99th lower-rank percentiles of the voiced curve, two
    semitones wider; 55 to 80 where there is neither."""
    v = frames.filter("midi is not null and voiced")
    w = Window.partitionBy("track_id")
    ranked = v.select("track_id", "midi", (F.row_number().over(w.orderBy("midi")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * F.lit(p)), F.col("midi")))
    curve = ranked.groupBy("track_id").agg(at(0.01).alias("lo"), at(0.99).alias("hi"))
    span = notes.groupBy("track_id").agg(F.min("pitch").alias("a"), F.max("pitch").alias("z"))
    t = frames.select("track_id").distinct().join(curve, "track_id", "left").join(span, "track_id", "left")
    return t.select(
        "track_id", F.coalesce(F.floor(F.least("lo", "a")) - 2, F.lit(55)).cast("int").alias("low"), F.coalesce(F.ceil(F.greatest("hi", "z")) + 2, F.lit(80)).cast("int").alias("high")
    )


def preview_prefix(frames: DataFrame, seconds: float = 45, longer_than: float = 60, fps: int = 100) -> DataFrame:
    """The first seconds of every track longer than longer_than."""
    n = F.max("idx").over(Window.partitionBy("track_id")) + 1
    return frames.withColumn("_n", n).filter((F.col("_n") > longer_than * fps) & (F.col("idx") < seconds * fps)).drop("_n")


def hmm_inputs(frames: DataFrame, cfg: Settings = Settings(), facts: DataFrame | None = None) -> DataFrame:
    """Per track the note range and spread that decoding needs: percentiles half a percent from the ends, two wider. facts says
    which tracks are autotuned; without it the frames themselves do."""
    lo, hi = quantile("midi", 0.005, cfg.accuracy), quantile("midi", 0.995, cfg.accuracy)
    t = frames.filter("voiced").groupBy("track_id").agg((F.floor(lo) - 2).alias("lo"), (F.ceil(hi) + 2).alias("hi"))
    t = t.join((on_note_ratio(frames, cfg) if facts is None else facts).select("track_id", "autotuned"), "track_id")
    tuned = F.col("autotuned")
    return t.select(
        "track_id", F.greatest(F.lit(cfg.min_pitch), "lo").cast("int").alias("lo"), F.least(F.lit(cfg.max_pitch), "hi").cast("int").alias("hi"),
        F.when(tuned, 0.35).otherwise(0.5).alias("sigma"), F.when(tuned, 0.8).otherwise(0.25).alias("penalty"), "autotuned",
    )


def confidence_weight(conf: str = "conf"):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.25), (F.col(conf) - 0.2) / 0.6))
