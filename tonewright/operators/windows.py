"""Window operators over the frames of a track, all on one partitioning and order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile

LAGS = (1, 2, 3, 5, 8, 12)


def track():
    """The frames of a track in order."""
    return Window.partitionBy("track_id").orderBy("idx")


def runs(frames: DataFrame, mask: str, key: str = "track_id", pos: str = "idx") -> DataFrame:
    """Maximal runs [s, e) of true values of mask."""
    w = Window.partitionBy(key).orderBy(pos)
    t = frames.withColumn("_m", F.coalesce(F.col(mask), F.lit(False)))
    t = t.withColumn("_new", (F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))).cast("int"))
    t = t.withColumn("_run", F.sum("_new").over(w)).filter("_m")
    return t.groupBy(key, "_run").agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e")).drop("_run")


def _near(value: str, k: int) -> Column:
    """value k rows on, null outside the track."""
    return F.lead(value, k).over(track()) if k > 0 else F.lag(value, -k).over(track()) if k < 0 else F.col(value)


def median_smooth(frames: DataFrame, value: str, mask: Column, size: int = 5, name: str = "smooth") -> DataFrame:
    """Running median inside each run of mask, with the end values of the run repeated beyond it; a run shorter than size
    uses the next odd number from its length up. Outside runs the value stays.

    All of it is in the size - 1 rows on either side of a row: how far its run goes there, up to size, and the values. So it
    shares the sort of the other windows of a track."""
    half, most = size // 2, size - 1
    t = frames.withColumn("_m", F.coalesce(mask, F.lit(False)))
    t = t.withColumns({f"_m{d}": F.coalesce(_near("_m", d), F.lit(False)) for d in range(-most, most + 1) if d} | {f"_v{d + half}": _near(value, d) for d in range(-half, half + 1)})

    def reach(sign: int) -> Column:  # rows of the run before or after this one, up to most
        out, on = F.lit(0), F.col("_m")
        for d in range(1, most + 1):
            on = on & F.col(f"_m{sign * d}")
            out = out + on.cast("int")
        return out

    t = t.withColumns({"_back": reach(-1), "_on": reach(1), "_vs": F.array(*[f"_v{d}" for d in range(size)])})

    def middle(k: int) -> Column:
        spot = lambda d: F.greatest(-F.col("_back"), F.least(F.col("_on"), F.lit(d))) + half + 1
        return F.element_at(F.array_sort(F.array(*[F.element_at("_vs", spot(d).cast("int")) for d in range(-k, k + 1)])), k + 1)

    length, out = F.col("_back") + F.col("_on") + 1, F.col(value)
    for k in range(1, half + 1):
        out = F.when(F.col("_m") & (length >= 2 * k), middle(k)).otherwise(out)
    return t.withColumn(name, out).select(*frames.columns, name) if name not in frames.columns else t.withColumn(name, out).select(*frames.columns)


def median_smooth_zero(frames: DataFrame, value: str = "f0", size: int = 7, low: float = 50.0, name: str = "smooth") -> DataFrame:
    """Running median with zeros beyond the ends, after frames below low got the median of the track's other frames."""
    k, w = size // 2, Window.partitionBy("track_id")
    t = frames.withColumn("_f", F.coalesce(F.when(F.col(value) >= low, F.col(value)), F.percentile(F.when(F.col(value) >= low, F.col(value)), F.lit(0.5)).over(w), F.lit(0.0)))
    near = F.collect_list("_f").over(track().rowsBetween(-k, k))
    padded = F.concat(near, F.array_repeat(F.lit(0.0), (F.lit(size) - F.size(near)).cast("int")))
    return t.withColumn(name, F.element_at(F.array_sort(padded), k + 1)).drop("_f")


def hold_pitch(frames: DataFrame, pitch: str, voiced: str, name: str = "held", accuracy: int | None = None) -> DataFrame:
    """The last voiced pitch. Before there is one, frame 0's own value; where that is missing the track's median, or 60
    for tracks without a voiced frame."""
    w = Window.partitionBy("track_id")
    last = F.last(F.when(F.col(voiced), F.col(pitch)), True).over(track())
    first = F.first(pitch).over(track())
    mid = F.when(F.max(F.col(voiced)).over(w), quantile(pitch, 0.5, accuracy).over(w))
    return frames.withColumn(name, F.coalesce(last, first, mid, F.lit(60.0)))


def interpolate_gaps(frames: DataFrame, value: str = "f0", name: str = "filled") -> DataFrame:
    """Straight lines across zeros, the ends held; tracks that are all zero are left out."""
    ahead = track().rowsBetween(0, Window.unboundedFollowing)
    good = F.when(F.col(value) > 0, F.struct(F.col("idx").alias("i"), F.col(value).alias("v")))
    t = frames.withColumns({"_a": F.last(good, True).over(track()), "_b": F.first(good, True).over(ahead)}).filter("_a is not null or _b is not null")
    share = (F.col("idx") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    line = F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))
    out = F.when(F.col(value) > 0, F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)
    return t.withColumn(name, out).drop("_a", "_b")


def lag_lead(value: str, k: int) -> Column:
    """value k frames on minus k frames back, zero outside the track."""
    return F.lead(value, k, 0.0).over(track()) - F.lag(value, k, 0.0).over(track())


def backward_delta(value: str, k: int) -> Column:
    return F.col(value) - F.lag(value, k, 0.0).over(track())


def _side(value: str, first: int, last: int) -> Column:
    """The values of rows first..last as an array, the edge value of the track repeated. Values must not be null."""
    near = lambda d: F.coalesce(*[_near(value, k) for k in range(d, 0, -1 if d > 0 else 1)], F.col(value)) if d else F.col(value)
    return F.array(*[near(d) for d in range(first, last + 1)])


def _std(xs: Column, n: int) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n)) / n)


def _median8(xs: Column) -> Column:
    s = F.array_sort(xs)
    return (F.element_at(s, 4) + F.element_at(s, 5)) / 2


def before_after(frames: DataFrame, value: str = "held") -> DataFrame:
    """Spread of the 8 frames before and from each frame on, difference of their medians, and how far the median after is
    from a semitone."""
    t = frames.withColumns({"_b": _side(value, -8, -1), "_a": _side(value, 0, 7)})
    t = t.withColumns({"_bm": _median8(F.col("_b")), "_am": _median8(F.col("_a")), "std_before": _std(F.col("_b"), 8), "std_after": _std(F.col("_a"), 8)})
    return t.withColumns({"median_step": F.col("_am") - F.col("_bm"), "off_semitone": F.abs(F.col("_am") - F.rint("_am"))}).drop("_a", "_b", "_am", "_bm")


def local_peak(value: str, size: int = 9) -> Column:
    return F.max(value).over(track().rowsBetween(-(size // 2), size // 2))


FEATURES = (
    ["voiced_f", "conf", "level", "flux", "hf"]
    + [f"{n}_{k}" for k in LAGS for n in ("step", "abs_step", "level_step", "conf_step")]
    + [f"{n}_{k}" for k in (2, 4, 8) for n in ("flux_back", "hf_back", "voiced_back")]
    + ["std_before", "std_after", "median_step", "off_semitone", "flux_to_peak", "flux_is_peak"]
)


def frame_features(frames: DataFrame, smooth: bool = True, voiced_conf: float = 0.4, accuracy: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 44 feature columns of the onset model, in the order of FEATURES, beside track_id, idx and the columns in keep: one shuffle
    by track and one sort. accuracy: see quantile."""
    from ..functions.music import hz_to_midi

    t = frames.withColumn("midi", hz_to_midi("f0")).withColumn("voiced", (F.col("conf") > voiced_conf) & F.col("midi").isNotNull())
    t = median_smooth(t, "midi", F.col("voiced"), 5, "clean") if smooth else t.withColumn("clean", F.col("midi"))
    t = hold_pitch(t, "clean", "voiced", accuracy=accuracy)
    level = F.col("rms_db") - quantile("rms_db", 0.95, accuracy).over(Window.partitionBy("track_id"))
    t = t.withColumns({"level": level, "voiced_f": F.col("voiced").cast("double")})
    cols = {}
    for k in LAGS:
        cols |= {f"step_{k}": lag_lead("held", k), f"abs_step_{k}": F.abs(lag_lead("held", k)), f"level_step_{k}": lag_lead("level", k), f"conf_step_{k}": lag_lead("conf", k)}
    for k in (2, 4, 8):
        cols |= {f"flux_back_{k}": backward_delta("flux", k), f"hf_back_{k}": backward_delta("hf", k), f"voiced_back_{k}": F.lag("voiced_f", k, 0.0).over(track())}
    cols |= {"flux_to_peak": F.col("flux") - local_peak("flux"), "flux_is_peak": (F.col("flux") >= local_peak("flux")).cast("double")}
    t = before_after(t.withColumns(cols))
    return t.select("track_id", "idx", *FEATURES, *keep)


def smooth_prob(prob: str) -> Column:
    """The mean of three probabilities, with zeros beyond the ends of the track."""
    return (F.lag(prob, 1, 0.0).over(track()) + F.col(prob) + F.lead(prob, 1, 0.0).over(track())) / 3


def onset_peaks(frames: DataFrame, prob: str = "prob", voiced: str = "voiced", threshold: float = 0.25) -> DataFrame:
    """peak: voiced frames whose smoothed probability reaches the threshold and is the largest of seven."""
    t = frames.withColumn("smooth", smooth_prob(prob))
    top = F.max("smooth").over(track().rowsBetween(-3, 3))
    return t.withColumn("peak", (F.col("smooth") >= threshold) & (F.col("smooth") >= top) & F.col(voiced))


def moving_mean_gate(frames: DataFrame, value: str, size: int = 20) -> DataFrame:
    """gate: how far a value stands out of its moving mean, through a logistic step. The mean is over size rows with zeros
    beyond the ends."""
    mean = F.sum(value).over(track().rowsBetween(-(size // 2 - 1), size // 2)) / size
    ratio = (F.col(value) - mean) / (mean + 1e-6)
    return frames.withColumn("gate", 1 / (1 + F.exp(-(ratio - 1.3) / 0.1)))


def quiet_cut_points(chunks: DataFrame, centre: int, query: int, window: int, longest: int) -> DataFrame:
    """For clips (clip, chunk_no, start, samples) longer than longest, near every multiple of centre, the first position within
    query of it where the sum of window absolute values around it is least; the signal is mirrored at its ends. A chunk gives
    its best place for each centre that it's near, so what meets in a clip is a few rows a centre. Chunks are at least half a
    window long, but for the last."""
    from .signal import _mirrored, with_context

    half = window // 2
    lengths = chunks.groupBy("clip").agg(F.sum(F.size("samples")).alias("n")).filter(F.col("n") > longest)

    def run(frames):
        for f in frames:
            rows = []
            for clip, start, n, samples, left, right in zip(f["clip"], f["start"], f["n"], f["samples"], f["left"], f["right"], strict=True):
                x = np.abs(_mirrored(samples, left, right, half))
                sums = np.round(np.lib.stride_tricks.sliding_window_view(x, window).sum(1)[: len(samples)], 9)
                for at in range(max(centre, (start - query) // centre * centre), min(n, start + len(samples) + query + 1), centre):
                    a, z = max(0, at - query - start), min(len(samples), at + query - start)
                    if a < z:
                        k = a + int(sums[a:z].argmin())
                        rows.append((clip, at, sums[k], start + k))
            yield pd.DataFrame(rows, columns=["clip", "at", "s", "pos"])

    kind = chunks.schema["clip"].dataType.simpleString()
    t = with_context(chunks, half, half).join(lengths, "clip").select("clip", "start", "n", "samples", "left", "right")
    best = t.mapInPandas(run, f"clip {kind}, at long, s double, pos long")
    return best.groupBy("clip", "at").agg(F.min_by("pos", F.struct("s", "pos")).alias("cut"))


def mask_long_runs(mask: DataFrame, threshold: float = 0.01, longest: int = 64, fade: int = 32) -> DataFrame:
    """Weight added to a mask: 1 inside runs above threshold that are longer than longest, with straight fades of fade
    frames at both ends unless the run touches an end of the track; runs closer than fade are taken together."""
    r = runs(mask.withColumn("_on", F.col("mask") > threshold), "_on").filter(F.col("e") - F.col("s") > longest)
    w = Window.partitionBy("track_id").orderBy("s")
    r = r.withColumn("_new", F.coalesce((F.col("s") - F.lag("e").over(w) >= fade).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    r = r.groupBy("track_id", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    n = mask.groupBy("track_id").agg((F.max("idx") + 1).alias("_n"))
    each = r.join(n, "track_id").select("track_id", "s", "e", "_n", F.explode(F.sequence("s", F.col("e") - 1)).alias("idx"))
    up = F.when(F.col("s") == 0, 1.0).otherwise(F.least(F.lit(1.0), (F.col("idx") - F.col("s")) / fade))
    down = F.when(F.col("e") == F.col("_n"), 1.0).otherwise(F.least(F.lit(1.0), (F.col("e") - 1 - F.col("idx")) / fade))
    each = each.select("track_id", "idx", F.least(up, down).alias("_w"))
    t = mask.join(each, ["track_id", "idx"], "left").withColumn("weight", F.coalesce("_w", F.lit(0.0)))
    return t.withColumn("mask", F.col("mask") + F.col("weight") * (1 - F.col("mask"))).drop("_w")
