"""Scoring transcriptions: labels, rasters, matching, metrics, folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ordered_places
from ..functions import music
from . import decoding


#: Frames of a track that are dealt together, and notes that a task has.
BLOCK_FRAMES, TASK_NOTES = 4096, 100_000


def tasks_for(notes: DataFrame) -> int:
    """Tasks that notes are dealt to where they become frames: their number grows with the notes, what a task holds doesn't."""
    return max(1, -(-notes.count() // TASK_NOTES))


def onset_labels(frames: DataFrame, notes: DataFrame, tol: int = 2, fps: float = 100.0) -> DataFrame:
    """label 1 for frames within tol of an onset. Each onset becomes 2 * tol + 1 rows, so the join has equal keys only; both sides
    are dealt by blocks of frames."""
    n, block = tasks_for(notes), F.floor(F.col("idx") / BLOCK_FRAMES)
    at = F.rint(F.col("start") * fps).cast("int")
    hot = notes.select("track_id", at.alias("_at")).distinct()  # onsets of one frame are one before they become rows
    hot = hot.select("track_id", F.explode(F.sequence(F.greatest(F.col("_at") - tol, F.lit(0)), F.greatest(F.col("_at") + tol, F.lit(0)))).alias("idx")).withColumn("_block", block)
    hot = hot.repartition(n, "track_id", "_block").distinct().withColumn("_l", F.lit(1))
    t = frames.withColumn("_block", block).repartition(n, "track_id", "_block").join(hot, ["track_id", "_block", "idx"], "left")
    return t.withColumn("label", F.coalesce("_l", F.lit(0))).select(*frames.columns, "label")


def rasterise(notes: DataFrame, order: str = "note_no", fps: float = 100.0, inclusive: bool = False, tasks: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(track_id, idx, pitch) on a grid: frames with start <= idx / fps < end, later notes over earlier ones; inclusive
    takes the rounded frames of both ends instead. Notes are dealt to tasks by blocks of frames, a note to each that it's in, and
    become frames there; with tasks given, the number of them, the block stays as _block: rasters of the same tasks meet where they are.
    by names columns that tell several sets of notes of a track apart."""
    if inclusive:
        a, z = F.rint(F.col("start") * fps), F.rint(F.col("end") * fps)
    else:
        a, z = F.ceil(F.round(F.col("start") * fps, 6)), F.ceil(F.round(F.col("end") * fps, 6)) - 1
    t = notes.withColumns({"_a": a.cast("int"), "_z": z.cast("int")}).filter("_z >= _a")
    t = t.select("track_id", *by, order, "pitch", "_a", "_z", F.explode(F.sequence(F.floor(F.col("_a") / BLOCK_FRAMES), F.floor(F.col("_z") / BLOCK_FRAMES))).alias("_block"))
    t = t.repartition(tasks or tasks_for(notes), "track_id", "_block")
    low = F.greatest(F.col("_a"), (F.col("_block") * BLOCK_FRAMES).cast("int"))
    high = F.least(F.col("_z"), ((F.col("_block") + 1) * BLOCK_FRAMES - 1).cast("int"))
    each = t.select("track_id", *by, "_block", order, "pitch", F.explode(F.sequence(low, high)).alias("idx"))
    out = each.groupBy("track_id", *by, "_block", "idx").agg(F.max_by("pitch", order).alias("pitch"))
    return out if tasks else out.drop("_block")


def match_candidates(ref: DataFrame, est: DataFrame, seconds: float = 0.05, cents: float = 50.0, offsets: bool | None = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (track_id, ref_no, est_no) close enough in onset and pitch, and in offset if asked for; with offsets None a column full
    tells which are. Both sides meet in buckets of eight times the tolerance, so the band is only a filter on equal keys and few notes are in two. by: columns of
    est that tell several sets of notes of a track apart, which ref is met with once."""
    size = 8 * seconds
    r = ref.select("track_id", F.col("note_no").alias("ref_no"), F.col("start").alias("rs"), F.col("end").alias("re"), F.col("pitch").alias("rp"))
    lo, hi = (F.floor((F.col("rs") + d) / size) for d in (-seconds - 1e-6, seconds + 1e-6))
    r = r.withColumn("_b", F.explode(F.sequence(lo, hi)))
    e = est.select("track_id", *by, F.col("note_no").alias("est_no"), F.col("start").alias("es"), F.col("end").alias("ee"), F.col("pitch").alias("ep")).withColumn("_b", F.floor(F.col("es") / size))
    t = r.join(e, ["track_id", "_b"])
    near = lambda d, tol: F.bround(F.abs(d), 6) <= tol
    t = t.filter(near(F.col("rs") - F.col("es"), seconds) & (F.abs(F.col("rp") - F.col("ep")) * 100 <= cents))
    full = near(F.col("re") - F.col("ee"), F.greatest(0.2 * (F.col("re") - F.col("rs")), F.lit(seconds)))
    if offsets:
        t = t.filter(full)
    return t.select("track_id", *by, "ref_no", "est_no", *([full.alias("full")] if offsets is None else []))


def match_notes(ref: DataFrame, est: DataFrame, **how) -> DataFrame:
    """A largest one-to-one matching of each track; only candidates leave the JVM."""

    def run(frames):
        for f in frames:
            tracks, refs, ests = [], [], []
            for track, r, e in zip(f["track_id"], f["ref_no"], f["est_no"], strict=True):
                m = decoding.matching(list(zip(r.tolist(), e.tolist(), strict=True)))
                tracks += [track] * len(m)
                refs += m.keys()
                ests += m.values()
            yield pd.DataFrame({"track_id": tracks, "ref_no": refs, "est_no": ests})

    pairs = match_candidates(ref, est, **how).groupBy("track_id").agg(F.collect_list(F.struct(F.col("ref_no").cast("long").alias("ref_no"), F.col("est_no").cast("long").alias("est_no"))).alias("_p"))
    return pairs.select("track_id", *[F.col("_p")[c].alias(c) for c in ("ref_no", "est_no")]).mapInPandas(run, "track_id long, ref_no long, est_no long")


def match_counts(ref: DataFrame, est: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many notes a largest one-to-one matching has, hits without and full with offsets, of each track and set of notes in by
    that has candidates. Candidates are made once for both."""

    def run(frames):
        for f in frames:
            pairs = [[(r, e) for r, e in zip(r.tolist(), e.tolist(), strict=True)] for r, e in zip(f["ref_no"], f["est_no"], strict=True)]
            hits = [len(decoding.matching(p)) for p in pairs]
            full = [len(decoding.matching([x for x, both in zip(p, fs.tolist(), strict=True) if both])) for p, fs in zip(pairs, f["full"], strict=True)]
            yield f[["track_id", *by]].assign(hits=hits, full=full)

    pairs = match_candidates(ref, est, offsets=None, by=by).groupBy("track_id", *by).agg(F.collect_list(F.struct(F.col("ref_no").cast("long").alias("ref_no"), F.col("est_no").cast("long").alias("est_no"), "full")).alias("_p"))
    keys = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("track_id", *by))
    return pairs.select("track_id", *by, *[F.col("_p")[c].alias(c) for c in ("ref_no", "est_no", "full")]).mapInPandas(run, f"{keys}, hits long, full long")


def note_at(frames: DataFrame, notes: DataFrame, fps: float = 100.0) -> DataFrame:
    """frames with the pitch of the last note that has started and hasn't ended: an as-of join by one sort of both."""
    f = frames.select("track_id", F.struct(*[c for c in frames.columns if c != "track_id"]).alias("_f"), (F.col("idx") / fps).alias("_t"), F.lit(1).alias("_kind"))
    n = notes.select("track_id", F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.struct("end", "pitch").alias("_n"))
    w = Window.partitionBy("track_id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    t = f.unionByName(n, allowMissingColumns=True).withColumn("_n", F.last("_n", True).over(w)).filter("_kind = 1")
    return t.select("track_id", "_f.*", F.when(F.col("_n.end") > F.col("_t"), F.col("_n.pitch")).alias("pitch"))


def melody_metrics(ref: DataFrame, est: DataFrame, cents: float = 50.0) -> DataFrame:
    """Per track raw pitch and chroma accuracy, overall accuracy, voicing recall and false alarm, from (track_id, idx, midi)
    with null for unvoiced frames. Shares over nothing are 0."""
    t = ref.select("track_id", "idx", F.col("midi").alias("r")).join(est.select("track_id", "idx", F.col("midi").alias("e")), ["track_id", "idx"], "left")
    rv, ev = F.col("r").isNotNull(), F.col("e").isNotNull()
    d = (F.col("r") - F.col("e")) * 100
    fold = d - 1200 * F.floor(d / 1200 + 0.5)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    pitch, chroma = count(rv & (F.abs(d) <= cents)), count(rv & (F.abs(fold) <= cents))
    return t.groupBy("track_id").agg(
        per(pitch, count(rv)).alias("rpa"), per(chroma, count(rv)).alias("rca"), per(pitch + count(~rv & ~ev), F.count("*")).alias("oa"), per(count(rv & ev), count(rv)).alias("vr"), per(count(~rv & ev), count(~rv)).alias("vfa")
    )


def note_scores(matches: DataFrame, with_offsets: DataFrame, ref: DataFrame, est: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each reference track, without and with offsets; tracks without an estimate score 0."""
    n = lambda t, name: t.groupBy("track_id").agg(F.count("*").alias(name))
    t = n(ref, "n_ref")
    for part, name in ((est, "n_est"), (matches, "hits"), (with_offsets, "full")):
        t = t.join(n(part, name), "track_id", "left")
    return note_shares(t.fillna(0)).drop("n_ref", "n_est", "hits", "full")


def note_shares(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and F1 of the numbers n_ref, n_est, hits and full."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    f1 = lambda hit: F.when(F.col("n_ref") + F.col("n_est") > 0, 2 * F.col(hit) / (F.col("n_ref") + F.col("n_est"))).otherwise(F.lit(0.0))
    return counts.withColumns({"precision": per("hits", "n_est"), "recall": per("hits", "n_ref"), "f1": f1("hits"), "f1_offsets": f1("full")})


def time_accuracy(ref_raster: DataFrame, est_raster: DataFrame) -> DataFrame:
    """Shares of the reference's active frames on pitch (within half a semitone), on a wrong one, and missing."""
    keys = [c for c in ("track_id", "_block", "idx") if c in ref_raster.columns and c in est_raster.columns]
    t = ref_raster.withColumnRenamed("pitch", "r").join(est_raster.withColumnRenamed("pitch", "e"), keys, "left")
    on = F.abs(F.col("r") - F.col("e")) <= 0.5
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return t.groupBy("track_id").agg(share(on).alias("on_pitch"), share(~on).alias("wrong_pitch"), share(F.col("e").isNull()).alias("missing"))


def active_frames(ref: DataFrame, est: DataFrame, fps: float = 100.0) -> DataFrame:
    """The counts behind time_accuracy() for sets of notes in est, told apart by the column way, a number from 0: per track with active
    frames of the reference how many these are (active), and frames, a map from way to how many of them are on pitch and on a wrong
    one (on, off); a set that is in none of them isn't there. Notes of all are dealt together, and their frames stay where they're made."""
    side = lambda t, way, order: t.select("track_id", way.cast("int").alias("way"), F.col(order).cast("double").alias("_order"), "start", "end", "pitch")
    both = side(ref, F.lit(-1), "note_no").unionByName(side(est, F.col("way"), "start"))
    t = rasterise(both, "_order", fps, tasks=tasks_for(both), by=("way",))
    own = F.col("way") == -1
    t = t.withColumn("_r", F.max(F.when(own, F.col("pitch"))).over(Window.partitionBy("track_id", "_block", "idx"))).filter("_r is not null")
    near = F.abs(F.col("_r") - F.col("pitch")) <= 0.5
    t = t.groupBy("track_id", "way").agg(F.count_if(near).alias("on"), F.count_if(~near).alias("off"))
    return t.groupBy("track_id").agg(F.max(F.when(own, F.col("on"))).alias("active"), F.map_from_entries(F.collect_list(F.when(~own, F.struct("way", F.struct("on", "off"))))).alias("frames"))


def macro_mean(scores: DataFrame, *names: str) -> DataFrame:
    return scores.agg(*[F.avg(n).alias(n) for n in names])


def objective(f1: str = "f1", on: str = "on_pitch", wrong: str = "wrong_pitch"):
    return F.col(f1) + F.col(on) - F.col(wrong)


def choose_threshold(grid: DataFrame) -> DataFrame:
    """From (fold, threshold, objective): per fold the threshold of the best objective at two digits, the higher of equals;
    then their median."""
    best = grid.groupBy("fold").agg(F.max_by("threshold", F.struct(F.bround("objective", 2), "threshold")).alias("threshold"))
    return best.agg(F.percentile("threshold", F.lit(0.5)).alias("threshold"))


def folds(tracks: DataFrame, k: int = 5, inner: int = 4, key: str = "track_id") -> DataFrame:
    """fold of each track by its position; and for every outer fold the inner fold of each track left."""
    t = ordered_places(tracks.select(key).distinct(), key, name="_p").withColumn("fold", F.pmod("_p", F.lit(k)).cast("int"))
    each = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("outer"))
    # The place among the tracks that are left: less those of fold outer before.
    before = F.floor((F.col("_p") - F.col("outer") + (k - 1)) / k)
    return each.filter("fold != outer").select(key, "fold", "outer", F.pmod(F.col("_p") - before, F.lit(inner)).cast("int").alias("inner"))
