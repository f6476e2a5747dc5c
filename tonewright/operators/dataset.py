"""Preparing clips for training: joining what belongs together, filtering, cutting, bucketing, batching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import shuffle_key, shuffled_places
from . import decoding


def clip_name(path: str | Column) -> Column:
    """The file name up to its first dot."""
    c = F.col(path) if isinstance(path, str) else path
    return F.substring_index(F.substring_index(c, "/", -1), ".", 1)


def training_set(first: DataFrame, *others: DataFrame, key: str = "clip") -> DataFrame:
    """Rows of first whose key is in all others; give the smallest table first."""
    for t in others:
        first = first.join(t.select(key), key, "left_semi")
    return first


def attach_speaker(clips: DataFrame, manifest: DataFrame, whole_first: bool = False, key: str = "clip") -> DataFrame:
    """clips with the speaker of their manifest entry: the name without its last _part, or with whole_first the whole name
    if there is an entry for it. A manifest has a row for each source file; only what matches stays."""
    short = F.regexp_replace(key, "_[^_]*$", "")
    if not whole_first:
        return clips.withColumn("output_key", short).join(manifest, "output_key")
    m = manifest.withColumnRenamed("output_key", "_k")
    # What a name is matched with is settled once a name, then joined to all rows that have it.
    names = clips.select(F.col(key).alias("_name")).distinct()
    keys = F.array_distinct(F.array(F.struct(F.lit(0).alias("p"), F.col("_name").alias("k")), F.struct(F.lit(1).alias("p"), F.regexp_replace("_name", "_[^_]*$", "").alias("k"))))
    t = names.select("_name", F.inline(keys)).join(m, F.col("k") == F.col("_k"))
    values = [c for c in manifest.columns if c != "output_key"]
    best = t.groupBy("_name").agg(F.min_by(F.struct(F.col("k").alias("output_key"), *values), "p").alias("_m"))
    return clips.join(best, F.col(key) == F.col("_name")).select(*[clips[c] for c in clips.columns], "_m.*")


def drop_bad_vectors(vectors: DataFrame, key: str = "clip", vec: str = "vec") -> DataFrame:
    """vectors without the clips that have a NaN or null in any of theirs."""
    bad = vectors.filter(F.exists(vec, lambda x: x.isNull() | F.isnan(x))).select(key).distinct()
    return vectors.join(bad, key, "left_anti")


def keep_text_length(rows: DataFrame, text: str, low: int = 1, high: int = 5000) -> DataFrame:
    return rows.filter(F.length(text).between(low, high))


def peak_normalise(clips: DataFrame, samples: str = "samples", most: float = 2.5, peak: float = 0.9, mix: float = 0.75) -> DataFrame:
    """Clips scaled most of the way to a peak; those with a peak that is not finite, not positive or over most go."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    t = clips.withColumn("_p", top).filter((F.col("_p") > 0) & (F.col("_p") <= most) & ~F.isnan("_p"))
    return t.withColumn(samples, F.transform(samples, lambda x: x / F.col("_p") * (peak * mix) + (1 - mix) * x)).drop("_p")


def repeat_rows(rows: DataFrame, times: str = "repeat") -> DataFrame:
    """Every row as often as times says."""
    return rows.filter(F.col(times) >= 1).withColumn("_k", F.explode(F.sequence(F.lit(1), times))).drop("_k")


def add_silence_rows(rows: DataFrame, silence: Column, speaker: str = "speaker_id", times: int = 2) -> DataFrame:
    """Two more rows for each speaker in use, with silence as the line."""
    people = rows.select(speaker).distinct().select(speaker, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_k"))
    return rows.unionByName(people.select(speaker, silence.alias("line")))


def filelist_line(*fields: Column, name: Column | None = None) -> Column:
    """Fields between bars, each in its place: a null one is empty. Only a last one, name, is left out where it's null."""
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields], *([] if name is None else [name.cast("string")]))


def key_sets_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the two tables have the same keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    t = x.join(y, key, "full_outer")
    return t.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("equal"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with their place in an order that looks random and is the same in every run, in that order."""
    return shuffled_places(rows, key, seed).drop("size").orderBy("place")


def length_buckets(rows: DataFrame, length: str, bounds: Sequence[int]) -> DataFrame:
    """bucket: the number of the interval (b, next] that a length is in; others drop."""
    bucket = F.lit(None).cast("int")
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when((F.col(length) > bounds[k]) & (F.col(length) <= bounds[k + 1]), F.lit(k)).otherwise(bucket)
    return rows.withColumn("bucket", bucket).filter("bucket is not null")


def pad_and_batch(rows: DataFrame, key: str, batch: int, replicas: int, seed: int) -> DataFrame:
    """Places of rows (with bucket) in batches: each bucket shuffled, filled up to a multiple of batch * replicas by going
    round (turn), dealt to replicas by turns, cut into batches in a shuffled order."""
    t = shuffled_places(rows, key, seed, ("bucket",), "_i")
    group = batch * replicas
    full = F.ceil(F.col("size") / group) * group
    turns = F.explode(F.sequence(F.lit(0), F.floor((full - 1 - F.col("_i")) / F.col("size"))))
    t = t.withColumn("turn", turns).withColumn("_pos", F.col("_i") + F.col("turn") * F.col("size"))
    t = t.withColumns({"replica": F.pmod("_pos", F.lit(replicas)), "_q": F.floor(F.col("_pos") / replicas)})
    t = t.withColumns({"batch_in_bucket": F.floor(F.col("_q") / batch), "slot": F.pmod("_q", F.lit(batch))})
    return t.withColumn("batch_order", shuffle_key("bucket", "batch_in_bucket", seed=seed + 1)).drop("_i", "_pos", "_q")


def pad_collate(rows: DataFrame, batch: str, samples: str, key: str) -> DataFrame:
    """Rows of a batch numbered longest first, padded with zeros to the longest, with their lengths."""
    n = F.size(samples)
    w = Window.partitionBy(batch)
    t = rows.withColumns({"length": n, "_most": F.max(n).over(w), "row": F.row_number().over(w.orderBy(n.desc(), key)) - 1})
    return t.withColumn(samples, F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), F.col("_most") - F.col("length")))).drop("_most")


def align_lengths(rows: DataFrame, phone: str, spec: str, pitch: str, most: int = 900) -> DataFrame:
    """phone with every element twice, all cut to the shortest of phone and spec and to most."""
    twice = F.flatten(F.transform(phone, lambda x: F.array(x, x)))
    t = rows.withColumn(phone, twice)
    n = F.least(F.size(phone), F.size(spec), F.lit(most))
    return t.withColumns({c: F.slice(c, F.lit(1), n) for c in (phone, spec, pitch)})


def last_aligned_windows(clips: DataFrame, length: str, window: float) -> DataFrame:
    """start of every whole window from 0 on, and of one more that ends with the clip."""
    k = F.floor(F.col(length) / window)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: i * window)
    starts = F.when(k >= 1, starts).otherwise(F.expr("cast(array() as array<double>)"))
    return clips.select("*", F.explode(F.concat(starts, F.array(F.greatest(F.col(length) - window, F.lit(0.0))))).alias("start"))


def cut_fixed(slices: DataFrame, per: float = 3.7, overlap: float = 0.3) -> DataFrame:
    """Pieces of slices (clip, slice_no, length in seconds): starts every per - overlap while more than per + overlap is
    left; only the last slice of a clip keeps its tail. Numbers go on over a clip whether a tail is kept or not."""
    step, tail = per - overlap, per + overlap
    whole = F.greatest(F.ceil(F.round((F.col("length") - tail) / step, 9)), F.lit(0)).cast("int")
    w = Window.partitionBy("clip").orderBy("slice_no")
    t = slices.withColumns({"_n": whole, "_last": F.lead("slice_no").over(w).isNull()})
    t = t.withColumn("_base", F.coalesce(F.sum(F.col("_n") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.select("*", F.explode(F.sequence(F.lit(0), "_n")).alias("_k")).filter((F.col("_k") < F.col("_n")) | F.col("_last"))
    start = F.col("_k") * step
    end = F.when(F.col("_k") < F.col("_n"), start + per).otherwise(F.col("length"))
    return t.select("clip", "slice_no", (F.col("_base") + F.col("_k")).alias("number"), start.alias("start"), end.alias("end"))


def slice_on_silence(rms: DataFrame, threshold: float, least: int, interval: int, kept: int) -> DataFrame:
    """Hop ranges of clips between silences from (clip, hop, rms, n_samples): the table of levels is small, a clip is a group."""

    def run(frames):
        for f in frames:
            rows = []
            for clip, n, levels in zip(f["clip"], f["n_samples"], f["rms"], strict=True):
                found = decoding.slice_on_silence(np.asarray(levels, "float64"), int(n), threshold, least, interval, kept)
                rows += [(clip, k, a, b) for k, (a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["clip", "slice_no", "s", "e"])

    t = rms.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("hop", "rms", "n_samples"))).alias("_l"))
    t = t.select("clip", F.col("_l")[0]["n_samples"].alias("n_samples"), F.transform("_l", lambda x: x["rms"].cast("double")).alias("rms"))
    return t.mapInPandas(run, "clip long, slice_no int, s int, e int")


def protect_mix(rows: DataFrame, feats: str, orig: str, pitch: str, p: float) -> DataFrame:
    """feats kept where there is pitch, else mixed with orig by p; nothing happens for p of 0.5 or more."""
    if p >= 0.5:
        return rows
    w = F.when(F.col(pitch) > 0, 1.0).when(F.col(pitch) < 1, p).otherwise(F.col(pitch).cast("double"))
    return rows.withColumn(feats, F.zip_with(feats, orig, lambda a, b: a * w + b * (1 - w)))
