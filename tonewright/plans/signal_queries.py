"""Queries over waveforms, spectra, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, learning, signal, transcribe, windows
from ..streaming import jobs
from .catalog import Catalog, rounded
from .source_queries import shared_folder, written
from .testbed import FRAMES, NOTES, SAMPLES, est_notes, frames, keyed, notes, samples, table, unkeyed

Q = Catalog()

CUT = "cut AS (SELECT s.* FROM samples s JOIN (SELECT clip, min(e) AS e FROM (SELECT clip, member, max(pos) AS e FROM samples GROUP BY ALL) GROUP BY clip) m ON m.clip = s.clip AND s.pos <= m.e)"


def _pieces(spark, sf_dir, size: int = 32):
    """Chunks of 32 samples of each member of each clip."""
    s = samples(spark, sf_dir).withColumn("chunk_no", F.floor(F.col("pos") / size).cast("int"))
    t = s.groupBy("clip", "member", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("samples"))
    return t.withColumn("start", (F.col("chunk_no") * size).cast("long"))


def _flat(chunks, *keys):
    """A row for each sample, to be compared with SQL."""
    t = chunks.select(*keys, "start", F.posexplode("samples").alias("_i", "x"))
    return t.select(*[k for k in keys], (F.col("start") + F.col("_i")).cast("int").alias("pos"), "x")


@Q.add("a15_ensemble_avg", f"WITH {SAMPLES}, {CUT} SELECT clip, pos, round(sum(x * (CASE WHEN member = 1 THEN 2 ELSE 1 END)) / sum(CASE WHEN member = 1 THEN 2 ELSE 1 END), 4) + 0.0 AS x FROM cut GROUP BY ALL")
def a15(spark, sf_dir):
    return rounded(_flat(signal.ensemble(_pieces(spark, sf_dir), "avg", {1: 2.0, **{k: 1.0 for k in range(2, 8)}}), "clip"))


@Q.add("a15_ensemble_median", f"WITH {SAMPLES}, {CUT} SELECT clip, pos, round(quantile_cont(x, 0.5), 4) + 0.0 AS x FROM cut GROUP BY ALL")
def a15_median(spark, sf_dir):
    return rounded(_flat(signal.ensemble(_pieces(spark, sf_dir), "median"), "clip"))


@Q.add("a15_ensemble_min", f"WITH {SAMPLES}, {CUT} SELECT clip, pos, round(arg_min(x, (abs(x), member)), 4) + 0.0 AS x FROM cut GROUP BY ALL")
def a15_min(spark, sf_dir):
    return rounded(_flat(signal.ensemble(_pieces(spark, sf_dir), "min"), "clip"))


@Q.add("a15_ensemble_max", f"WITH {SAMPLES}, {CUT} SELECT clip, pos, round(arg_max(x, (abs(x), -member)), 4) + 0.0 AS x FROM cut GROUP BY ALL")
def a15_max(spark, sf_dir):
    return rounded(_flat(signal.ensemble(_pieces(spark, sf_dir), "max"), "clip"))


@Q.add("a16_ensemble_fft")
def a16(spark, sf_dir):
    return rounded(_flat(signal.ensemble_fft(_pieces(spark, sf_dir), "max", n=32, hop=16), "clip"))


CHUNKS = """chunks AS (SELECT clip, member, CAST(k AS INTEGER) AS chunk_no, CAST(k * 12 AS BIGINT) AS "start", list(x ORDER BY pos) AS xs FROM samples JOIN (SELECT unnest(range(0, (SELECT max(pos) // 12 + 1 FROM samples))) AS k) ON pos >= k * 12 AND pos < k * 12 + 16 GROUP BY ALL)"""


def _overlapping(spark, sf_dir):
    s = keyed(samples(spark, sf_dir))
    k = F.floor(F.col("pos") / 12)
    t = s.withColumn("chunk_no", F.explode(F.filter(F.array(k, F.when((F.col("pos") % 12 < 4) & (k > 0), k - 1)), lambda x: x.isNotNull())))
    t = t.groupBy("clip", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("samples"))
    return t.withColumn("start", F.col("chunk_no") * 12)


@Q.add(
    "a17_overlap_add",
    f"""WITH {SAMPLES}, {CHUNKS}, c AS (SELECT *, len(xs) AS n, max("start" + len(xs)) OVER (PARTITION BY clip, member) AS e FROM chunks), s AS (SELECT clip, member, "start" + i - 1 AS pos, xs[i] AS v,
      (CASE WHEN "start" = 0 OR i - 1 >= 4 THEN 1 ELSE (i - 1) / 3 END) * (CASE WHEN "start" + n >= e OR i - 1 < n - 4 THEN 1 ELSE (n - i) / 3 END) AS w FROM c, range(1, 17) AS t(i) WHERE i <= n)
    SELECT clip, member, CAST(pos AS INTEGER) AS pos, round(CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE 0 END, 4) + 0.0 AS x FROM s GROUP BY ALL""",
)
def a17(spark, sf_dir):
    return rounded(unkeyed(_flat(signal.overlap_add(_overlapping(spark, sf_dir), 4, 24), "clip")))


def _channels(spark, sf_dir):
    return _pieces(spark, sf_dir).withColumn("channel", F.col("member") - 1).drop("member")


@Q.add(
    "a18_standardise",
    f"""WITH {SAMPLES}, c AS (SELECT clip, member - 1 AS channel, pos, x FROM samples), m AS (SELECT clip, pos, avg(x) AS m FROM c GROUP BY ALL), f AS (SELECT clip, avg(m) AS mean, stddev_pop(m) AS std FROM m GROUP BY clip)
    SELECT c.clip, channel, pos, round((x - mean) / std, 4) + 0.0 AS x, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std FROM c JOIN f ON f.clip = c.clip""",
)
def a18(spark, sf_dir):
    return rounded(_flat(signal.standardise(_channels(spark, sf_dir)), "clip", "channel", "mean", "std"))


@Q.add("a18_destandardise", f"WITH {SAMPLES} SELECT clip, member - 1 AS channel, pos, round(x, 4) + 0.0 AS x FROM samples")
def a18_back(spark, sf_dir):
    return rounded(_flat(signal.destandardise(signal.standardise(_channels(spark, sf_dir), sample_std=True)), "clip", "channel"))


@Q.add("a19_normalise_stems", f"WITH {SAMPLES}, p AS (SELECT *, max(abs(x)) OVER (PARTITION BY clip) AS p FROM samples) SELECT clip AS song, member AS stem, round(sum(abs(CASE WHEN p > 0 THEN x * (0.8::DOUBLE / p) ELSE x END)), 3) AS total FROM p GROUP BY ALL")
def a19(spark, sf_dir):
    t = signal.normalise_stems(_pieces(spark, sf_dir).withColumnsRenamed({"clip": "song", "member": "stem"}), 0.8)
    return rounded(t.groupBy("song", "stem").agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("total")), digits=3)


VARIANT = "CASE (member - 1) // 2 WHEN 0 THEN 'plain' WHEN 1 THEN 'swapped' ELSE 'flipped' END"


@Q.add(
    "a20_merge_variants",
    f"""WITH {SAMPLES}, v AS (SELECT clip, pos, {VARIANT} AS variant, (member - 1) % 2 AS channel, x FROM samples)
    SELECT clip, CAST(CASE WHEN variant = 'swapped' THEN 1 - channel ELSE channel END AS INTEGER) AS channel, pos, round(avg(CASE WHEN variant = 'flipped' THEN -x ELSE x END), 4) + 0.0 AS x FROM v GROUP BY ALL""",
)
def a20(spark, sf_dir):
    k = F.floor((F.col("member") - 1) / 2)
    v = F.when(k == 0, "plain").when(k == 1, "swapped").otherwise("flipped")
    t = _pieces(spark, sf_dir).select("clip", v.alias("variant"), ((F.col("member") - 1) % 2).alias("channel"), "chunk_no", "start", "samples")
    return rounded(_flat(signal.merge_variants(t), "clip", "channel"))


@Q.add(
    "a21_noise_gate",
    f"""WITH {FRAMES}, d AS (SELECT track_id AS clip, idx AS frame, CAST(idx % 4 AS INTEGER) AS freq, 20 * log10(greatest(abs(flux), 1e-40)) AS db FROM frames), g AS (SELECT *, greatest(db, max(db) OVER (PARTITION BY clip, freq) - 40) AS g FROM d),
    c AS (SELECT *, avg(g) OVER (PARTITION BY clip, freq) + 1.5 * stddev_samp(g) OVER (PARTITION BY clip, freq) AS c FROM g) SELECT clip, frame, freq, CAST(coalesce(g > c, false) AS INTEGER) AS mask FROM c""",
)
def a21(spark, sf_dir):
    """Frames of four bins: each value of the track is a bin."""
    f = frames(spark, sf_dir).groupBy(F.col("track_id").alias("clip"), F.floor(F.col("idx") / 4).alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "flux"))), lambda v: v["flux"]).alias("mag"))
    t = signal.noise_gate(f).select("clip", "frame", F.posexplode("mask").alias("freq", "mask"))
    return t.select("clip", (F.col("frame") * 4 + F.col("freq")).cast("int").alias("frame"), "freq", "mask")


@Q.add("j13_residual_stem", f"WITH {SAMPLES} SELECT a.clip, a.pos // 32 AS chunk_no, round(sum(abs(a.x - b.x)), 3) AS total FROM samples a JOIN samples b ON a.clip = b.clip AND a.pos = b.pos AND a.member = 1 AND b.member = 2 GROUP BY ALL")
def j13(spark, sf_dir):
    m = _pieces(spark, sf_dir).withColumn("channel", F.lit(0))
    t = signal.residual_stem(m.filter("member = 1").drop("member"), m.filter("member = 2").drop("member", "start"))
    return t.select("clip", "chunk_no", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(x), F.lit(0.0))), 3).alias("total"))


def _chunks(spark, sf_dir, size: int = 32):
    """Chunks of 32 samples of each member of each clip."""
    s = keyed(samples(spark, sf_dir)).withColumn("chunk_no", F.floor(F.col("pos") / size).cast("int"))
    t = s.groupBy("clip", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("samples"))
    return t.withColumn("start", (F.col("chunk_no") * size).cast("long"))


#: Root mean squares of 16 samples around every eighth one, the clip mirrored at its ends.
RMS = """l AS (SELECT clip, member, list(x ORDER BY pos) AS xs, count(*) AS n FROM samples GROUP BY ALL), k AS (SELECT *, unnest(range(0, n // 8 + 1)) AS k FROM l),
rms AS (SELECT clip, member, n, k, sqrt(list_avg(list_transform(range(k * 8 - 8, k * 8 + 8), lambda q: pow(xs[CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END + 1], 2)))) AS r FROM k)"""


@Q.add("v11_frame_rms_db", f"WITH {SAMPLES}, {RMS} SELECT clip, member, k AS frame, round(20 * log10(r + 1e-9), 3) + 0.0 AS rms_db FROM rms UNION ALL SELECT clip, member, n // 8 + i, -120.0::DOUBLE FROM l, (VALUES (1), (2)) AS v(i)")
def v11(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    lengths = c.groupBy("clip").agg((F.floor(F.sum(F.size("samples")) / 8) + 3).cast("int").alias("n_frames"))
    return rounded(unkeyed(signal.pad_frames(signal.frame_rms_db(c, 16, 8), lengths)), digits=3)


@Q.add("v12_spectral_cues")
def v12(spark, sf_dir):
    return rounded(unkeyed(signal.spectral_cues(_chunks(spark, sf_dir), 1000, 16, 8, 6)))


@Q.add("v13_log_mel")
def v13(spark, sf_dir):
    t = signal.log_mel(_chunks(spark, sf_dir), 1000, 16, 8, 6, low=10.0, high=500.0)
    return rounded(unkeyed(t.select("clip", "frame", F.aggregate("mel", F.lit(0.0), lambda a, x: a + x).alias("total"))))


@Q.add("v13_linear_spec")
def v13_linear(spark, sf_dir):
    t = signal.linear_spec(_chunks(spark, sf_dir), 16, 8)
    return rounded(unkeyed(t.select("clip", "frame", F.aggregate("mag", F.lit(0.0), lambda a, x: a + x).alias("total"))))


T2, F2 = signal.triangle(2), signal.triangle(1)


@Q.add(
    "v14_smooth_mask",
    f"""WITH m AS (SELECT vec_id // 100 AS clip, vec_id % 100 AS frame, i - 1 AS f, CAST(embedding[i] > 0 AS INTEGER)::DOUBLE AS m FROM embeddings, range(1, 65) AS t(i)), k AS (SELECT * FROM (VALUES {', '.join(f'({d - 2}, {w}::DOUBLE)' for d, w in enumerate(T2))}) AS a(dt, wt), (VALUES {', '.join(f'({d - 1}, {w}::DOUBLE)' for d, w in enumerate(F2))}) AS b(df, wf)),
    s AS (SELECT a.clip, a.frame, a.f, sum(coalesce(b.m, 0) * wt * wf) AS v FROM m a CROSS JOIN k LEFT JOIN m b ON b.clip = a.clip AND b.frame = a.frame + dt AND b.f = a.f + df GROUP BY ALL) SELECT clip, frame, round(sum(v * (f + 1)), 3) AS total FROM s GROUP BY ALL""",
)
def v14(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("clip"), (F.col("vec_id") % 100).alias("frame"), F.transform("embedding", lambda x: (x > 0).cast("double")).alias("mask"))
    t = signal.smooth_mask(t, 1, 2)
    return t.select("clip", "frame", F.round(F.aggregate(F.transform("mask", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@Q.add(
    "v15_rms_envelope_mix",
    f"""WITH {SAMPLES}, {RMS}, e AS (SELECT clip, member, any_value(n) AS n, list(r ORDER BY k) AS rs FROM rms GROUP BY ALL), t AS (SELECT s.clip, s.member, s.pos, s.x, rs, len(rs) AS m, least(greatest((s.pos + 0.5) * len(rs) / n - 0.5, 0), len(rs) - 1) AS spot FROM samples s JOIN e ON e.clip = s.clip AND e.member = s.member),
    u AS (SELECT *, rs[CAST(floor(spot) AS BIGINT) + 1] * (1 - (spot - floor(spot))) + coalesce(rs[CAST(floor(spot) AS BIGINT) + 2], 0) * (spot - floor(spot)) AS a FROM t)
    SELECT clip, member, CAST(pos // 32 AS INTEGER) AS chunk_no, round(sum(abs(0.5 * x) * pow(a, 0.75) * pow(greatest(0.5 * a, 1e-6), -0.75)), 4) + 0.0 AS total FROM u GROUP BY ALL""",
)
def v15(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    t = signal.rms_envelope_mix(c, c.withColumn("samples", F.transform("samples", lambda x: x * 0.5)), 0.25, 8)
    return rounded(unkeyed(t.select("clip", "chunk_no", F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("total"))))


@Q.add(
    "v16_window_with_context",
    f"""WITH {FRAMES}, n AS (SELECT track_id, max(idx) // 16 AS last FROM frames GROUP BY track_id) SELECT f.track_id, CAST(b AS BIGINT) AS block, idx, b = idx // 16 AS core FROM frames f JOIN n USING (track_id), range(0, 20) AS t(b) WHERE b <= last AND idx >= b * 16 - 3 AND idx < (b + 1) * 16 + 3""",
)
def v16(spark, sf_dir):
    return signal.window_with_context(frames(spark, sf_dir), 16, 3).select("track_id", "block", "idx", "core")


@Q.add(
    "v16_padded_windows",
    f"""WITH {FRAMES}, n AS (SELECT track_id, max(idx) AS n FROM frames GROUP BY track_id), w AS (SELECT track_id, n, CAST(b AS BIGINT) AS block, CAST(p AS INTEGER) AS idx FROM n, range(0, 20000) AS t(b), range(b * 16 - 3, (b + 1) * 16 + 3) AS u(p) WHERE b <= n // 16)
    SELECT w.track_id, block, w.idx, f.idx IS NOT NULL AND w.idx // 16 = block AND w.idx >= 0 AS core, round(coalesce(f.flux, -11.5129), 4) + 0.0 AS flux FROM w LEFT JOIN frames f ON f.track_id = w.track_id AND f.idx = w.idx""",
)
def v16_padded(spark, sf_dir):
    return rounded(signal.window_with_context(frames(spark, sf_dir).select("track_id", "idx", "flux"), 16, 3, pad={"flux": -11.5129}).select("track_id", "block", "idx", "core", "flux"))


@Q.add("v16_put_together", f"WITH {FRAMES} SELECT track_id, idx, round(flux, 4) + 0.0 AS flux, k AS variant FROM frames, (VALUES (1), (2)) AS v(k)")
def v16_together(spark, sf_dir):
    """Blocks with context, and half-overlapping segments, back to the frames that they were dealt from."""
    f = frames(spark, sf_dir).select("track_id", "idx", "flux")
    one, two = signal.window_with_context(f, 16, 3, pad={"flux": -11.5129}), signal.half_overlapping(f, 16)
    return rounded(signal.without_context(one).withColumn("variant", F.lit(1)).unionByName(signal.without_context(two).withColumn("variant", F.lit(2))))


@Q.add("v14_denoise")
def v14_denoise(spark, sf_dir):
    """All members of all clips without what their gates mask by nine tenths, back as sound."""
    t = signal.denoise(_chunks(spark, sf_dir), 16, 4, 0.5, 0.9, 1, 2, 8)
    return rounded(unkeyed(_flat(t, "clip")))


@Q.add("v16_half_overlapping", f"""WITH {FRAMES} SELECT track_id, CAST(s AS BIGINT) AS segment, idx, (idx - s * 8 >= 4 AND idx - s * 8 < 12) OR (s = 0 AND idx < 4) AS core FROM frames, range(0, 20) AS t(s) WHERE idx >= s * 8 AND idx < s * 8 + 16""")
def v16_half(spark, sf_dir):
    return signal.half_overlapping(frames(spark, sf_dir), 16).select("track_id", "segment", "idx", "core")


@Q.add(
    "w16_quiet_cut_points",
    f"""WITH {SAMPLES}, l AS (SELECT clip, member, list(abs(x) ORDER BY pos) AS xs, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) > 40), a AS (SELECT *, unnest(range(20, n, 20)) AS spot FROM l), p AS (SELECT *, unnest(range(greatest(spot - 6, 0), least(spot + 6, n))) AS pos FROM a),
    s AS (SELECT clip, member, spot, pos, round_even(list_sum(list_transform(range(pos - 4, pos + 4), lambda q: xs[CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END + 1])), 9) AS s FROM p) SELECT clip, member, spot AS "at", arg_min(pos, (s, pos)) AS cut FROM s GROUP BY ALL""",
)
def w16(spark, sf_dir):
    return unkeyed(windows.quiet_cut_points(_chunks(spark, sf_dir), 20, 6, 8, 40))


def _seconds(notes):
    return notes.withColumns({c: F.col(c) / 10 for c in ("start", "end")})


def _reference(spark, sf_dir):
    """The notes that models are scored against, as several steps use them."""
    return written(spark, _seconds(notes(spark, sf_dir)).select("track_id", "note_no", "start", "end", "pitch"))


def _labelled(spark, sf_dir, ref=None):
    """Frames get their label before their features, which are wide and stay where they're made."""
    n = _seconds(notes(spark, sf_dir)) if ref is None else ref
    return windows.frame_features(evaluation.onset_labels(frames(spark, sf_dir), n, 1, 10.0), keep=("label",))


@Q.add("m1_train_onset_model")
def m1(spark, sf_dir):
    """The share of each feature in the model of all tracks."""
    return rounded(spark.createDataFrame(learning.importances(learning.train_onset_model(written(spark, _labelled(spark, sf_dir)))), "feature string, importance double"))


@Q.add("m2_score_onsets")
def m2(spark, sf_dir):
    t = written(spark, _labelled(spark, sf_dir))
    model = learning.train_onset_model(t.filter("track_id % 2 = 0"))
    return rounded(learning.score_onsets(model, t.filter("track_id % 2 = 1")))


@Q.add("m3_cross_validate")
def m3(spark, sf_dir):
    n = _reference(spark, sf_dir)
    out = transcribe.cross_validate(_labelled(spark, sf_dir, n), frames(spark, sf_dir), n, store=lambda t, name: written(spark, t))
    return rounded(out)


@Q.add("q_method_report")
def method_report(spark, sf_dir):
    """How far a second annotator, decoding alone and the cross-validated onset model agree with the notes."""
    n, second = _reference(spark, sf_dir), _seconds(est_notes(spark, sf_dir)).filter("start >= 0")
    return rounded(transcribe.compare_methods(_labelled(spark, sf_dir, n), frames(spark, sf_dir), n, second, store=lambda t, name: written(spark, t)))


#: Rows in one file of a stream's input.
FILE_ROWS = 100_000


def _stream(spark, batch, slices: int = 3):
    """The rows as a stream of a few slices of time, each some files of a bounded number of rows."""
    path = shared_folder(spark)
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    facts = batch.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)]).alias("cuts"), F.count("*").alias("n")).first()
    files = max(1, facts["n"] // (slices * FILE_ROWS))
    cuts = facts["cuts"] or []
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):  # one write after another, so that slices are read in order of time
        part = batch.filter((F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi))
        part.repartition(files).write.mode("append" if k else "error").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(spark, stream, mode: str):
    """The result of a streaming query over all of its input, through a Parquet sink (append) or the memory of an update."""
    path = shared_folder(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def put(frame, n):
        frame.withColumn("_n", F.lit(n)).write.parquet(f"{path}/n={n}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/*")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")) if "start" in out.columns else out




def _levels(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", (F.col("value") / 100).alias("x"), "event_id")


GATE = """SELECT user_id AS session, w AS "start", round(sqrt(avg(pow(value / 100, 2))), 4) AS rms, 20 * log10(greatest(sqrt(avg(pow(value / 100, 2))), 1e-10)) >= -12 AS open FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY ALL"""


@Q.add("t1_voice_gate_stream", GATE)
def t1(spark, sf_dir):
    s = _stream(spark, _levels(spark, sf_dir).select("session", "ts", "x"))
    out = _run(spark, jobs.voice_gate(s, "1 hour", "4 hours", -12.0, "10 days"), "update")
    last = out.withColumn("_r", F.row_number().over(Window.partitionBy("session", "start").orderBy(F.col("_n").desc()))).filter("_r = 1")
    return rounded(last.select("session", "start", "rms", "open"), "rms")


@Q.add("t2_tumbling_block_rms", """SELECT user_id AS session, time_bucket(INTERVAL 1 DAY, ts) AS "start", round(sqrt(avg(pow(value / 100, 2))), 4) AS rms, count(*) AS n FROM events GROUP BY ALL""")
def t2(spark, sf_dir):
    s = _stream(spark, _levels(spark, sf_dir).select("session", "ts", "x"))
    out = _run(spark, jobs.block_rms(s, "1 day", "10 days"), "update")
    last = out.withColumn("_r", F.row_number().over(Window.partitionBy("session", "start").orderBy(F.col("_n").desc()))).filter("_r = 1")
    return rounded(last.select("session", "start", "rms", "n"), "rms")


@Q.add("t3_drop_repeated_blocks", "SELECT user_id AS session, event_id // 3 AS seq FROM events GROUP BY ALL")
def t3(spark, sf_dir):
    b = _levels(spark, sf_dir).select("session", "ts", F.floor(F.col("event_id") / 3).alias("seq"))
    return _run(spark, jobs.drop_repeated(_stream(spark, b), "10 days").select("session", "seq"), "append")


def _blocks(spark, sf_dir, number: str | None = None):
    e = table(spark, sf_dir, "events")
    seq = F.col(number) if number else F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.sin(F.col("event_id") * 0.7 + i * 0.9) * F.col("value") / 100)
    t = e.select(F.col("user_id").alias("session"), "ts", seq.cast("long").alias("seq"), x.alias("samples"))
    return t if number else written(spark, t)  # numbered once, not for each slice of the stream


def _summed(t):
    """The length of a block, the sum of its values, and their sum weighted by place."""
    placed = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(t.select("session", "seq", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), placed.alias("placed")), digits=3)


@Q.add(
    "t4_pitch_ring",
    """WITH e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, value FROM events),
    p AS (SELECT session, seq + j AS seq, 25 - 6 * j + k AS place, sin(event_id * 0.7::DOUBLE + (k + 3) * 0.9::DOUBLE) * value / 100 AS x FROM e, range(0, 5) AS a(j), range(0, 8) AS b(k) WHERE j = 0 OR k < 6)
    SELECT p.session, p.seq, 32 AS n, round(sum(x), 3) + 0.0 AS total, round(sum(place * x), 3) + 0.0 AS placed FROM p JOIN e ON e.session = p.session AND e.seq = p.seq GROUP BY p.session, p.seq""",
)
def t4(spark, sf_dir):
    """Blocks of 12 values move the ring on by 6 and fill its last 8 places."""
    return _summed(_run(spark, jobs.pitch_ring(_stream(spark, _blocks(spark, sf_dir)), 32, 6, first=1), "append"))


@Q.add("t5_stitch_blocks")
def t5(spark, sf_dir):
    return _summed(_run(spark, jobs.stitch_blocks(_stream(spark, _blocks(spark, sf_dir)), 3, 2, first=1), "append"))


#: Each sample of a session with its place, its source and its output, and by hops of 8 the levels of both at the end of four hops.
LIVE = """e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, value FROM events),
x AS (SELECT session, seq, (seq - 1) * 12 + i AS p, sin(event_id * 0.7::DOUBLE + i * 0.9::DOUBLE) * value / 100 AS y FROM e, range(0, 12) AS t(i)),
n AS (SELECT session, max(p) + 1 AS n FROM x GROUP BY session), h AS (SELECT session, p // 8 AS h, avg(y * y) AS ms FROM x GROUP BY ALL HAVING count(*) = 8),
l AS (SELECT session, h, sqrt(sum(ms) OVER (PARTITION BY session ORDER BY h ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4) AS r FROM h)"""


@Q.add(
    "v15_live_loudness_mix",
    f"""WITH {LIVE}, g AS (SELECT x.session, x.p, x.seq, 0.5 * x.y AS y, coalesce(b.r, 0) + (a.r - coalesce(b.r, 0)) * (x.p % 8) / 8.0 AS r FROM x JOIN l a ON a.session = x.session AND a.h = x.p // 8 LEFT JOIN l b ON b.session = x.session AND b.h = x.p // 8 - 1)
    SELECT session, count(*) AS n, round(sum(y * pow(r / greatest(0.5 * r, 1e-3), 0.75)), 3) + 0.0 AS total, round(sum((p % 7 + 1) * y * pow(r / greatest(0.5 * r, 1e-3), 0.75)), 3) + 0.0 AS placed FROM g GROUP BY session""",
)
def v15_live(spark, sf_dir):
    """Blocks of 12 values brought back to the loudness of a source of twice their level, in hops of 8: most blocks end inside a hop."""
    b = _blocks(spark, sf_dir).withColumnRenamed("samples", "source").withColumn("output", F.transform("source", lambda x: x * 0.5))
    t = _run(spark, jobs.loudness_mix(_stream(spark, b), 0.25, 8, first=1), "append")
    # A block gives the hops that it completes: those up to its last sample, after those of the blocks before.
    first = F.floor((F.col("seq") - 1) * 12 / 8) * 8
    t = t.withColumn("m", F.transform("samples", lambda x, i: x * (F.pmod(first + i, F.lit(7)) + 1)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(t.groupBy("session").agg(F.sum(F.size("samples")).alias("n"), F.sum(add("samples")).alias("total"), F.sum(add("m")).alias("placed")), digits=3)


@Q.add(
    "t1_muted_blocks",
    """WITH b AS (SELECT user_id AS session, event_id AS seq, ts, value / 100 AS x, event_id, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), s AS (SELECT session, seq, h, i, sin(event_id * 0.7::DOUBLE + i * 0.9::DOUBLE) * x AS y FROM b, range(0, 12) AS t(i)),
    q AS (SELECT session, h, sum(y * y) AS q, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT a.session, a.h, sum(b.q) / sum(b.n) AS ms FROM q a JOIN q b ON b.session = a.session AND b.h <= a.h AND b.h > a.h - INTERVAL 4 HOUR GROUP BY ALL)
    SELECT s.session, s.seq, round(sum(CASE WHEN 10 * log10(greatest(ms, 1e-20)) >= -12 THEN abs(y) ELSE 0 END), 4) + 0.0 AS total FROM s JOIN l ON l.session = s.session AND l.h = s.h GROUP BY s.session, s.seq""",
)
def t1_muted(spark, sf_dir):
    """A last row of a session of its own, long after the others, moves the watermark past all windows."""
    b = _blocks(spark, sf_dir, "event_id")
    after = b.agg(F.max("ts").alias("ts")).filter("ts is not null").select(F.lit(-1).cast("long").alias("session"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.array(F.lit(0.0)).alias("samples"))
    out = _run(spark, jobs.muted_blocks(_stream(spark, b.unionByName(after)), "1 hour", "4 hours", -12.0, "10 days"), "append")
    return rounded(out.filter("session >= 0").select("session", "seq", F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("total")))


@Q.add(
    "t6_live_note_score",
    f"""WITH {NOTES}, s AS (SELECT user_id % 100 AS track_id, ts, (event_id % 1500) / 10.0::DOUBLE AS t, 48 + event_id % 25 + (event_id % 7 - 3) * 0.1::DOUBLE AS midi FROM events), j AS (SELECT s.*, (midi - n.pitch) * 100 AS o FROM s JOIN notes n ON n.track_id = s.track_id AND t >= n."start" AND t < n."end"),
    c AS (SELECT *, abs(o - 1200 * floor(o / 1200 + 0.5)) AS c FROM j) SELECT track_id, time_bucket(INTERVAL 1 DAY, ts) AS "start", count(*) FILTER (c < 15) AS good, count(*) FILTER (c >= 15 AND c < 30) AS warn, count(*) FILTER (c >= 30) AS bad FROM c GROUP BY ALL""",
)
def t6(spark, sf_dir):
    e = F.col("event_id")
    sung = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("track_id"), "ts", ((e % 1500) / 10).alias("t"), (48 + e % 25 + (e % 7 - 3) * 0.1).alias("midi"))
    out = _run(spark, jobs.live_score(_stream(spark, sung), notes(spark, sf_dir), "1 day", "10 days"), "update")
    last = out.withColumn("_r", F.row_number().over(Window.partitionBy("track_id", "start").orderBy(F.col("_n").desc()))).filter("_r = 1")
    return last.select("track_id", "start", "good", "warn", "bad")


STAGES = list(jobs.BANDS)


@Q.add(
    "t7_latest_job_state",
    f"""WITH l AS (SELECT user_id AS stem, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id), s AS (SELECT stem, ({STAGES})[CAST(e % 4 + 1 AS BIGINT)] AS stage, (e % 11) / 10.0::DOUBLE AS f FROM l)
    SELECT stem, stage, round(CASE stage {' '.join(f"WHEN '{k}' THEN {a}::DOUBLE + {b - a}::DOUBLE * f" for k, (a, b) in jobs.BANDS.items())} END, 3) AS progress FROM s""",
)
def t7(spark, sf_dir):
    e = F.col("event_id")
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), "ts", e.alias("order"), F.element_at(F.array(*map(F.lit, STAGES)), (e % 4 + 1).cast("int")).alias("stage"), ((e % 11) / 10).alias("fraction"))
    out = _run(spark, jobs.latest_state(_stream(spark, states)), "update")
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy(F.col("_n").desc()))).filter("_r = 1").select("stem", "stage", "progress")
