"""Queries over pitch frames: scalars, voicing, keys, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import music
from ..operators import voicing, windows
from .catalog import Catalog, rounded
from .testbed import FRAMES, NOTES, frames, notes, table

Q = Catalog()

MIDI = "CASE WHEN f0 > 0 THEN 69 + 12 * log2(f0 / 440) END"
VOICED = FRAMES + f""", m AS (SELECT *, {MIDI} AS midi, quantile_cont(rms_db, 0.99) OVER (PARTITION BY track_id) AS ref FROM frames),
v AS (SELECT *, CASE WHEN rms_db > ref - 45 AND coalesce(midi >= 35.5 AND midi <= 96.5, false) THEN 1 / (1 + exp(-(conf - 0.4) / 0.08)) ELSE 0 END AS voice_p FROM m),
fv AS (SELECT *, voice_p > 0.5 AS voiced FROM v)"""
ROUND = lambda x: f"round({x}, 4) + 0.0"
NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@Q.add("p1_pitch_scales", f"WITH {FRAMES} SELECT track_id, idx, round({MIDI}, 4) AS midi, round(440 * pow(2, (({MIDI}) - 69) / 12), 4) AS hz FROM frames")
def p1(spark, sf_dir):
    t = frames(spark, sf_dir).withColumn("midi", music.hz_to_midi("f0"))
    return t.select("track_id", "idx", F.round("midi", 4).alias("midi"), F.round(music.midi_to_hz("midi"), 4).alias("hz"))


@Q.add("p2_note_names", f"WITH {NOTES} SELECT track_id, note_no, ({NAMES})[pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name FROM notes")
def p2(spark, sf_dir):
    return notes(spark, sf_dir).select("track_id", "note_no", music.note_name("pitch").alias("name"))


KEY_NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'G major' WHEN 1 THEN 'E minor' WHEN 2 THEN 'Bb' WHEN 3 THEN 'F#m' WHEN 4 THEN 'a min' ELSE 'C##' END"


@Q.add(
    "p3_parse_key",
    f"""SELECT p_partkey, k AS key, CASE k WHEN 'G major' THEN 7 WHEN 'E minor' THEN 4 WHEN 'Bb' THEN 10 WHEN 'F#m' THEN 6 WHEN 'a min' THEN 9 ELSE 2 END AS root,
    CASE WHEN k IN ('E minor', 'F#m', 'a min') THEN 'minor' ELSE 'major' END AS mode FROM (SELECT p_partkey, {KEY_NAMES} AS k FROM part)""",
)
def p3(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(KEY_NAMES).alias("key"))
    return t.withColumn("x", music.parse_key("key")).select("p_partkey", "key", "x.root", "x.mode")


@Q.add("p4_in_scale", f"WITH {FRAMES} SELECT track_id, idx, list_contains([0, 2, 3, 5, 7, 8, 10], CAST((CAST(round_even({MIDI}, 0) AS BIGINT) - 9 + 120) % 12 AS INTEGER)) AS inside FROM frames WHERE f0 > 0")
def p4(spark, sf_dir):
    t = frames(spark, sf_dir).filter("f0 > 0")
    return t.select("track_id", "idx", music.in_scale(music.hz_to_midi("f0"), F.lit(9), F.lit("minor")).alias("inside"))


@Q.add("p5_transpose", f"WITH {FRAMES} SELECT track_id, idx, round(f0 * pow(2, CAST(-5 AS DOUBLE) / 12), 4) AS f0 FROM frames")
def p5(spark, sf_dir):
    return frames(spark, sf_dir).select("track_id", "idx", F.round(music.transpose("f0", -5), 4).alias("f0"))


@Q.add(
    "p6_coarse_pitch",
    f"""WITH {FRAMES}, c AS (SELECT track_id, idx, 1127 * ln(1 + f0 / 700) AS m, 1127 * ln(1 + 50 / 700::DOUBLE) AS a, 1127 * ln(1 + 1100 / 700::DOUBLE) AS z FROM frames)
    SELECT track_id, idx, CAST(round_even(greatest(1, least(255, CASE WHEN m > 0 THEN (m - a) * 254 / (z - a) + 1 ELSE m END)), 0) AS INTEGER) AS coarse FROM c""",
)
def p6(spark, sf_dir):
    return frames(spark, sf_dir).select("track_id", "idx", music.coarse_pitch("f0").alias("coarse"))


@Q.add(
    "p7_pitch_bin",
    f"WITH {FRAMES} SELECT track_id, idx, CAST(round_even((1200 * log2(440 * pow(2, (({MIDI}) - 69) / 12) / 10) - {music.FIRST_BIN_CENTS}::DOUBLE) / 20, 0) AS INTEGER) AS bin FROM frames",
)
def p7(spark, sf_dir):
    return frames(spark, sf_dir).select("track_id", "idx", music.pitch_bin(music.hz_to_midi("f0")).alias("bin"))


@Q.add(
    "p8_cents_off",
    f"""WITH {FRAMES}, m AS (SELECT track_id, idx, {MIDI} AS x FROM frames WHERE f0 > 0), c AS (SELECT *, (x - floor(x + 0.5)) * 100 AS c FROM m)
    SELECT track_id, idx, {ROUND("c")} AS cents, CASE WHEN abs(c) < 15 THEN 'good' WHEN abs(c) < 30 THEN 'warn' ELSE 'bad' END AS class FROM c""",
)
def p8(spark, sf_dir):
    m = music.hz_to_midi("f0")
    t = frames(spark, sf_dir).filter("f0 > 0").select("track_id", "idx", music.cents_off(m).alias("cents"), music.cents_class(m).alias("class"))
    return rounded(t, "cents")


@Q.add(
    "p9_decode_salience",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s, list_position(embedding, list_max(embedding)) - 1 AS p FROM embeddings),
    o AS (SELECT vec_id, s, p, unnest(range(-4, 5)) AS d FROM e),
    w AS (SELECT vec_id, list_max(s) AS conf, s[least(greatest(p + d, 0), len(s) - 1) + 1] AS w, least(greatest(p + d, 0), len(s) - 1) * 20 + {music.FIRST_BIN_CENTS}::DOUBLE AS c FROM o),
    a AS (SELECT vec_id, any_value(conf) AS conf, sum(w) AS sw, sum(w * c) AS sc FROM w GROUP BY vec_id)
    SELECT vec_id, CASE WHEN conf <= 0.25 THEN 0.0 WHEN sw > 0.1 THEN round(10 * pow(2, sc / sw / 1200), 2) END AS f0, round(conf, 4) AS conf FROM a""",
)
def p9(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", music.decode_salience("embedding").alias("x"))
    # Embeddings also have negative elements: where the weights nearly cancel out a mean says nothing.
    at = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    weight = F.aggregate(F.transform(F.sequence(at - 4, at + 4), lambda i: F.get("embedding", F.least(F.greatest(i, F.lit(0)), F.size("embedding") - 1)).cast("double")), F.lit(0.0), lambda a, x: a + x)
    f0 = F.when(F.col("x.conf") <= 0.25, 0.0).when(weight > 0.1, F.round("x.f0", 2))
    return t.select("vec_id", f0.alias("f0"), F.round("x.conf", 4).alias("conf"))


@Q.add("f4_soft_voicing", f"WITH {VOICED} SELECT track_id, idx, {ROUND('voice_p')} AS voice_p, voiced FROM fv")
def f4(spark, sf_dir):
    return rounded(voicing.soft_voicing(frames(spark, sf_dir)).select("track_id", "idx", "voice_p", "voiced"))


@Q.add("f8_preview_prefix", f"WITH {FRAMES} SELECT track_id, idx FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) + 1 AS n FROM frames) WHERE n > 60 AND idx < 45")
def f8(spark, sf_dir):
    return voicing.preview_prefix(frames(spark, sf_dir), 45, 60, 1).select("track_id", "idx")


TUNING = "coalesce(atan2(avg(sin(2 * pi() * (midi - round_even(midi, 0)))), avg(cos(2 * pi() * (midi - round_even(midi, 0))))) / (2 * pi()), 0)"


@Q.add("a1_tuning", f"WITH {VOICED} SELECT track_id, {ROUND(TUNING)} AS tuning FROM fv WHERE voiced GROUP BY track_id")
def a1(spark, sf_dir):
    return rounded(voicing.estimate_tuning(voicing.soft_voicing(frames(spark, sf_dir)).filter("voiced")))


@Q.add(
    "a2_on_note_ratio",
    f"WITH {VOICED}, r AS (SELECT track_id, avg(CAST(abs(midi - round_even(midi, 0)) < 0.1 AS DOUBLE)) AS r FROM fv WHERE voiced GROUP BY track_id) SELECT track_id, {ROUND('r')} AS on_note, r >= 0.55 AS autotuned FROM r",
)
def a2(spark, sf_dir):
    return rounded(voicing.on_note_ratio(voicing.soft_voicing(frames(spark, sf_dir))))


HIST = """, pcs AS (SELECT track_id, CAST((CAST(round_even(midi, 0) AS BIGINT) % 12 + 12) % 12 AS INTEGER) AS pc FROM fv WHERE voiced),
hist AS (SELECT t.track_id, CAST(c.pc AS INTEGER) AS pc, count(p.pc) AS n FROM (SELECT DISTINCT track_id FROM pcs) t CROSS JOIN range(12) AS c(pc)
  LEFT JOIN pcs p ON p.track_id = t.track_id AND p.pc = c.pc GROUP BY ALL)"""


@Q.add("a3_pitch_class_histogram", f"WITH {VOICED}{HIST} SELECT * FROM hist")
def a3(spark, sf_dir):
    return voicing.pitch_class_histogram(voicing.soft_voicing(frames(spark, sf_dir)).filter("voiced"))


def _key_sql(hist: str, last: bool = False) -> str:
    way = "root DESC, mode DESC" if last else "root, mode"
    return f""", prof AS (SELECT CAST(r AS INTEGER) AS root, mode, CAST(p AS INTEGER) AS pc, (CASE mode WHEN 'major' THEN {list(music.MAJOR_PROFILE)} ELSE {list(music.MINOR_PROFILE)} END)[CAST((p - r + 12) % 12 + 1 AS BIGINT)] AS w
  FROM range(12) AS a(r), range(12) AS b(p), (VALUES ('major'), ('minor')) AS m(mode)),
cor AS (SELECT track_id, root, mode, round_even(corr(CAST(n AS DOUBLE), CAST(w AS DOUBLE)), 10) AS r FROM {hist} JOIN prof USING (pc) GROUP BY ALL),
keys AS (SELECT track_id, root, mode, r FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN r IS NULL OR isnan(r) THEN -2 ELSE r END DESC, {way}) AS k FROM cor) WHERE k = 1)"""


@Q.add("a4_detect_key", f"WITH {VOICED}{HIST}{_key_sql('hist')} SELECT track_id, root, mode FROM keys")
def a4(spark, sf_dir):
    v = voicing.soft_voicing(frames(spark, sf_dir)).filter("voiced")
    return voicing.detect_key(voicing.pitch_class_histogram(v)).select("track_id", "root", "mode")


@Q.add(
    "q_track_profile",
    f"""WITH {VOICED}{HIST}{_key_sql('hist')}, tun AS (SELECT track_id, {TUNING} AS tuning, avg(CAST(abs(midi - round_even(midi, 0)) < 0.1 AS DOUBLE)) AS r FROM fv WHERE voiced GROUP BY track_id)
    SELECT track_id, {ROUND('tuning')} AS tuning, {ROUND('tun.r')} AS on_note, tun.r >= 0.55 AS autotuned, root, mode FROM tun JOIN keys USING (track_id)""",
)
def track_profile(spark, sf_dir):
    return rounded(voicing.track_profile(frames(spark, sf_dir)).drop("r"))


@Q.add(
    "a5_track_summary",
    f"""WITH {VOICED}{HIST}{_key_sql('hist')}, {NOTES}, tun AS (SELECT track_id, {TUNING} AS tuning, avg(CAST(abs(midi - round_even(midi, 0)) < 0.1 AS DOUBLE)) AS r FROM fv WHERE voiced GROUP BY track_id),
    n AS (SELECT track_id, count(*) AS n_notes, min(pitch) AS low, max(pitch) AS high, ({NAMES})[min(pitch) % 12 + 1] || CAST(min(pitch) // 12 - 1 AS VARCHAR) AS low_name,
      ({NAMES})[max(pitch) % 12 + 1] || CAST(max(pitch) // 12 - 1 AS VARCHAR) AS high_name, round(440 * pow(2, (min(pitch) - 69)::DOUBLE / 12), 4) AS low_hz, round(440 * pow(2, (max(pitch) - 69)::DOUBLE / 12), 4) AS high_hz FROM notes GROUP BY track_id)
    SELECT n.*, round(100 * tuning, 2) + 0.0 AS tuning_cents, ({NAMES})[root + 1] || ' ' || mode AS key, round(tun.r, 4) AS on_note, tun.r >= 0.55 AS autotuned FROM n LEFT JOIN tun ON tun.track_id = n.track_id LEFT JOIN keys k ON k.track_id = n.track_id""",
)
def a5(spark, sf_dir):
    t = voicing.track_summary(notes(spark, sf_dir), voicing.track_profile(frames(spark, sf_dir)))
    return rounded(rounded(t, "tuning_cents", digits=2), "low_hz", "high_hz", "on_note")


CHROMA = "chroma AS (SELECT label AS track_id, CAST((i - 1) % 12 AS INTEGER) AS pc, sum(CAST(embedding[i] AS DOUBLE)) / count(DISTINCT vec_id) AS n FROM (SELECT label, vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)"


@Q.add("a22_average_chroma", f"WITH {CHROMA}{_key_sql('chroma', True)} SELECT c.track_id, c.pc, round(c.n, 4) + 0.0 AS n, k.root, k.mode FROM chroma c JOIN keys k USING (track_id)")
def a22(spark, sf_dir):
    """Vectors of 64 elements are folded to twelve classes."""
    folded = lambda k: F.aggregate(F.sequence(k, F.lit(63), F.lit(12)), F.lit(0.0), lambda s, i: s + F.get("embedding", i).cast("double"))
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("track_id"), F.transform(F.sequence(F.lit(0), F.lit(11)), folded).alias("chroma"))
    mean = voicing.average_chroma(t)
    return rounded(mean.join(voicing.detect_key(mean, highest=True).drop("r"), "track_id"))


@Q.add(
    "a24_display_range",
    f"""WITH {VOICED}, {NOTES}, r AS (SELECT track_id, midi, row_number() OVER (PARTITION BY track_id ORDER BY midi) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM fv WHERE voiced),
    c AS (SELECT track_id, max(CASE WHEN r = floor((n - 1) * 0.01::DOUBLE) THEN midi END) AS lo, max(CASE WHEN r = floor((n - 1) * 0.99::DOUBLE) THEN midi END) AS hi FROM r GROUP BY track_id),
    s AS (SELECT track_id, min(pitch) AS a, max(pitch) AS z FROM notes GROUP BY track_id)
    SELECT t.track_id, CAST(coalesce(floor(least(lo, a)) - 2, 55) AS INTEGER) AS low, CAST(coalesce(ceil(greatest(hi, z)) + 2, 80) AS INTEGER) AS high
    FROM (SELECT DISTINCT track_id FROM frames) t LEFT JOIN c ON c.track_id = t.track_id LEFT JOIN s ON s.track_id = t.track_id""",
)
def a24(spark, sf_dir):
    return voicing.display_range(notes(spark, sf_dir), voicing.soft_voicing(frames(spark, sf_dir)))


@Q.add(
    "v2_hmm_inputs",
    f"""WITH {VOICED}, p AS (SELECT track_id, floor(quantile_cont(midi, 0.005)) - 2 AS lo, ceil(quantile_cont(midi, 0.995)) + 2 AS hi, avg(CAST(abs(midi - round_even(midi, 0)) < 0.1 AS DOUBLE)) >= 0.55 AS autotuned FROM fv WHERE voiced GROUP BY track_id)
    SELECT track_id, CAST(greatest(36, lo) AS INTEGER) AS lo, CAST(least(96, hi) AS INTEGER) AS hi, CASE WHEN autotuned THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AS sigma, CASE WHEN autotuned THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END AS penalty, autotuned FROM p""",
)
def v2(spark, sf_dir):
    return voicing.hmm_inputs(voicing.soft_voicing(frames(spark, sf_dir)))


TW = "(PARTITION BY track_id ORDER BY idx)"
RUN = f"""r1 AS (SELECT *, CASE WHEN f0 > 0 AND coalesce(lag(f0) OVER {TW}, 0) <= 0 THEN 1 ELSE 0 END AS new FROM frames), r2 AS (SELECT *, sum(new) OVER {TW} AS run FROM r1)"""


@Q.add("w1_runs", f"""WITH {FRAMES}, {RUN} SELECT track_id, CAST(min(idx) AS INTEGER) AS s, CAST(max(idx) + 1 AS INTEGER) AS e FROM r2 WHERE f0 > 0 GROUP BY track_id, run""")
def w1(spark, sf_dir):
    return windows.runs(frames(spark, sf_dir).withColumn("on", F.col("f0") > 0), "on")


@Q.add(
    "w2_median_smooth",
    f"""WITH {FRAMES}, {RUN}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n, row_number() OVER (PARTITION BY track_id, run ORDER BY idx) AS i, list(f0) OVER (PARTITION BY track_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs FROM r2 WHERE f0 > 0),
    k AS (SELECT *, CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS k FROM n)
    SELECT track_id, idx, round(list_sort(list_transform(range(-k, k + 1), lambda d: xs[least(greatest(i + d, 1), n)]))[k + 1], 4) AS smooth FROM k""",
)
def w2(spark, sf_dir):
    t = windows.median_smooth(frames(spark, sf_dir), "f0", F.col("f0") > 0).filter("f0 > 0")
    return rounded(t.select("track_id", "idx", "smooth"))


@Q.add(
    "w3_median_smooth_zero",
    f"""WITH {FRAMES}, m AS (SELECT track_id, idx, coalesce(CASE WHEN f0 >= 100 THEN f0 END, quantile_cont(CASE WHEN f0 >= 100 THEN f0 END, 0.5) OVER (PARTITION BY track_id), 0) AS f FROM frames),
    l AS (SELECT track_id, idx, list(f) OVER {TW[:-1]} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS xs FROM m)
    SELECT track_id, idx, round(list_sort(list_concat(xs, list_transform(range(7 - len(xs)), lambda x: 0::DOUBLE)))[4], 4) AS smooth FROM l""",
)
def w3(spark, sf_dir):
    return rounded(windows.median_smooth_zero(frames(spark, sf_dir), low=100.0).select("track_id", "idx", "smooth"))


@Q.add(
    "w4_hold_pitch",
    f"""WITH {FRAMES}, m AS (SELECT *, {MIDI} AS midi, f0 > 0 AND conf > 0.4 AS voiced FROM frames)
    SELECT track_id, idx, round(coalesce(last_value(CASE WHEN voiced THEN midi END IGNORE NULLS) OVER {TW}, first_value(midi) OVER {TW},
      CASE WHEN bool_or(voiced) OVER (PARTITION BY track_id) THEN quantile_cont(midi, 0.5) OVER (PARTITION BY track_id) END, 60), 4) AS held FROM m""",
)
def w4(spark, sf_dir):
    t = frames(spark, sf_dir).withColumn("midi", music.hz_to_midi("f0")).withColumn("voiced", (F.col("f0") > 0) & (F.col("conf") > 0.4))
    return rounded(windows.hold_pitch(t, "midi", "voiced").select("track_id", "idx", "held"))


@Q.add(
    "w5_interpolate_gaps",
    f"""WITH {FRAMES}, g AS (SELECT track_id, idx, f0, last_value(CASE WHEN f0 > 0 THEN idx END IGNORE NULLS) OVER a AS i, last_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER a AS u,
      first_value(CASE WHEN f0 > 0 THEN idx END IGNORE NULLS) OVER b AS j, first_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER b AS v FROM frames
      WINDOW a AS (PARTITION BY track_id ORDER BY idx), b AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT track_id, idx, round(CASE WHEN f0 > 0 THEN f0 WHEN i IS NULL THEN v WHEN j IS NULL THEN u ELSE u + (idx - i)::DOUBLE / (j - i) * (v - u) END, 4) AS filled FROM g WHERE i IS NOT NULL OR j IS NOT NULL""",
)
def w5(spark, sf_dir):
    return rounded(windows.interpolate_gaps(frames(spark, sf_dir)).select("track_id", "idx", "filled"))


@Q.add(
    "w6_lag_lead",
    f"WITH {FRAMES} SELECT track_id, idx, " + ", ".join(f"round(lead(conf, {k}, 0) OVER {TW} - lag(conf, {k}, 0) OVER {TW}, 4) + 0.0 AS conf_{k}" for k in windows.LAGS) + " FROM frames",
)
def w6(spark, sf_dir):
    return rounded(frames(spark, sf_dir).select("track_id", "idx", *[windows.lag_lead("conf", k).alias(f"conf_{k}") for k in windows.LAGS]))


@Q.add("w7_backward_deltas", f"WITH {FRAMES} SELECT track_id, idx, " + ", ".join(f"round({x} - lag({x}, {k}, 0) OVER {TW}, 4) + 0.0 AS {x}_{k}" for k in (2, 4, 8) for x in ("flux", "hf")) + " FROM frames")
def w7(spark, sf_dir):
    return rounded(frames(spark, sf_dir).select("track_id", "idx", *[windows.backward_delta(x, k).alias(f"{x}_{k}") for k in (2, 4, 8) for x in ("flux", "hf")]))


W8 = f"""w8 AS (SELECT track_id, idx, list_transform(range(-8, 0), lambda d: xs[greatest(idx + d, 0) + 1]) AS b, list_transform(range(0, 8), lambda d: xs[least(idx + d, n - 1) + 1]) AS a
  FROM (SELECT track_id, idx, list(conf) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs, count(*) OVER (PARTITION BY track_id) AS n FROM frames))"""


@Q.add(
    "w8_before_after",
    f"""WITH {FRAMES}, {W8}, s AS (SELECT track_id, idx, list_aggregate(b, 'stddev_pop') AS sb, list_aggregate(a, 'stddev_pop') AS sa, list_aggregate(a, 'median') AS ma, list_aggregate(b, 'median') AS mb FROM w8)
    SELECT track_id, idx, round(sb, 4) AS std_before, round(sa, 4) AS std_after, round(ma - mb, 4) + 0.0 AS median_step, round(abs(ma - round_even(ma, 0)), 4) AS off_semitone FROM s""",
)
def w8(spark, sf_dir):
    return rounded(windows.before_after(frames(spark, sf_dir), "conf").select("track_id", "idx", "std_before", "std_after", "median_step", "off_semitone"))


@Q.add(
    "w9_local_peak",
    f"WITH {FRAMES}, m AS (SELECT *, max(flux) OVER {TW[:-1]} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top FROM frames) SELECT track_id, idx, round(flux - top, 4) + 0.0 AS below, flux >= top AS is_peak FROM m",
)
def w9(spark, sf_dir):
    top = windows.local_peak("flux")
    return rounded(frames(spark, sf_dir).select("track_id", "idx", (F.col("flux") - top).alias("below"), (F.col("flux") >= top).alias("is_peak")))


W10 = f"""b AS (SELECT *, {MIDI} AS midi, conf > 0.4 AND f0 > 0 AS voiced FROM frames), l AS (SELECT *, CASE WHEN voiced AND NOT coalesce(lag(voiced) OVER {TW}, false) THEN 1 ELSE 0 END AS new FROM b), r AS (SELECT *, sum(new) OVER {TW} AS run FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n, row_number() OVER (PARTITION BY track_id, run ORDER BY idx) AS i, list(midi) OVER (PARTITION BY track_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs FROM r WHERE voiced),
c AS (SELECT track_id, idx, list_sort(list_transform(range(-k, k + 1), lambda d: xs[least(greatest(i + d, 1), n)]))[k + 1] AS clean FROM (SELECT *, CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS k FROM n)),
s AS (SELECT b.*, coalesce(c.clean, b.midi) AS clean FROM b LEFT JOIN c ON c.track_id = b.track_id AND c.idx = b.idx),
h AS (SELECT *, coalesce(last_value(CASE WHEN voiced THEN clean END IGNORE NULLS) OVER {TW}, first_value(clean) OVER {TW}, CASE WHEN bool_or(voiced) OVER (PARTITION BY track_id) THEN quantile_cont(clean, 0.5) OVER (PARTITION BY track_id) END, 60) AS held,
  rms_db - quantile_cont(rms_db, 0.95) OVER (PARTITION BY track_id) AS level, CAST(CAST(voiced AS INTEGER) AS DOUBLE) AS voiced_f FROM s),
w AS (SELECT *, max(flux) OVER {TW[:-1]} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top, list(held) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hs, count(*) OVER (PARTITION BY track_id) AS len FROM h),
ab AS (SELECT *, list_transform(range(-8, 0), lambda d: hs[greatest(idx + d, 0) + 1]) AS before, list_transform(range(0, 8), lambda d: hs[least(idx + d, len - 1) + 1]) AS after FROM w),
f AS (SELECT track_id, idx, voiced_f, conf, level, flux, hf, """ + ", ".join(
    [f"lead(held, {k}, 0) OVER {TW} - lag(held, {k}, 0) OVER {TW} AS step_{k}, abs(lead(held, {k}, 0) OVER {TW} - lag(held, {k}, 0) OVER {TW}) AS abs_step_{k}, lead(level, {k}, 0) OVER {TW} - lag(level, {k}, 0) OVER {TW} AS level_step_{k}, lead(conf, {k}, 0) OVER {TW} - lag(conf, {k}, 0) OVER {TW} AS conf_step_{k}" for k in windows.LAGS]
    + [f"flux - lag(flux, {k}, 0) OVER {TW} AS flux_back_{k}, hf - lag(hf, {k}, 0) OVER {TW} AS hf_back_{k}, lag(voiced_f, {k}, 0) OVER {TW} AS voiced_back_{k}" for k in (2, 4, 8)]
) + """, list_aggregate(before, 'stddev_pop') AS std_before, list_aggregate(after, 'stddev_pop') AS std_after, list_aggregate(after, 'median') - list_aggregate(before, 'median') AS median_step,
  abs(list_aggregate(after, 'median') - round_even(list_aggregate(after, 'median'), 0)) AS off_semitone, flux - top AS flux_to_peak, CAST(CAST(flux >= top AS INTEGER) AS DOUBLE) AS flux_is_peak FROM ab)"""


@Q.add("w10_frame_features", f"WITH {FRAMES}, {W10} SELECT track_id, idx, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in windows.FEATURES) + " FROM f")
def w10(spark, sf_dir):
    return rounded(windows.frame_features(frames(spark, sf_dir)))


@Q.add(
    "w11_onset_peaks",
    f"""WITH {FRAMES}, s AS (SELECT *, (lag(hf, 1, 0) OVER {TW} + hf + lead(hf, 1, 0) OVER {TW}) / 3 AS s FROM frames), m AS (SELECT *, max(s) OVER {TW[:-1]} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM s)
    SELECT track_id, idx, round(s, 4) AS smooth FROM m WHERE s >= 0.25 AND s >= top AND f0 > 0""",
)
def w11(spark, sf_dir):
    t = windows.onset_peaks(frames(spark, sf_dir).withColumn("voiced", F.col("f0") > 0), "hf")
    return rounded(t.filter("peak").select("track_id", "idx", "smooth"))


@Q.add(
    "w15_moving_mean_gate",
    f"""WITH {FRAMES}, m AS (SELECT track_id, idx, conf, sum(conf) OVER {TW[:-1]} ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) / 20 AS m FROM frames)
    SELECT track_id, idx, round(1 / (1 + exp(-((conf - m) / (m + 1e-6) - 1.3) / 0.1)), 4) AS gate FROM m""",
)
def w15(spark, sf_dir):
    return rounded(windows.moving_mean_gate(frames(spark, sf_dir), "conf").select("track_id", "idx", "gate"))


@Q.add(
    "w17_mask_long_runs",
    f"""WITH {FRAMES}, m AS (SELECT track_id, idx, conf * CASE WHEN (idx // 20) % 3 = 0 THEN 0 ELSE 1 END AS mask FROM frames), c AS (SELECT *, CASE WHEN mask > 0.01 AND NOT coalesce(lag(mask) OVER {TW} > 0.01, false) THEN 1 ELSE 0 END AS new FROM m), d AS (SELECT *, sum(new) OVER {TW} AS run FROM c),
    r AS (SELECT track_id, min(idx) AS s, max(idx) + 1 AS e FROM d WHERE mask > 0.01 GROUP BY track_id, run HAVING max(idx) + 1 - min(idx) > 12), g AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY track_id ORDER BY s) < 4 THEN 0 ELSE 1 END AS new FROM r),
    j AS (SELECT track_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY s) AS k FROM g) GROUP BY track_id, k), n AS (SELECT track_id, max(idx) + 1 AS n FROM m GROUP BY 1),
    w AS (SELECT m.track_id, m.idx, m.mask, CASE WHEN s IS NULL THEN 0 ELSE least(CASE WHEN s = 0 THEN 1 ELSE least(1, (m.idx - s) / 4) END, CASE WHEN e = n THEN 1 ELSE least(1, (e - 1 - m.idx) / 4) END) END AS w FROM m JOIN n ON n.track_id = m.track_id LEFT JOIN j ON j.track_id = m.track_id AND m.idx >= s AND m.idx < e)
    SELECT track_id, idx, round(mask + w * (1 - mask), 4) + 0.0 AS mask, round(w, 4) + 0.0 AS weight FROM w""",
)
def w17(spark, sf_dir):
    t = frames(spark, sf_dir).select("track_id", "idx", (F.col("conf") * F.when(F.pmod(F.floor(F.col("idx") / 20), F.lit(3)) == 0, 0).otherwise(1)).alias("mask"))
    return rounded(windows.mask_long_runs(t, 0.01, 12, 4).select("track_id", "idx", "mask", "weight"))
