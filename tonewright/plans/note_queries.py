"""Queries over notes: spans, measures, decoding, matching and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, notes as N, transcribe, voicing, windows
from .catalog import Catalog, rounded
from .source_queries import written
from .testbed import EST, FRAMES, NOTES, est_notes, frames, notes
from .track_queries import MIDI, VOICED

Q = Catalog()

SPANS = """spans AS (SELECT track_id, CAST(k AS INTEGER) AS span, CAST(k * 10 AS INTEGER) AS s, CAST(k * 10 + 9 AS INTEGER) AS e FROM (SELECT track_id, max(idx) + 1 AS n FROM frames GROUP BY track_id), range(0, 100) AS t(k) WHERE k * 10 + 9 <= n)"""


def _spans(f):
    n = f.groupBy("track_id").agg((F.max("idx") + 1).alias("n"))
    t = n.select("track_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 9) / 10).cast("int"))).alias("span"))
    return t.select("track_id", "span", (F.col("span") * 10).alias("s"), (F.col("span") * 10 + 9).alias("e"))


@Q.add(
    "a6_note_measure",
    f"""WITH {VOICED}, {SPANS}, ref AS (SELECT track_id, quantile_cont(rms_db, 0.95) AS ref FROM fv WHERE voiced GROUP BY track_id),
    m6 AS (SELECT s.track_id, s.span, quantile_cont(f.rms_db, 0.9) AS loud, avg(f.conf) AS conf FROM spans s JOIN fv f ON f.track_id = s.track_id AND f.idx >= s.s AND f.idx < s.e GROUP BY ALL)
    SELECT m.track_id, m.span, CAST(floor(40 + 75 * greatest(0, least(1, (loud - ref + 30) / 30))) AS INTEGER) AS velocity, round(conf, 2) AS confidence FROM m6 m JOIN ref ON ref.track_id = m.track_id""",
)
def a6(spark, sf_dir):
    f = voicing.soft_voicing(frames(spark, sf_dir))
    t = N.note_measure(_spans(f).withColumns({"pitch": F.lit(60), "est": F.lit(60.25)}), f)
    return t.select("track_id", "span", "velocity", F.round("confidence", 2).alias("confidence"))


CORE = f"""mid AS (SELECT s.track_id, s.span, CASE WHEN f.f0 > 0 THEN {MIDI} END AS midi, f.idx FROM spans s JOIN frames f ON f.track_id = s.track_id AND f.idx >= s.s + (s.e - s.s) // 5 AND f.idx < s.e - (s.e - s.s) // 5),
core AS (SELECT track_id, span, quantile_cont(midi, 0.5) AS est, count(midi) AS n FROM mid WHERE midi IS NOT NULL GROUP BY ALL HAVING count(midi) >= 3)"""


@Q.add("a7_core_pitch", f"WITH {FRAMES}, {SPANS}, {CORE} SELECT track_id, span, round(est, 4) AS est, n, CAST(round_even(est, 0) AS INTEGER) AS pitch FROM core")
def a7(spark, sf_dir):
    f = voicing.soft_voicing(frames(spark, sf_dir))
    return rounded(N.core_pitch(_spans(f), f))


@Q.add(
    "a8_held_note",
    f"""WITH {FRAMES}, {SPANS}, {CORE}, c AS (SELECT track_id, span, CAST(round_even(midi / 2, 0) AS INTEGER) + 20 AS note, count(*) AS n FROM mid WHERE midi IS NOT NULL GROUP BY ALL),
    h AS (SELECT track_id, span, note AS pitch FROM (SELECT *, row_number() OVER (PARTITION BY track_id, span ORDER BY n DESC, note) AS k FROM c) WHERE k = 1)
    SELECT h.track_id, h.span, h.pitch, round(est - 12 * round_even((est - h.pitch) / 12, 0), 4) AS est FROM core JOIN h ON h.track_id = core.track_id AND h.span = core.span""",
)
def a8(spark, sf_dir):
    f = voicing.soft_voicing(frames(spark, sf_dir))
    spans = _spans(f)
    path = f.select("track_id", "idx", F.coalesce(F.rint(F.col("midi") / 2).cast("int") + 20, F.lit(-1)).alias("note"))
    return rounded(N.held_note(spans, path, N.core_pitch(spans, f)).select("track_id", "span", "pitch", "est"))


NW = '(PARTITION BY track_id ORDER BY "start", "end")'


@Q.add("w12_legato", f'WITH {NOTES}, n AS (SELECT *, lead("start") OVER {NW} AS nx FROM notes) SELECT track_id, note_no, round(CASE WHEN nx - "end" > 0 AND nx - "end" <= 0.05 THEN nx ELSE "end" END, 4) AS "end" FROM n')
def w12(spark, sf_dir):
    return rounded(N.legato(notes(spark, sf_dir), 0.05).select("track_id", "note_no", "end"))


@Q.add(
    "w13_merge_touching",
    f"""WITH {NOTES}, p AS (SELECT *, pitch // 5 AS p FROM notes), n AS (SELECT *, coalesce(NOT (p = lag(p) OVER {NW} AND "start" - lag("end") OVER {NW} < 0.05), true) AS new FROM p), g AS (SELECT *, sum(CAST(new AS INTEGER)) OVER {NW} AS g FROM n)
    SELECT track_id, min(note_no) AS note_no, round(min("start"), 4) AS "start", round(arg_max("end", ("start", "end")), 4) AS "end", CAST(any_value(p) AS INTEGER) AS pitch, max(note_no) AS velocity FROM g GROUP BY track_id, g""",
)
def w13(spark, sf_dir):
    t = notes(spark, sf_dir).select("track_id", "note_no", "start", "end", F.floor(F.col("pitch") / 5).cast("int").alias("pitch"), F.col("note_no").alias("velocity"))
    return rounded(N.merge_touching(t, 10))


@Q.add("v7_drop_blips", f"""WITH {NOTES} SELECT track_id, note_no FROM notes WHERE NOT (track_id % 2 = 0 AND "end" - "start" < 0.12 AND (pitch % 10) / 10.0 < 0.65)""")
def v7(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("confidence", (F.col("pitch") % 10) / 10)
    tracks = n.select("track_id").distinct().withColumn("autotuned", F.col("track_id") % 2 == 0)
    return N.drop_blips(n, tracks).select("track_id", "note_no")


SUNG = FRAMES + f""", sung AS (SELECT * REPLACE (CASE WHEN f0 > 0 THEN 220 * pow(2, (((idx // 12 + track_id) % 7) * 2 + sin(idx) / 5) / 12) ELSE 0 END AS f0) FROM frames),
m AS (SELECT *, {MIDI} AS midi, quantile_cont(rms_db, 0.99) OVER (PARTITION BY track_id) AS ref FROM sung),
v AS (SELECT *, CASE WHEN rms_db > ref - 45 AND coalesce(midi >= 35.5 AND midi <= 96.5, false) THEN 1 / (1 + exp(-(conf - 0.4) / 0.08)) ELSE 0 END AS voice_p FROM m),
fv AS (SELECT *, voice_p > 0.5 AS voiced FROM v)"""
TW = "(PARTITION BY track_id ORDER BY idx)"


def _voiced(spark, sf_dir):
    """Frames with smoother pitches than the table's random ones, so that decoding has something to hold."""
    f = frames(spark, sf_dir).withColumn("f0", F.when(F.col("f0") > 0, 220 * F.pow(F.lit(2.0), (F.pmod(F.floor(F.col("idx") / 12) + F.col("track_id"), F.lit(7)) * 2 + F.sin("idx") / 5) / 12)).otherwise(F.lit(0.0)))
    return voicing.soft_voicing(f)


def _path(spark, sf_dir):
    f = _voiced(spark, sf_dir)
    keys = voicing.detect_key(voicing.pitch_class_histogram(f.filter("voiced")))
    return f, N.decode_notes(f, voicing.hmm_inputs(f), keys)


@Q.add("v1_decode_notes")
def v1(spark, sf_dir):
    return _path(spark, sf_dir)[1]


@Q.add(
    "v3_segment_onsets",
    f"""WITH RECURSIVE {FRAMES}, q AS (SELECT *, f0 > 0 AS on_, (lag(hf, 1, 0) OVER {TW} + hf + lead(hf, 1, 0) OVER {TW}) / 3 AS s FROM frames), t AS (SELECT *, max(s) OVER {TW[:-1]} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM q),
    pk AS (SELECT track_id, idx FROM t WHERE s >= 0.25 AND s >= top AND on_), c AS (SELECT *, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER {TW} THEN 1 ELSE 0 END AS new FROM q), d AS (SELECT *, sum(new) OVER {TW} AS run FROM c),
    runs AS (SELECT track_id, on_, min(idx) AS s, max(idx) + 1 AS e FROM d GROUP BY track_id, on_, run), st AS (SELECT track_id, s AS idx FROM runs WHERE on_ AND e - s >= 4 AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.track_id = runs.track_id AND abs(pk.idx - runs.s) <= 4)),
    os AS (SELECT track_id, list(idx ORDER BY idx) AS xs FROM (FROM pk UNION FROM st) GROUP BY track_id), k AS (SELECT track_id, xs[1] AS c FROM os UNION ALL SELECT track_id, nx FROM (SELECT k.track_id, list_filter(xs, lambda x: x >= k.c + 6)[1] AS nx FROM k JOIN os ON os.track_id = k.track_id) WHERE nx IS NOT NULL),
    b AS (SELECT k.track_id, c AS a, coalesce(lead(c) OVER (PARTITION BY k.track_id ORDER BY c), n) AS b FROM k JOIN (SELECT track_id, max(idx) + 1 AS n FROM frames GROUP BY 1) l ON l.track_id = k.track_id),
    e AS (SELECT b.track_id, a, least(b, coalesce(min(CASE WHEN r.s IS NOT NULL AND least(r.e, b) - greatest(r.s, a) > 6 THEN greatest(r.s, a) END), b)) AS e FROM b LEFT JOIN runs r ON r.track_id = b.track_id AND NOT r.on_ AND r.s < b AND r.e > a GROUP BY b.track_id, a, b)
    SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY a) - 1 AS INTEGER) AS span, a AS s, e FROM e WHERE e - a >= 6""",
)
def v3(spark, sf_dir):
    f = windows.onset_peaks(_voiced(spark, sf_dir).withColumn("voiced", F.col("f0") > 0), "hf")
    return N.segment_onsets(f)


@Q.add("v4_fold_slides")
def v4(spark, sf_dir):
    n = notes(spark, sf_dir).select("track_id", "note_no", (F.col("start") / 5).alias("start"), (F.col("end") / 5).alias("end"), "pitch")
    return rounded(N.fold_slides(n, voicing.soft_voicing(frames(spark, sf_dir))))


@Q.add(
    "v5_notes_from_path",
    f"""WITH {SUNG}, p AS (SELECT *, CASE WHEN voiced THEN CAST(round_even(midi, 0) AS INTEGER) ELSE -1 END AS note FROM fv), c AS (SELECT *, CASE WHEN note IS DISTINCT FROM lag(note) OVER {TW} THEN 1 ELSE 0 END AS new FROM p), d AS (SELECT *, sum(new) OVER {TW} AS run FROM c),
    r AS (SELECT track_id, run, note, min(idx) AS s, max(idx) + 1 AS e FROM d WHERE note >= 0 GROUP BY ALL HAVING max(idx) + 1 - min(idx) >= 3), mean AS (SELECT r.track_id, r.run, avg(fv.midi) AS m FROM r JOIN fv ON fv.track_id = r.track_id AND fv.idx >= r.s + (r.e - r.s) // 5 AND fv.idx < r.e - (r.e - r.s) // 5 GROUP BY ALL),
    tuned AS (SELECT track_id, avg(CAST(abs(midi - round_even(midi, 0)) < 0.1 AS DOUBLE)) >= 0.55 AS tuned FROM fv WHERE voiced GROUP BY track_id), x AS (SELECT r.*, m - 12 * round_even((m - note) / 12, 0) AS est, tuned FROM r JOIN mean ON mean.track_id = r.track_id AND mean.run = r.run LEFT JOIN tuned ON tuned.track_id = r.track_id)
    SELECT track_id, s, e, note, CASE WHEN tuned OR abs(est - note) < 0.75 THEN note ELSE CAST(round_even(est, 0) AS INTEGER) END AS pitch, round(est, 4) AS est FROM x""",
)
def v5(spark, sf_dir):
    f = _voiced(spark, sf_dir)
    path = f.select("track_id", "idx", F.when(F.col("voiced"), F.rint("midi").cast("int")).otherwise(-1).alias("note"))
    out = N.notes_from_path(N.path_spans(path, 3), f, voicing.on_note_ratio(f), least=3)
    return rounded(out.select("track_id", "s", "e", "note", "pitch", "est"))


@Q.add("v6_split_on_dips")
def v6(spark, sf_dir):
    f, path = _path(spark, sf_dir)
    return N.split_on_dips(N.path_spans(path, 3), f, 10.0, 4)


@Q.add(
    "v8_group_running_mean",
    f"""WITH RECURSIVE {SUNG}, q AS (SELECT track_id, midi, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS i FROM fv WHERE midi IS NOT NULL),
    w AS (SELECT track_id, i, CAST(0 AS BIGINT) AS a, midi AS total FROM q WHERE i = 0 UNION ALL
      SELECT track_id, i, CASE WHEN off THEN i ELSE a END, CASE WHEN off THEN midi ELSE total + midi END FROM (SELECT q.track_id, q.i, q.midi, w.a, w.total, abs(q.midi - w.total / (q.i - w.a)) > 0.6 AS off FROM w JOIN q ON q.track_id = w.track_id AND q.i = w.i + 1))
    SELECT w.track_id, CAST(w.a AS INTEGER) AS s, CAST(n.a AS INTEGER) AS e, round(w.total / (n.a - w.a), 4) AS mean FROM w JOIN w n ON n.track_id = w.track_id AND n.i = w.i + 1 AND n.a = n.i WHERE (n.a - w.a) / 50.0 > 0.12""",
)
def v8(spark, sf_dir):
    return rounded(N.group_running_mean(_voiced(spark, sf_dir), fps=50.0))


@Q.add(
    "j7_onset_labels",
    f"""WITH {FRAMES}, {NOTES}, a AS (SELECT DISTINCT track_id, CAST(round_even("start" * 10, 0) AS INTEGER) AS a FROM notes)
    SELECT f.track_id, f.idx, CAST(EXISTS (SELECT 1 FROM a WHERE a.track_id = f.track_id AND abs(a.a - f.idx) <= 1) AS INTEGER) AS label FROM frames f""",
)
def j7(spark, sf_dir):
    return evaluation.onset_labels(frames(spark, sf_dir), notes(spark, sf_dir), 1, 10.0).select("track_id", "idx", "label")


def _raster_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT n.track_id, CAST(i AS INTEGER) AS idx, arg_max(pitch, note_no) AS pitch FROM {source} n, range(0, 4000) AS t(i) WHERE i >= ceil(round("start" * 20, 6)) AND i < ceil(round("end" * 20, 6)) GROUP BY ALL)"""


@Q.add("j8_rasterise", f"WITH {NOTES}, {_raster_sql('r', 'notes')} SELECT * FROM r")
def j8(spark, sf_dir):
    return evaluation.rasterise(notes(spark, sf_dir), fps=20.0)


#: Notes are 0.25 s apart here, so an estimate can only be of the note next to it, and a note is met if any estimate is near.
CAND = """cand AS (SELECT r.track_id, r.note_no AS ref_no, e.note_no AS est_no, round(abs(r."end" - e."end"), 6) <= greatest(0.2 * (r."end" - r."start"), 0.05) AS fl FROM notes r JOIN est e ON e.track_id = r.track_id AND CAST(round(e."start" / 0.25) AS BIGINT) = r.note_no
  AND abs(r.pitch - e.pitch) * 100 <= 50 AND round(abs(r."start" - e."start"), 6) <= 0.05)"""


@Q.add(
    "j9_match_notes",
    f"""WITH RECURSIVE {NOTES}, {EST}, g AS (SELECT r.track_id, r.pitch, r.xs AS rs, e.xs AS es FROM (SELECT track_id, pitch, list("start" / 5 ORDER BY "start") AS xs FROM notes GROUP BY ALL) r JOIN (SELECT track_id, pitch, list("start" / 5 ORDER BY "start") AS xs FROM est GROUP BY ALL) e ON e.track_id = r.track_id AND e.pitch = r.pitch),
    m AS (SELECT track_id, pitch, 1 AS i, 1 AS j, 0 AS n FROM g UNION ALL
      SELECT track_id, pitch, i + CAST(abs(d) <= 0.05 OR d > 0 AS INTEGER), j + CAST(abs(d) <= 0.05 OR d < 0 AS INTEGER), n + CAST(abs(d) <= 0.05 AS INTEGER)
      FROM (SELECT m.*, round(g.es[j] - g.rs[i], 6) AS d FROM m JOIN g ON g.track_id = m.track_id AND g.pitch = m.pitch WHERE i <= len(g.rs) AND j <= len(g.es)))
    SELECT track_id, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS refs, CAST(sum(n) AS BIGINT) AS ests FROM (SELECT track_id, pitch, max(n) AS n FROM m GROUP BY ALL) GROUP BY track_id HAVING sum(n) > 0""",
)
def j9(spark, sf_dir):
    """Notes five times as dense, so that notes and estimates compete for each other: the size of a matching, and its notes."""
    fast = lambda t: t.withColumns({c: F.col(c) / 5 for c in ("start", "end")})
    m = evaluation.match_notes(fast(notes(spark, sf_dir)), fast(est_notes(spark, sf_dir)))
    return m.groupBy("track_id").agg(F.count("*").alias("pairs"), F.count_distinct("ref_no").alias("refs"), F.count_distinct("est_no").alias("ests"))


@Q.add(
    "j10_note_at",
    f"""WITH {FRAMES}, {NOTES} SELECT f.track_id, f.idx, CASE WHEN n."end" > f.idx / 10.0::DOUBLE THEN n.pitch END AS pitch FROM frames f ASOF LEFT JOIN notes n ON n.track_id = f.track_id AND f.idx / 10.0::DOUBLE >= n."start" """,
)
def j10(spark, sf_dir):
    return evaluation.note_at(frames(spark, sf_dir).select("track_id", "idx"), notes(spark, sf_dir), 10.0)


MEL = f"""a AS (SELECT track_id, idx, {MIDI} AS r, CASE WHEN conf > 0.3 THEN ({MIDI}) + (idx % 5 - 2) * 0.3::DOUBLE + 12 * (idx % 2) END AS e FROM frames), d AS (SELECT *, (r - e) * 100 AS d FROM a), g AS (SELECT *, d - 1200 * floor(d / 1200 + 0.5) AS g FROM d),
mm AS (SELECT track_id, count(*) FILTER (abs(d) <= 50) AS p, count(*) FILTER (abs(g) <= 50) AS c, count(r) AS rv, count(*) FILTER (r IS NULL AND e IS NULL) AS nn, count(*) AS n, count(*) FILTER (r IS NOT NULL AND e IS NOT NULL) AS b, count(*) FILTER (r IS NULL AND e IS NOT NULL) AS fa FROM g GROUP BY track_id),
mel AS (SELECT track_id, CASE WHEN rv > 0 THEN p / rv ELSE 0 END AS rpa, CASE WHEN rv > 0 THEN c / rv ELSE 0 END AS rca, (p + nn) / n AS oa, CASE WHEN rv > 0 THEN b / rv ELSE 0 END AS vr, CASE WHEN n > rv THEN fa / (n - rv) ELSE 0 END AS vfa FROM mm)"""
MEL_NAMES = ("rpa", "rca", "oa", "vr", "vfa")


def _melody(spark, sf_dir):
    f = voicing.soft_voicing(frames(spark, sf_dir))
    e = F.when(F.col("conf") > 0.3, F.col("midi") + (F.col("idx") % 5 - 2) * 0.3 + 12 * (F.col("idx") % 2))
    return evaluation.melody_metrics(f, f.select("track_id", "idx", e.alias("midi")))


@Q.add("a9_melody_metrics", f"WITH {FRAMES}, {MEL} SELECT track_id, " + ", ".join(f"round({n}, 4) AS {n}" for n in MEL_NAMES) + " FROM mel")
def a9(spark, sf_dir):
    return rounded(_melody(spark, sf_dir))


@Q.add("a9_melody_mean", f"WITH {FRAMES}, {MEL} SELECT " + ", ".join(f"round(avg({n}), 4) AS {n}" for n in MEL_NAMES) + " FROM mel")
def a9_mean(spark, sf_dir):
    return rounded(evaluation.macro_mean(_melody(spark, sf_dir), *MEL_NAMES))


SCORES = f"""sc AS (SELECT r.track_id, r.n AS n_ref, coalesce(e.n, 0) AS n_est, coalesce(c.h, 0) AS h, coalesce(c.f, 0) AS f FROM (SELECT track_id, count(*) AS n FROM notes GROUP BY 1) r LEFT JOIN (SELECT track_id, count(*) AS n FROM est GROUP BY 1) e USING (track_id)
LEFT JOIN (SELECT track_id, count(DISTINCT ref_no) AS h, count(DISTINCT ref_no) FILTER (fl) AS f FROM cand GROUP BY 1) c USING (track_id)),
scores AS (SELECT track_id, CASE WHEN n_est > 0 THEN h / n_est ELSE 0 END AS precision, h / n_ref AS recall, 2 * h / (n_ref + n_est) AS f1, 2 * f / (n_ref + n_est) AS f1_offsets FROM sc)"""
SCORE_NAMES = ("precision", "recall", "f1", "f1_offsets")


def _scores(spark, sf_dir):
    r, e = notes(spark, sf_dir), est_notes(spark, sf_dir)
    return evaluation.note_scores(evaluation.match_notes(r, e), evaluation.match_notes(r, e, offsets=True), r, e)


@Q.add("a10_note_scores", f"WITH {NOTES}, {EST}, {CAND}, {SCORES} SELECT track_id, " + ", ".join(f"round({n}, 4) AS {n}" for n in SCORE_NAMES) + " FROM scores")
def a10(spark, sf_dir):
    return rounded(_scores(spark, sf_dir))


TIME = f"""{_raster_sql('rr', 'notes')}, {_raster_sql('er', 'est')}, ta AS (SELECT rr.track_id, avg(CAST(coalesce(abs(rr.pitch - er.pitch) <= 0.5, false) AS INTEGER)) AS on_pitch, avg(CAST(coalesce(abs(rr.pitch - er.pitch) > 0.5, false) AS INTEGER)) AS wrong_pitch,
avg(CAST(er.pitch IS NULL AS INTEGER)) AS missing FROM rr LEFT JOIN er ON er.track_id = rr.track_id AND er.idx = rr.idx GROUP BY rr.track_id)"""


def _times(spark, sf_dir):
    n = notes(spark, sf_dir)
    tasks = evaluation.tasks_for(n)
    return evaluation.time_accuracy(evaluation.rasterise(n, fps=20.0, tasks=tasks), evaluation.rasterise(est_notes(spark, sf_dir).filter("start >= 0"), fps=20.0, tasks=tasks))


@Q.add("a11_time_accuracy", f"WITH {NOTES}, {EST}, {TIME} SELECT track_id, round(on_pitch, 4) AS on_pitch, round(wrong_pitch, 4) AS wrong_pitch, round(missing, 4) AS missing FROM ta")
def a11(spark, sf_dir):
    return rounded(_times(spark, sf_dir))


@Q.add(
    "a12_macro_mean",
    f"WITH {NOTES}, {EST}, {CAND}, {SCORES}, {TIME} SELECT round(avg(f1), 4) AS f1, round(avg(on_pitch), 4) AS on_pitch, round(avg(wrong_pitch), 4) AS wrong_pitch, round(avg(f1) + avg(on_pitch) - avg(wrong_pitch), 4) AS objective FROM scores JOIN ta USING (track_id)",
)
def a12(spark, sf_dir):
    t = evaluation.macro_mean(_scores(spark, sf_dir).join(_times(spark, sf_dir), "track_id"), "f1", "on_pitch", "wrong_pitch")
    return rounded(t.withColumn("objective", evaluation.objective()))


@Q.add(
    "a13_choose_threshold",
    f"""WITH {NOTES}, g AS (SELECT track_id % 5 AS fold, (note_no % 5) * 0.05::DOUBLE AS threshold, round_even(avg(pitch % 7) / 10, 2) AS o FROM notes GROUP BY ALL),
    b AS (SELECT fold, threshold, row_number() OVER (PARTITION BY fold ORDER BY o DESC, threshold DESC) AS k FROM g) SELECT round(quantile_cont(threshold, 0.5), 4) AS threshold FROM b WHERE k = 1""",
)
def a13(spark, sf_dir):
    n = notes(spark, sf_dir)
    grid = n.groupBy((F.col("track_id") % 5).alias("fold"), ((F.col("note_no") % 5) * 0.05).alias("threshold")).agg((F.avg(F.col("pitch") % 7) / 10).alias("objective"))
    return rounded(evaluation.choose_threshold(grid))


@Q.add(
    "l4_folds",
    f"""WITH {NOTES}, p AS (SELECT track_id, row_number() OVER (ORDER BY track_id) - 1 AS p FROM (SELECT DISTINCT track_id FROM notes)), x AS (SELECT track_id, p, p % 5 AS fold, o AS outer FROM p, range(0, 5) AS t(o) WHERE p % 5 <> o)
    SELECT track_id, CAST(fold AS INTEGER) AS fold, CAST("outer" AS INTEGER) AS "outer", CAST((row_number() OVER (PARTITION BY "outer" ORDER BY p) - 1) % 4 AS INTEGER) AS "inner" FROM x""".replace("o AS outer", 'o AS "outer"'),
)
def l4(spark, sf_dir):
    return evaluation.folds(notes(spark, sf_dir))


def _sung(spark, sf_dir):
    return _voiced(spark, sf_dir).drop("midi", "voice_p", "voiced").withColumn("prob", F.col("hf"))


@Q.add("q_song_to_notes")
def song_to_notes(spark, sf_dir):
    return transcribe.song_to_notes(_sung(spark, sf_dir), store=lambda t, name: written(spark, t)).select("track_id", "start", "end", "pitch", "name", "hz", "cents", "velocity", "confidence")


@Q.add("q_song_to_notes_hmm")
def song_to_notes_hmm(spark, sf_dir):
    return transcribe.song_to_notes(_sung(spark, sf_dir), method="hmm", store=lambda t, name: written(spark, t)).select("track_id", "start", "end", "pitch", "name", "hz", "cents", "velocity", "confidence")
