"""Faults that the reviewer of round 4 found."""

import random

import numpy as np
from pyspark.sql import functions as F

from tonewright.operators import decoding, evaluation, learning, notes as N, transcribe, windows
from tonewright.plans.source_queries import written
from test_learning import FRAMES, chanted


def test_thresholds_and_folds_share_their_frames(spark, tmp_path, monkeypatch):
    """what cross_validate() stores and shuffles doesn't grow with its thresholds, nor a model's rows with every fit."""
    rows, notes = map(lambda x: sum(x, []), zip(*(chanted(t, 40 + t) for t in range(6)), strict=True))
    frames = spark.createDataFrame(rows, FRAMES).repartition(4).persist()
    ref = spark.createDataFrame(notes, "track_id long, note_no long, start double, end double, pitch int").persist()
    labelled = evaluation.onset_labels(windows.frame_features(frames), ref).persist()
    made, trained, fit = [], [], learning.train_onset_model

    def store(t, name):
        out = written(spark, t)
        made.append((name, out.count()))
        return out

    def train(t, **how):
        trained.append(t._jdf.queryExecution().executedPlan().toString())
        return fit(t, **how)

    monkeypatch.setattr(learning, "train_onset_model", train)
    few = transcribe.cross_validate(labelled, frames, ref, k=2, inner=2, thresholds=(0.25,), store=store, trees=3, depth=2).collect()
    first, made[:] = sum(n for name, n in made), []
    many = transcribe.cross_validate(labelled, frames, ref, k=2, inner=2, thresholds=tuple(0.25 + k / 1000 for k in range(8)), store=store, trees=3, depth=2).collect()
    assert len(few) == len(many) == 6
    assert sum(n for name, n in made) < 1.5 * first
    assert max(n for name, n in made) <= frames.count()
    kept = [p.split("InMemoryRelation")[0] for p in trained]  # what lies above the kept table
    assert len(kept) == 2 * 2 * 3 and all("InMemory" in p for p in trained) and not any("Exchange" in p for p in kept)


def test_ways_are_the_spans_of_each_threshold(spark):
    """Every spot has the spans that segment_onsets() finds there, whichever it shares them with."""
    r, rows = np.random.default_rng(3), []
    for t in range(9):
        rows += [(t, i, float(a), float(b), bool(r.random() < 0.9)) for i, (a, b) in enumerate(r.random((40 * t + 1, 2)).round(1))]
    f = spark.createDataFrame(rows, "track_id long, idx int, p double, q double, voiced boolean").repartition(3).persist()
    lows = (0.2, 0.5, 0.95, 1.5)
    got = {}
    for x in N.segment_ways(f, ["p", "q"], lows, 3, 2).collect():
        spans = list(zip(x["s"], x["e"], strict=True))
        assert len(set(spans)) == len(spans) and sorted(s for w in x["ways"] for s in w["spots"]) == list(range(8))
        assert len({tuple(w["spans"]) for w in x["ways"]}) == len(x["ways"])
        got |= {(x["track_id"], spot): [spans[k] for k in w["spans"]] for w in x["ways"] for spot in w["spots"]}
    assert len(got) == 9 * 8
    for spot in range(8):
        want = {}
        for x in N.segment_onsets(f.withColumn("smooth", F.col("pq"[spot // 4])), lows[spot % 4], 3, 2).orderBy("track_id", "s").collect():
            want.setdefault(x["track_id"], []).append((x["s"], x["e"]))
        assert {t: got[t, spot] for t in range(9)} == {t: want.get(t, []) for t in range(9)}


def test_sets_of_notes_are_scored_as_each_alone(spark):
    """scored() of several sets gives each the scores that it has by itself, and a row to an empty one."""
    random.seed(5)
    note = lambda t, i: (t, i, 0.1 * i, 0.1 * i + random.choice([0.05, 0.15, 0.3]), random.randint(60, 62))
    ref = [note(t, i) for t in range(4) for i in range(30)] + [(7, 0, 1.0, 1.0, 60)]  # a track without an active frame
    est = [(t, way, s + random.choice([0, 0.02, 0.2]), e + random.choice([0, 0.02, 0.3]), p) for way in (0, 1) for t, i, s, e, p in ref if t != 3 and random.random() < 0.8]
    ref = spark.createDataFrame(ref, "track_id long, note_no long, start double, end double, pitch int").persist()
    est = spark.createDataFrame(est, "track_id long, way int, start double, end double, pitch int").persist()
    sets = spark.createDataFrame([(t, way) for t in (0, 1, 2, 3, 7, 9) for way in (0, 1, 2)], "track_id long, way int")
    got = {(x["track_id"], x["way"]): x[2:] for x in transcribe.scored(ref, est, sets=sets).collect()}
    assert set(got) == {(t, way) for t in (0, 1, 2, 3, 7) for way in (0, 1, 2)}
    for way in (0, 1, 2):
        e = est.filter(F.col("way") == way)
        own = e.withColumn("note_no", F.xxhash64("start", "end", "pitch"))
        old = evaluation.note_scores(evaluation.match_notes(ref, own), evaluation.match_notes(ref, own, offsets=True), ref, own)
        time = evaluation.time_accuracy(evaluation.rasterise(ref), evaluation.rasterise(e, "start"))
        want = {x["track_id"]: x[1:] for x in old.join(time, "track_id", "left").fillna({"on_pitch": 0.0, "wrong_pitch": 0.0, "missing": 1.0}).collect()}
        assert {t: got[t, way] for t in want} == want
        assert {x["track_id"]: x[1:] for x in transcribe.scored(ref, e).collect()} == want


def test_onsets_of_a_frame_are_one_label(spark):
    """many onsets near one frame become one row before they are dealt, and label what they did."""
    notes = spark.createDataFrame([(1, 0.02 * i, 0.0) for i in range(500)] + [(2, 3.0, 0.0)], "track_id long, start double, end double")
    frames = spark.createDataFrame([(t, i) for t in (1, 2, 3) for i in range(150)], "track_id long, idx int")
    got = {(r["track_id"], r["idx"]) for r in evaluation.onset_labels(frames, notes, 1, 10.0).filter("label = 1").collect()}
    want = {(t, round(0.2 * i) + d) for t in (1,) for i in range(500) for d in (-1, 0, 1)} | {(2, 29), (2, 30), (2, 31)}
    assert got == {(t, i) for t, i in want if 0 <= i < 150}


def test_peaks_and_spans_of_a_track():
    smooth, voiced = np.array([0.1, 0.9, 0.1, 0.1, 0.1, 0.8, 0.1, 0.1]), np.ones(8, bool)
    assert decoding.onset_spans(smooth, voiced, 0.5, 2) == [(1, 5), (5, 8)]
    assert decoding.spans_of(decoding.onset_peaks(smooth, voiced), voiced, 2) == decoding.onset_spans(smooth, voiced, 0.0, 2)
    assert decoding.onset_peaks(np.empty(0), np.empty(0, bool)).tolist() == []


def test_frames_of_notes_stay_where_they_are_made(spark, monkeypatch):
    """notes are dealt by blocks once, and no frame that they become is dealt again."""
    monkeypatch.setattr(evaluation, "TASK_NOTES", 5)
    ref = spark.range(20).selectExpr("id % 3 AS track_id", "id AS note_no", "id / 10.0D AS start", "id / 10.0D + 0.2D AS end", "60 AS pitch")
    plan = evaluation.active_frames(ref, ref.selectExpr("track_id", "0 AS way", "start", "end", "pitch"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_block#" in line for line in dealt) and not any("idx#" in line for line in dealt)


def test_second_annotator_and_decoding_are_scored_together(spark, monkeypatch):
    """the reference goes through the scoring of both once."""
    rows, notes = map(lambda x: sum(x, []), zip(*(chanted(t, 60 + t) for t in range(3)), strict=True))
    frames = spark.createDataFrame(rows, FRAMES).persist()
    ref = spark.createDataFrame(notes, "track_id long, note_no long, start double, end double, pitch int").persist()
    calls, score = [], transcribe.scored
    none = score(ref, ref.filter("track_id = 0")).persist()
    monkeypatch.setattr(transcribe, "scored", lambda *a, **how: calls.append(how) or score(*a, **how))
    monkeypatch.setattr(transcribe, "cross_validate", lambda *a, **how: none)
    out = {r["method"]: r for r in transcribe.compare_methods(frames, frames, ref, ref, store=lambda t, name: written(spark, t)).collect()}
    assert len(calls) == 1
    assert (out["second"]["f1"], out["second"]["on_pitch"], out["second"]["missing"]) == (1.0, 1.0, 0.0)
    assert out["decoding"]["tracks"] == 3 and 0 < out["decoding"]["f1"] < 1 and out["model"]["f1"] == 1 / 3
