"""The onset model, its cross-validation, and tracks whose notes are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import evaluation, learning, transcribe, voicing, windows
from tonewright.plans import registry
from tonewright.plans.signal_queries import _labelled
from tonewright.plans.source_queries import written

KEPT = {"store": lambda t, name: written(t.sparkSession, t)}
FRAMES = "track_id long, idx int, f0 double, conf double, rms_db double, flux double, hf double, prob double"


def sung(track, seed, tuned=0.0):
    """Frames of held notes with vibrato and scoops, 60 to 300 ms apart, and the notes."""
    r, rows, notes, at = np.random.default_rng(seed), [], [], 5
    pitch = 60
    while len(notes) < 12:
        n, gap = int(r.integers(25, 60)), int(r.integers(8, 30))
        pitch = int(np.clip(pitch + r.choice([-4, -2, 2, 3, 5]), 50, 72))
        notes.append((track, len(notes), at / 100, (at + n) / 100, pitch))
        at += n + gap
    length = at + 10
    note_of = {k: (p, k - round(a * 100)) for _, _, a, z, p in notes for k in range(round(a * 100), round(z * 100))}
    for k in range(length):
        p, i = note_of.get(k, (None, 0))
        m = None if p is None else p + tuned + (0.3 * np.sin(2 * np.pi * 5.5 * k / 100) if not tuned else 0.0) - (0.8 * max(0, 4 - i) / 4)
        on = p is not None and i < 2
        rows.append((track, k, 0.0 if m is None else float(440 * 2 ** ((m - 69) / 12)), 0.9 if p else 0.05, -20.0 if p else -60.0, 1.0 if on else 0.1, 0.8 if on else 0.2, 0.95 if on else 0.02))
    return rows, notes


@pytest.fixture(scope="module")
def choir(spark):
    rows, notes = [], []
    for t in range(6):
        a, b = sung(t, t)
        rows += a
        notes += b
    silent = [(90, k, 0.0, 0.1, -50.0, 0.0, 0.0, 0.0) for k in range(40)]
    f = spark.createDataFrame(rows + silent, FRAMES).repartition(4).persist()
    return f, spark.createDataFrame(notes, "track_id long, note_no long, start double, end double, pitch int").persist()


@pytest.mark.parametrize("method", ["hybrid", "hmm"])
def test_known_notes_are_found(choir, method):
    frames, ref = choir
    found = transcribe.song_to_notes(frames, method=method, **KEPT).persist()
    s = transcribe.scored(ref, found).agg(F.min("f1").alias("f1"), F.min("on_pitch").alias("on")).first()
    assert s["f1"] > 0.85 and s["on"] > 0.85
    assert found.filter("track_id = 90").count() == 0  # no voiced frame, no notes
    assert found.filter("duration <= 0 or velocity not between 1 and 127 or abs(cents) > 100").count() == 0


def test_tuning_of_corrected_tracks_is_taken_out(spark):
    frames = spark.createDataFrame(sung(1, 7, tuned=0.3)[0], FRAMES)
    assert transcribe.curves(frames)[1].first()["tuning"] == 0.0  # natural singing counts as in tune
    on = voicing.Settings(autotune="on")
    flat = frames.withColumn("f0", F.when(F.col("f0") > 0, 440 * F.pow(F.lit(2.0), (F.rint(12 * F.log2(F.col("f0") / 440) + 69 - 0.3) + 0.3 - 69) / 12)).otherwise(0.0))
    curve, facts = transcribe.curves(flat, on)
    f = facts.first()
    assert f["autotuned"] and f["tuning"] == pytest.approx(0.3, abs=0.01)
    assert curve.filter("voiced and abs(midi - rint(midi)) > 0.05").count() == 0
    hz = {r["hz"] for r in transcribe.song_to_notes(flat, on, **KEPT).collect()}
    assert hz and all(abs((69 + 12 * np.log2(h / 440)) % 1 - 0.3) < 0.05 for h in hz)  # the sung pitch, tuning and all


def test_cross_validation_never_sees_its_own_tracks(choir, monkeypatch):
    frames, ref = choir
    seen, fit, score = [], learning.train_onset_model, learning.score_onsets

    def train(t, **how):
        model = fit(t, **how)
        seen.append((model, {r["track_id"] for r in t.select("track_id").distinct().collect()}))
        return model

    def scores(model, t):
        own = next(ids for m, ids in seen if m is model)
        assert not own & {r["track_id"] for r in t.select("track_id").distinct().collect()}
        return score(model, t)

    monkeypatch.setattr(learning, "train_onset_model", train)
    monkeypatch.setattr(learning, "score_onsets", scores)
    labelled = evaluation.onset_labels(windows.frame_features(frames.filter("track_id < 90")), ref)
    out = transcribe.cross_validate(labelled, frames, ref, k=2, inner=2, thresholds=(0.2, 0.4), **KEPT, trees=3, depth=3).collect()
    assert len(seen) == 2 * 3 and sorted(r["track_id"] for r in out) == list(range(6))
    assert {(r["fold"], r["threshold"]) for r in out} <= {(f, t) for f in (0, 1) for t in (0.2, 0.4)} and len({(r["fold"], r["threshold"]) for r in out}) == 2
    assert np.mean([r["f1"] for r in out]) > 0.8


def test_queries_take_the_default_model(spark, sf_dir, monkeypatch):
    models, fit = [], learning.train_onset_model
    monkeypatch.setattr(learning, "train_onset_model", lambda *a, **how: models.append(fit(*a, **how)) or models[-1])
    assert registry.QUERIES["m2_score_onsets"](spark, sf_dir).count() > 0
    shares = {r["feature"]: r["importance"] for r in registry.QUERIES["m1_train_onset_model"](spark, sf_dir).collect()}
    assert [(m.getOrDefault("maxIter"), m.getOrDefault("maxDepth"), m.getNumTrees) for m in models] == [(20, 4, 20)] * 2
    assert set(shares) == set(windows.FEATURES) and sum(shares.values()) == pytest.approx(1, abs=1e-2)
    asked = []
    monkeypatch.setattr(transcribe, "cross_validate", lambda *a, **how: asked.append(how) or _labelled(spark, sf_dir).limit(1))
    registry.QUERIES["m3_cross_validate"](spark, sf_dir)
    assert [set(how) for how in asked] == [{"store"}]  # folds, thresholds and model are the operator's own


def test_scores_are_those_of_the_model_by_hand(spark, sf_dir):
    """A probability worked out again from the trees: the logistic of twice the weighted sum."""
    t = _labelled(spark, sf_dir).persist()
    model = learning.train_onset_model(t, trees=3, depth=2)
    rows = learning.assembled(t).select("track_id", "idx", "features").limit(200).collect()
    got = {(r["track_id"], r["idx"]): r["prob"] for r in learning.score_onsets(model, t).collect()}
    for r in rows:
        margin = sum(w * tree.predict(r["features"]) for w, tree in zip(model.treeWeights, model.trees, strict=True))
        assert got[r["track_id"], r["idx"]] == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-9)


def chanted(track, seed):
    """Frames of notes without a rest between them, many on one pitch: only the onset's flux tells these apart."""
    r, rows, notes, at, pitch = np.random.default_rng(seed), [], [], 5, 60
    while len(notes) < 12:
        n = int(r.integers(25, 50))
        pitch = pitch if r.random() < 0.6 else int(np.clip(pitch + r.choice([-4, -2, 2, 3]), 50, 72))
        notes.append((track, len(notes), at / 100, (at + n) / 100, pitch))
        at += n
    starts = {round(a * 100) for _, _, a, _, _ in notes}
    note_of = {k: p for _, _, a, z, p in notes for k in range(round(a * 100), round(z * 100))}
    for k in range(at + 10):
        p, on = note_of.get(k), bool({k, k - 1} & starts)
        flux = (1.0 if on else 0.1) + 0.05 * r.random()
        rows.append((track, k, 440 * 2 ** ((p + 0.1 * r.standard_normal() - 69) / 12) if p else 0.0, 0.9 if p else 0.05, (-20.0 if p else -60.0) + r.random(), flux, 0.2 + 0.6 * on, 0.0))
    return rows, notes


def by_hand(ref, est):
    """Means over tracks of precision, recall and F1 where no note can match two."""
    out = []
    for t in sorted({n[0] for n in ref}):
        a, b = ([n for n in notes if n[0] == t] for notes in (ref, est))
        hits = sum(any(abs(x[2] - y[2]) <= 0.05 + 1e-6 and abs(x[4] - y[4]) <= 0.5 for y in b) for x in a)
        out.append((hits / len(b) if b else 0.0, hits / len(a), 2 * hits / (len(a) + len(b))))
    return np.mean(out, axis=0)


def test_model_tells_more_than_a_constant_and_than_decoding_alone(spark):
    rows, notes = map(lambda x: sum(x, []), zip(*(chanted(t, 20 + t) for t in range(8)), strict=True))
    frames = spark.createDataFrame(rows, FRAMES).repartition(4).persist()
    ref = spark.createDataFrame(notes, "track_id long, note_no long, start double, end double, pitch int").persist()
    labelled = evaluation.onset_labels(windows.frame_features(frames), ref).persist()
    model = learning.train_onset_model(labelled.filter("track_id < 6"), trees=10, depth=3)
    got = np.array(learning.score_onsets(model, labelled.filter("track_id >= 6")).join(labelled, ["track_id", "idx"]).select("label", "prob").collect(), "float64")
    y, p = got[:, 0], np.clip(got[:, 1], 1e-6, 1 - 1e-6)
    share = float(labelled.filter("track_id < 6").agg(F.avg("label")).first()[0])
    loss = lambda q: -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    assert loss(p) < 0.5 * loss(share)
    assert p[y == 1].mean() > 0.5 > 0.1 > p[y == 0].mean()

    moved = [(t, i, a + 0.02, z + 0.02, pitch) for t, i, a, z, pitch in notes if i % 4]  # a second annotator, late, without each fourth note
    second = spark.createDataFrame(moved, ref.schema)
    out = {r["method"]: r for r in transcribe.compare_methods(labelled, frames, ref, second, k=2, inner=2, thresholds=(0.25, 0.4), **KEPT, trees=5, depth=3).collect()}
    assert set(out) == {"second", "decoding", "model"} and all(r["tracks"] == 8 for r in out.values())
    assert [out["second"][c] for c in ("precision", "recall", "f1")] == pytest.approx(by_hand(notes, moved))
    alone = transcribe.song_to_notes(frames, method="hmm", **KEPT).select("track_id", "start", "end", "pitch").collect()
    want = by_hand(notes, [(r["track_id"], 0, r["start"], r["end"], r["pitch"]) for r in alone])
    assert [out["decoding"][c] for c in ("precision", "recall", "f1")] == pytest.approx(want)
    assert out["model"]["f1"] > out["decoding"]["f1"] + 0.2 and out["model"]["objective"] > out["decoding"]["objective"]
    assert all(r["objective"] == pytest.approx(r["f1"] + r["on_pitch"] - r["wrong_pitch"]) for r in out.values())
