"""Values of queries without SQL, worked out a second time in NumPy or plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import signal
from tonewright.plans import registry
from tonewright.plans.dataset_queries import _vectors
from tonewright.plans.note_queries import _path, _voiced
from tonewright.plans.signal_queries import _blocks
from tonewright.plans.testbed import notes, samples


@pytest.fixture(scope="module")
def arrays(spark, sf_dir):
    t = samples(spark, sf_dir).groupBy("clip", "member").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
    return {(r["clip"], r["member"]): np.array([x["x"] for x in r["l"]]) for r in t.collect()}


def windows_of(x, window, hop):
    """Windows around every hop, the signal mirrored at its ends, one transform after another."""
    n, half = len(x), window // 2
    at = lambda q: -q if q < 0 else 2 * (n - 1) - q if q >= n else q
    return [np.array([x[at(q)] for q in range(k * hop - half, k * hop + half)]) for k in range(n // hop + 1)]


def spectrum(w):
    """The discrete Fourier transform under a Hann window, by its definition."""
    n = len(w)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.array([(w * hann * np.exp(-2j * np.pi * f * np.arange(n) / n)).sum() for f in range(n // 2 + 1)])


def mel_bank(rate, n_fft, n_mels, low, high):
    mel = lambda f: 3 * f / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    hz = lambda m: 200 * m / 3 if m < 15 else 1000 * np.exp((m - 15) * np.log(6.4) / 27)
    edges = [hz(mel(low) + (mel(high) - mel(low)) * k / (n_mels + 1)) for k in range(n_mels + 2)]
    bank = np.zeros((n_mels, n_fft // 2 + 1))
    for m, (a, b, c) in enumerate(zip(edges, edges[1:], edges[2:], strict=False)):
        for k in range(n_fft // 2 + 1):
            f = rate * k / n_fft
            bank[m, k] = max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a)
    return bank


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_linear_and_mel_spectra(spark, sf_dir, arrays):
    linear, mel = (rows(registry.QUERIES[q](spark, sf_dir), "clip", "member", "frame") for q in ("v13_linear_spec", "v13_log_mel"))
    bank = mel_bank(1000, 16, 6, 10.0, 500.0)
    for (clip, member), x in arrays.items():
        for k, w in enumerate(windows_of(x, 16, 8)):
            s = np.abs(spectrum(w))
            assert linear[clip, member, k]["total"] == pytest.approx(np.sqrt(s**2 + 2e-7).sum(), abs=2e-4)
            assert mel[clip, member, k]["total"] == pytest.approx(np.log(np.maximum(bank @ s, 1e-5)).sum(), abs=2e-3)
    assert len(linear) == len(mel) == sum(len(x) // 8 + 1 for x in arrays.values())


def test_spectral_cues(spark, sf_dir, arrays):
    got = rows(registry.QUERIES["v12_spectral_cues"](spark, sf_dir), "clip", "member", "frame")
    bank = mel_bank(1000, 16, 6, 0.0, 500.0)
    for (clip, member), x in arrays.items():
        power = np.array([np.abs(spectrum(w)) ** 2 for w in windows_of(x, 16, 8)])
        level = 10 * np.log10(np.maximum(power @ bank.T, 1e-10))
        flux = np.r_[0.0, np.maximum(0, np.diff(level, axis=0)).mean(1)]
        flux /= np.percentile(flux, 95) + 1e-9
        for k in range(len(power)):
            r = got[clip, member, k]
            assert r["hf"] == pytest.approx(power[k, 4:].sum() / (power[k].sum() + 1e-10), abs=2e-4)
            if flux[k] < 100:
                assert r["flux"] == pytest.approx(flux[k], abs=2e-3)


def test_ensemble_of_spectra(spark, sf_dir, arrays):
    got = {}
    for r in registry.QUERIES["a16_ensemble_fft"](spark, sf_dir).collect():
        got.setdefault(r["clip"], {})[r["pos"]] = r["x"]
    for clip in {c for c, _ in arrays}:
        members = [arrays[c, m] for c, m in sorted(arrays) if c == clip]
        n = min(map(len, members))
        specs = np.array([[spectrum(w) for w in padded(x[:n])] for x in members])
        pick = np.abs(specs).argmax(0)
        best = np.take_along_axis(specs, pick[None], 0)[0]
        out, norm = np.zeros(32 + 16 * (len(best) - 1)), np.zeros(32 + 16 * (len(best) - 1))
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
        for k, s in enumerate(best):
            full = np.r_[s, s[-2:0:-1].conj()]
            wave = np.array([(full * np.exp(2j * np.pi * np.arange(32) * t / 32)).sum().real / 32 for t in range(32)])
            out[16 * k : 16 * k + 32] += wave * hann
            norm[16 * k : 16 * k + 32] += hann**2
        want = np.where(norm > 1e-10, out / np.maximum(norm, 1e-10), 0)[16:]
        want = np.pad(want, (0, max(0, n - len(want))))[:n]
        assert len(got[clip]) == n and np.allclose([got[clip][k] for k in range(n)], want, atol=2e-4)


def padded(x):
    x = np.pad(x, 16, mode="reflect" if len(x) > 16 else "constant")
    return [x[a : a + 32] for a in range(0, len(x) - 31, 16)]


def test_dips_cut_spans(spark, sf_dir):
    f, path = _path(spark, sf_dir)
    loud = rows(f.select("track_id", "idx", "rms_db"), "track_id", "idx")
    held = {}
    for r in sorted(path.collect(), key=lambda r: (r["track_id"], r["idx"])):
        held.setdefault(r["track_id"], []).append(r["note"])
    want = set()
    for track, note in held.items():
        a = 0
        while a < len(note):
            z = a
            while z < len(note) and note[z] == note[a]:
                z += 1
            if note[a] >= 0 and z - a >= 3:
                x = [loud[track, i]["rms_db"] for i in range(a, z)]
                level = [float(np.median([x[min(max(i + d, 0), len(x) - 1)] for d in range(-2, 3)])) for i in range(len(x))]
                low = [v < np.median(level) - 10.0 for v in level]
                at, i = a, 0
                while i < len(x):
                    j = i
                    while j < len(x) and low[j]:
                        j += 1
                    if j > i:
                        cut = a + min(range(i, j), key=lambda k: (level[k], k))
                        if i > 0 and j < len(x) and cut - at >= 4 and z - cut >= 4:
                            want.add((track, at, cut, note[a]))
                            at = cut + 1
                    i = j + 1
                want.add((track, at, z, note[a]))
            a = z
    got = {(r["track_id"], r["s"], r["e"], r["note"]) for r in registry.QUERIES["v6_split_on_dips"](spark, sf_dir).collect()}
    assert got == want


def test_decoded_path_is_the_best_of_its_neighbours(spark, sf_dir):
    """The score of each path, by the rules, isn't beaten by changing any one stretch of it to another state."""
    from tonewright.operators import voicing

    f = _voiced(spark, sf_dir)
    keys = rows(voicing.detect_key(voicing.pitch_class_histogram(f.filter("voiced"))), "track_id")
    inputs = rows(voicing.hmm_inputs(f), "track_id")
    frames, path = {}, {}
    for r in f.orderBy("track_id", "idx").collect():
        frames.setdefault(r["track_id"], []).append(r)
    for r in registry.QUERIES["v1_decode_notes"](spark, sf_dir).orderBy("track_id", "idx").collect():
        path.setdefault(r["track_id"], []).append(r["note"])
    assert set(path) == {k[0] for k in inputs} and all(len(path[t]) == len(frames[t]) for t in path)
    scale = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
    for track, notes_ in path.items():
        one, key = inputs[track,], keys[track,]
        own = {(key["root"] + k) % 12 for k in scale[key["mode"]]}

        def total(seq, track=track, one=one, own=own):
            """The best score of the states that sound as seq: a silent frame is silence or a rest of the last note."""
            best = {}
            for t, (n, r) in enumerate(zip(seq, frames[track], strict=True)):
                sing, quiet = np.log(max(r["voice_p"], 1e-4)), np.log(max(1 - r["voice_p"], 1e-4))
                if n >= 0:
                    d = (r["midi"] if r["midi"] is not None else -1000.0) - n
                    near = lambda v: max(-v * v / (2 * one["sigma"] ** 2), -4.0)
                    e = sing + min(1.0, max(0.25, (r["conf"] - 0.2) / 0.6)) * max(near(d), max(near(d - 12), near(d + 12)) - 0.35) - (0.0 if n % 12 in own else one["penalty"])
                    ways = [-3.0] if t == 0 else []
                    for (kind, m), s in best.items():
                        leap = max(0, abs(m - n) - 5) if kind != "s" else 0
                        ways.append(s + (-3.0 if kind == "s" else (0.0 if m == n else -6.0 - leap) if kind == "n" else -3.0 - leap))
                    best = {("n", n): max(ways) + e}
                else:
                    new = {}
                    if t == 0:
                        new["s", -1] = quiet
                    for (kind, m), s in best.items():
                        moves = [(("s", -1), 0.0, 0.0)] if kind == "s" else [(("r", m), -3.0, -0.1)] if kind == "n" else [(("r", m), 0.0, -0.1), (("s", -1), -8.0, 0.0)]
                        for to, cost, decay in moves:
                            new[to] = max(new.get(to, -np.inf), s + cost + decay + quiet)
                    best = new
            return max(best.values())

        base = total(notes_)
        edges = [0, *[i for i in range(1, len(notes_)) if notes_[i] != notes_[i - 1]], len(notes_)]
        for a, z in zip(edges, edges[1:], strict=False):
            for other in (-1, notes_[a] + 1, notes_[a] - 1, notes_[a - 1] if a else -1):
                if other != notes_[a] and (other == -1 or one["lo"] <= other <= one["hi"]):
                    for lo, hi in ((a, z), (a, a + 1), (z - 1, z)):
                        assert total([*notes_[:lo], *[other] * (hi - lo), *notes_[hi:]]) <= base + 1e-9


def test_stitched_blocks(spark, sf_dir):
    got = rows(registry.QUERIES["t5_stitch_blocks"](spark, sf_dir), "session", "seq")
    tails = {}
    for r in sorted(_blocks(spark, sf_dir).collect(), key=lambda r: (r["session"], r["seq"])):
        x, tail = list(r["samples"]), tails.get(r["session"], [0.0] * 3)
        fit = [sum(a * b for a, b in zip(x[k : k + 3], tail, strict=True)) / np.sqrt(sum(a * a for a in x[k : k + 3]) + 1e-8) for k in range(3)]
        k = max(range(3), key=lambda i: (fit[i], -i))
        moved = x[k:]
        for i in range(3):
            up = np.sin(0.5 * np.pi * i / 2) ** 2
            moved[i] = moved[i] * up + tail[i] * (1 - up)
        out, tails[r["session"]] = moved[:7], moved[7:10]
        g = got[r["session"], r["seq"]]
        assert g["n"] == 7 and g["total"] == pytest.approx(sum(out), abs=2e-3) and g["placed"] == pytest.approx(sum(v * (i + 1) for i, v in enumerate(out)), abs=2e-3)


def test_vectors_are_told_by_ten_where_there_are_many(spark, sf_dir):
    sizes = {r["speaker"]: r["count"] for r in _vectors(spark, sf_dir).groupBy("speaker").count().collect()}
    out = registry.QUERIES["m4_compress_features"](spark, sf_dir).groupBy("speaker").count().collect()
    assert {r["speaker"]: r["count"] for r in out} == {s: 10 if n > 45 else n for s, n in sizes.items()}


def denoised(x, n, hop, std, strength, n_freq, n_time):
    """The whole clip at once: zeros around it, the gate's mask a frequency, smoothed, and back."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    wide = np.pad(x, n // 2)
    at = range(0, len(x) // hop * hop + 1, hop)
    spec = np.array([np.fft.rfft(wide[a : a + n] * hann) for a in at])
    db = 20 * np.log10(np.maximum(np.abs(spec), 1e-40))
    db = np.maximum(db, db.max(0) - 40)
    mask = db > db.mean(0) + std * (db.std(0, ddof=1) if len(db) > 1 else np.inf)
    soft, out = strength * (mask - 1.0) + 1, np.zeros_like(db)
    tri = lambda k: (k[0] + 1 - abs(k[1])) / (k[0] + 1) ** 2
    for i in range(len(db)):
        for j in range(db.shape[1]):
            out[i, j] = sum(tri((n_time, a)) * tri((n_freq, b)) * soft[i + a, j + b] for a in range(-n_time, n_time + 1) for b in range(-n_freq, n_freq + 1) if 0 <= i + a < len(db) and 0 <= j + b < db.shape[1])
    total, energy = np.zeros(len(wide) + n), np.zeros(len(wide) + n)
    for a, s in zip(at, spec * out, strict=True):
        total[a : a + n] += np.fft.irfft(s, n) * hann
        energy[a : a + n] += hann**2
    return np.where(energy > 1e-10, total / np.maximum(energy, 1e-10), 0)[n // 2 : n // 2 + len(x)]


def test_denoised_sound(spark, sf_dir, arrays):
    """Chunks against the whole clip; and with nothing masked the sound is what it was."""
    got = {}
    for r in registry.QUERIES["v14_denoise"](spark, sf_dir).collect():
        got.setdefault((r["clip"], r["member"]), {})[r["pos"]] = r["x"]
    assert set(got) == set(arrays)
    for key, x in sorted(arrays.items())[::3]:
        assert np.allclose([got[key][k] for k in range(len(x))], denoised(x, 16, 4, 0.5, 0.9, 1, 2), atol=2e-4)


@pytest.mark.parametrize(("length", "chunk", "block"), [(1000, 256, 16), (1024, 128, 8), (70, 64, 4), (40, 64, 64), (1001, 1000, 3)])
def test_spectra_and_back(spark, length, chunk, block):
    r = np.random.default_rng(length)
    x, y = r.normal(size=length), r.normal(size=length + 100)
    rows = [("c", m, k, k * chunk, s[k * chunk : (k + 1) * chunk].tolist()) for m, s in ((1, x), (2, y)) for k in range(-(-len(s) // chunk))]
    t = spark.createDataFrame(rows, "clip string, member int, chunk_no int, start long, samples array<double>").repartition(3)
    whole = lambda df: np.concatenate([np.array(q["samples"]) for q in df.orderBy("start").collect()])
    if chunk % 16 == 0:
        assert np.allclose(whole(signal.denoise(t.filter("member = 1"), 64, 16, strength=0.7, std=0.5, n_freq=2, n_time=3, block=block)), denoised(x, 64, 16, 0.5, 0.7, 2, 3), atol=1e-9)
    if chunk % 32 == 0:
        mixed = whole(signal.ensemble_fft(t, "avg", {1: 3.0, 2: 1.0}, n=64, hop=32))
        assert len(mixed) == length and np.allclose(mixed[1:], (0.75 * x + 0.25 * y[:length])[1:], atol=1e-9)


def test_loudness_mix_of_any_chunks(spark):
    """Levels of neighbours alone give what levels of the whole clip do."""
    r = np.random.default_rng(6)
    x, y = r.normal(size=500), r.normal(size=500) * np.linspace(0.1, 2, 500)
    out = []
    for chunk in (500, 40, 200):
        table = lambda s: spark.createDataFrame([(1, k, k * chunk, s[k * chunk : (k + 1) * chunk].tolist()) for k in range(-(-500 // chunk))], "clip long, chunk_no int, start long, samples array<double>")  # noqa: B023, E731
        got = signal.rms_envelope_mix(table(x), table(y), 0.25, 20).orderBy("start").collect()
        out.append(np.concatenate([q["samples"] for q in got]))
    assert len(out[0]) == 500 and np.allclose(out[0], out[1], atol=1e-12) and np.allclose(out[0], out[2], atol=1e-12)


def test_slides_are_folded_by_pitch(spark, sf_dir):
    """The notes that stay cover the time of those that went, and none of them calls for a merge."""
    n = notes(spark, sf_dir).select("track_id", "note_no", (F.col("start") / 5).alias("start"), (F.col("end") / 5).alias("end"), "pitch")
    before, after = {}, {}
    for t, out in ((n, before), (registry.QUERIES["v4_fold_slides"](spark, sf_dir), after)):
        for r in sorted(t.collect(), key=lambda r: (r["track_id"], r["start"])):
            out.setdefault(r["track_id"], []).append(r)
    for track, rest in after.items():
        assert {r["note_no"] for r in rest} <= {r["note_no"] for r in before[track]}
        assert min(r["start"] for r in rest) == pytest.approx(min(r["start"] for r in before[track]), abs=1e-4)
        assert max(r["end"] for r in rest) == pytest.approx(max(r["end"] for r in before[track]), abs=1e-4)
        for r in before[track]:
            assert any(k["start"] - 1e-4 <= r["start"] and r["end"] <= k["end"] + 1e-4 for k in rest)


def test_mel_matrix_is_the_plain_one():
    for args in ((1000, 16, 6, 10.0, 500.0), (16000, 1024, 64, 30.0, 8000.0)):
        assert np.allclose(signal.mel_matrix(*args), mel_bank(*args), atol=1e-9)


def test_feeds_that_fail_are_empty(spark):
    from tonewright.operators import catalogue
    from tonewright.plans.source_queries import written

    good = spark.createDataFrame([("a", "b")], "title string, artist string")
    bad = good.select(F.when(F.col("title") == "a", F.raise_error(F.lit("offline"))).cast("string").alias("title"))
    out, failed = catalogue.union_feeds("ab", lambda t: written(spark, t), one=lambda q: good, two=bad, three=lambda q: 1 / 0, four=good)
    assert failed == ["two", "three"] and [r["feed"] for r in out.orderBy("feed").collect()] == ["four", "one"]
    assert catalogue.union_feeds("a", lambda t: written(spark, t), one=good)[0].count() == 0


def test_folders_without_audio_fail(spark, tmp_path):
    from tonewright.sources import tables

    (tmp_path / "x.txt").write_text("no sound")
    with pytest.raises(ValueError, match="no audio"):
        tables.list_audio_files(spark, str(tmp_path))
