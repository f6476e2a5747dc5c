"""Stateful streams over micro-batches in any order, against one pass over the whole."""

import datetime
import random

import numpy as np
import pytest

from tonewright.streaming import jobs

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "session long, seq long, ts timestamp, samples array<double>"


def block(session, seq, samples):
    return (session, seq, BEGIN + datetime.timedelta(seconds=seq), [float(x) for x in samples])


def played(spark, tmp_path, batches, job, schema=SCHEMA):
    """The rows that job gives for micro-batches, in the order in which they come out."""
    where = f"{tmp_path}/in"
    spark.createDataFrame([], schema).write.mode("append").parquet(where)
    out = []
    stream = spark.readStream.schema(schema).parquet(where)
    jobs.use_state_store(spark)
    q = job(stream).writeStream.foreachBatch(lambda t, _: out.extend(t.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def as_rows(rows):
    return sorted((r["session"], r["seq"], tuple(np.round(r["samples"], 9))) for r in rows)


def test_shuffled_batches_give_the_batch_result(spark, tmp_path):
    """Blocks of three sessions in random order, some twice, over five micro-batches, all within the watermark."""
    r = random.Random(4)
    blocks = [block(s, k, np.sin(np.arange(12) * 0.3 * k + s)) for s in (1, 2, 3) for k in range(1, 9)]
    mixed = blocks + r.sample(blocks, 5)
    r.shuffle(mixed)
    job = lambda t: jobs.pitch_ring(t, 16, 4, late="1 hour", first=1)
    got = played(spark, tmp_path, [mixed[i::5] for i in range(5)], job)
    assert as_rows(got) == as_rows(job(spark.createDataFrame(mixed, SCHEMA)).collect()) and len(got) == len(blocks)
    assert all([x["seq"] for x in got if x["session"] == s] == list(range(1, 9)) for s in (1, 2, 3))


def test_gaps_are_let_go_by_the_watermark(spark, tmp_path):
    """Block 3 never comes: 4 and 5 wait until the watermark has passed them, and 3 is dropped when it comes after that."""
    one = {k: block(1, k, np.arange(12) + k) for k in range(1, 7)}
    far = [(9, 1, BEGIN + datetime.timedelta(hours=1), [0.0] * 12)]
    job = lambda t: jobs.stitch_blocks(t, 3, 2, late="10 seconds", first=1)
    got = played(spark, tmp_path, [[one[1], one[2], one[4]], [one[5]], far, [one[3]], [one[6]]], job)
    got = [x for x in got if x["session"] == 1]
    assert [x["seq"] for x in got][:4] == [1, 2, 4, 5] and 3 not in [x["seq"] for x in got]
    whole = job(spark.createDataFrame([one[k] for k in (1, 2, 4, 5)], SCHEMA)).collect()
    assert as_rows(got[:4]) == as_rows(whole)


def test_muted_stream_is_the_muted_batch(spark, tmp_path):
    r = random.Random(8)
    blocks = [block(s, 20 * k, [0.01 * r.random() if 3 <= k <= 11 else r.choice([0.01, 0.5]) for _ in range(6)]) for s in (1, 2) for k in range(14)]
    job = lambda t: jobs.muted_blocks(t, "30 seconds", "120 seconds", -20.0, late="10 minutes")
    mixed = blocks[:]
    r.shuffle(mixed)
    far = [[(9, 1, BEGIN + datetime.timedelta(days=1), [0.0])], [(9, 2, BEGIN + datetime.timedelta(days=2), [0.0])]]
    got = [x for x in played(spark, tmp_path, [mixed[:9], mixed[9:], *far], job) if x["session"] != 9]
    want = job(spark.createDataFrame(blocks, SCHEMA)).collect()
    assert as_rows(got) == as_rows(want) and len(want) == len(blocks)
    at = {(s, q): x for s, q, _, x in blocks}
    for x in want:
        end = x["seq"] // 30 * 30 + 30
        near = [v for (s, q), xs in at.items() if s == x["session"] and end - 120 <= q < end for v in xs]
        closed = 10 * np.log10(np.mean(np.square(near))) < -20
        assert x["samples"] == ([0.0] * 6 if closed else at[x["session"], x["seq"]])
    assert any(not any(x["samples"]) for x in want) and any(any(x["samples"]) for x in want)
    assert as_rows(jobs.muted_blocks(spark.createDataFrame(blocks, SCHEMA), "30 seconds", "120 seconds", -60.0).collect()) == as_rows([dict(zip(("session", "seq", "ts", "samples"), b, strict=True)) for b in blocks])


def loudness_by_hand(source, output, rate, hop):
    """One pass over whole signals."""
    m = len(source) // hop
    level = lambda x, j: np.sqrt(sum(np.mean(np.square(x[h * hop : (h + 1) * hop])) for h in range(max(0, j - 4), j)) / 4)
    out = []
    for p in range(m * hop):
        h, f = p // hop, p % hop / hop
        r1, r2 = (level(x, h) * (1 - f) + level(x, h + 1) * f for x in (source, output))
        out.append(output[p] * (r1 / max(r2, 1e-3)) ** (1 - rate))
    return np.array(out)


@pytest.mark.parametrize("sizes", [[100], [1] * 100, [7, 13, 80], [8] * 12 + [4], [0, 50, 0, 50]])
def test_loudness_is_the_same_for_any_blocks(spark, sizes):
    r = np.random.default_rng(1)
    source, output = r.normal(size=100), r.normal(size=100) * np.linspace(0, 1e-2, 100)
    state, got, at = np.zeros(8), [], 0
    for n in sizes:
        out, state = jobs.loudness_step(state, source[at : at + n], output[at : at + n], 0.3, 8)
        got.append(out)
        at += n
    assert np.allclose(np.concatenate(got), loudness_by_hand(source, output, 0.3, 8), atol=1e-12)


def test_loudness_stream(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(1, k, BEGIN + datetime.timedelta(seconds=k), r.normal(size=k % 5 + 3).tolist(), r.normal(size=k % 5 + 3).tolist()) for k in range(1, 9)]
    schema = "session long, seq long, ts timestamp, source array<double>, output array<double>"
    job = lambda t: jobs.loudness_mix(t, 0.3, 4, late="1 hour", first=1)
    got = played(spark, tmp_path, [rows[4:], rows[:4]], job, schema)
    assert [x["seq"] for x in got] == list(range(1, 9))
    whole = loudness_by_hand(np.concatenate([x[3] for x in rows]), np.concatenate([x[4] for x in rows]), 0.3, 4)
    assert np.allclose(np.concatenate([x["samples"] for x in got]), whole)
