"""Queries without SQL read every member of every clip."""

import pytest
from pyspark.sql import functions as F

from tonewright.operators import decoding
from tonewright.plans import registry
from tonewright.plans.testbed import samples

MEMBERS = ["v9_slice_on_silence", "v11_frame_rms_db", "v12_spectral_cues", "v13_log_mel", "v13_linear_spec", "v15_rms_envelope_mix", "w16_quiet_cut_points"]


@pytest.fixture(scope="module")
def arrays(spark, sf_dir):
    t = samples(spark, sf_dir).groupBy("clip", "member").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
    return {(r["clip"], r["member"]): [x["x"] for x in r["l"]] for r in t.collect()}


@pytest.mark.parametrize("name", MEMBERS)
def test_every_member_of_every_clip(spark, sf_dir, arrays, name):
    out = registry.QUERIES[name](spark, sf_dir)
    least = 41 if name.startswith("w16") else 1  # cut points only in clips of more than 40 samples
    assert {tuple(r) for r in out.select("clip", "member").distinct().collect()} == {k for k, x in arrays.items() if len(x) >= least}


def test_slices_of_each_member(spark, sf_dir, arrays):
    import numpy as np

    want = set()
    for (clip, member), x in arrays.items():
        rms = np.abs(x) * [0.01 if i // 9 % 3 == 1 else 1.0 for i in range(len(x))]
        want |= {(clip, member, k, a, b) for k, (a, b) in enumerate(decoding.slice_on_silence(rms, 100_000, 0.02, 10, 5, 3))}
    got = registry.QUERIES["v9_slice_on_silence"](spark, sf_dir).select("clip", "member", "slice_no", "s", "e")
    assert {tuple(r) for r in got.collect()} == want


def test_chunks_keep_every_sample(spark, sf_dir, arrays):
    got = registry.QUERIES["v15_rms_envelope_mix"](spark, sf_dir).groupBy("clip", "member").count().collect()
    assert {(r["clip"], r["member"]): r["count"] for r in got} == {k: -(-len(x) // 32) for k, x in arrays.items()}
