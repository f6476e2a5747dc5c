"""Exact neighbours among copies, and the recall of the index."""

import numpy as np
import pytest

from tonewright.operators import vectors
from tonewright.plans import registry
from tonewright.plans.dataset_queries import _vectors

SCHEMA = "vec_id long, vec array<double>"


def by_query(df) -> dict:
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append(r["vec_id"])
    return out


def brute(queries, rows, k, without_own=False) -> dict:
    """Squared distances of every pair, ties by id."""
    near = lambda q, x: sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), i) for i, v in rows if not (without_own and i == q))
    return {q: [i for _, i in near(q, x)[:k]] for q, x in queries}


@pytest.mark.parametrize(("without_own", "small"), [(False, False), (True, False), (True, True)])
def test_nearest_among_copies_in_no_order(spark, monkeypatch, without_own, small):
    if small:  # many blocks and tiles
        for name, size in (("QUERY_BLOCK", 2), ("INDEX_VALUES", 64 * 150), ("QUERY_ROWS", 1), ("TILE_ROWS", 40)):
            monkeypatch.setattr(vectors, name, size)
    r = np.random.default_rng(2)
    base = r.normal(size=64)
    copies = [(i, base.tolist()) for i in range(1000)]
    others = [(i, r.normal(size=64).tolist()) for i in range(1000, 1200)]
    rows = [(copies + others)[i] for i in r.permutation(1200)]
    asked = [copies[990], *others[:3]]
    index = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = by_query(vectors.nearest_vectors(spark.createDataFrame(asked, SCHEMA), index, 8, **({"without_own": True} if without_own else {})))
    assert got == brute(asked, rows, 8, without_own)
    assert got[990] == list(range(8))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Two speakers with more cells than four, one of them with several branches, and one with a single vector; ids are shared."""
    r = np.random.default_rng(3)
    where = r.normal(size=(12, 16)) * 3
    one = lambda s, n: [(s, i, (where[r.integers(12)] + r.normal(size=16)).tolist()) for i in range(n)]
    v = spark.createDataFrame(one(1, 900) + one(2, 300) + one(3, 1), "speaker int, vec_id long, vec array<double>").repartition(3).persist()
    old, vectors.ONE_BRANCH = vectors.ONE_BRANCH, 10
    path = str(tmp_path_factory.mktemp("index"))
    vectors.build_index(v, f"file://{path}")
    vectors.ONE_BRANCH = old
    return v, vectors.open_index(spark, f"file://{path}")


def of_speakers(df) -> dict:
    out = {}
    for r in df.orderBy("speaker", "q", "rank").collect():
        out.setdefault((r["speaker"], r["q"]), []).append(r["vec_id"])
    return out


def recall(found: dict, exact: dict) -> float:
    return sum(len(set(found.get(q, [])) & set(e)) for q, e in exact.items()) / sum(map(len, exact.values()))


def test_every_vector_is_in_the_nearest_cell_of_its_branch(clustered):
    v, index = clustered
    rows = index.postings.collect()
    assert sorted((r["speaker"], r["vec_id"]) for r in rows) == sorted((r["speaker"], r["vec_id"]) for r in v.collect())
    cells = {}
    for c in index.cells.collect():
        cells.setdefault((c["speaker"], c["branch"]), []).append((c["cell"], np.array(c["centre"])))
    for r in rows:
        d = {n: float(((np.array(r["vec"]) - c) ** 2).sum()) for n, c in cells[r["speaker"], r["branch"]]}
        assert d[r["cell"]] <= min(d.values()) + 1e-9
    branches = {s: len({b for t, b in cells if t == s}) for s in (1, 2, 3)}
    assert branches[1] > 1 and branches[2] == branches[3] == 1
    n = {s: sum(len(c) for (t, _), c in cells.items() if t == s) for s in (1, 2, 3)}
    assert abs(n[1] - vectors.cell_count(900)) <= branches[1] and n[2] <= vectors.cell_count(300) and n[3] == 1


def test_all_cells_give_the_exact_neighbours_of_the_speaker(clustered):
    v, index = clustered
    exact = {}
    for s in (1, 2, 3):
        rows = [(r["vec_id"], r["vec"]) for r in v.filter(f"speaker = {s}").collect()]
        exact |= {(s, q): x for q, x in brute([x for x in rows if x[0] % 10 == 0], rows, 8).items()}
    q = v.filter("vec_id % 10 = 0")
    assert of_speakers(vectors.ivf_search(q, index, 8, 1000, 1000)) == exact
    assert of_speakers(vectors.ivf_search(q, index, 8, 1000, 1000, prune_rows=0)) == exact


def test_chosen_probes_reach_the_recall_of_each_speaker(clustered):
    v, index = clustered
    q = v.filter("vec_id % 3 = 0")
    nprobe, nbranch = vectors.choose_probes(q, index, sample=64)
    assert nprobe < index.cells.filter("speaker = 1").count()
    exact = of_speakers(vectors.nearest_vectors(q, v, by=("speaker",)))
    found = of_speakers(vectors.ivf_search(q, index, 8, nprobe, nbranch))
    for s in (1, 2, 3):
        assert recall(found, {k: e for k, e in exact.items() if k[0] == s}) >= 0.9


def test_search_reads_the_folders_that_it_probes(clustered):
    v, index = clustered
    found = vectors.ivf_search(v.filter("speaker = 1 and vec_id = 5"), index, 8, 1, 1)
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and found.count() > 0
    assert {"speaker", "branch"} <= {p.partition("=")[0] for f in index.postings.inputFiles() for p in f.split("/")}


def test_index_query_reaches_the_recall(spark):
    folder = "/root/testdata/sf0.01"
    v = _vectors(spark, folder)
    exact = of_speakers(vectors.nearest_vectors(v.filter("vec_id % 50 = 0"), v, by=("speaker",)))
    assert recall(of_speakers(registry.QUERIES["j12_ivf_search"](spark, folder)), exact) >= 0.9


def cost(x: np.ndarray, c: np.ndarray) -> float:
    return float(((x[:, None, :] - c[None, :, :]) ** 2).sum(2).min(1).sum())


def test_mini_batches_find_planted_clusters(spark, tmp_path):
    r = np.random.default_rng(5)
    where = r.normal(size=(6, 8)) * 10
    rows = [(1, i, (where[i % 6] + r.normal(size=8)).tolist()) for i in range(3000)] + [(2, i, r.normal(size=8).tolist()) for i in range(40)]
    rows += [(3, i, [float("nan")] * 8) for i in range(90)]
    v = spark.createDataFrame(rows, "speaker int, vec_id long, vec array<double>")
    out = vectors.compress_features(v, f"file://{tmp_path}/k", above=80, to=24, batch=700, batches=6).collect()
    assert sorted((x["vec_id"], x["vec"]) for x in out if x["speaker"] == 2) == sorted((b, c) for a, b, c in rows if a == 2)
    assert sum(x["speaker"] == 3 for x in out) == 90  # not numbers: they stay
    x = np.array([c for a, _, c in rows if a == 1])
    c = np.array([k["vec"] for k in out if k["speaker"] == 1])
    assert len(c) == 24 and cost(x, c) <= 1.05 * cost(x, where)
    assert cost(x, c) <= 1.05 * min(cost(x, vectors.k_means(x[r.permutation(3000)], 24)) for _ in range(3))


def test_bounds_of_cells():
    assert [vectors.cell_count(n) for n in (1, 39, 78, 10**4, 10**6, 10**8)] == [1, 1, 2, 256, 16_000, 160_000]


def test_blend_is_the_weighted_mean(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [9.0, 9.0])], SCHEMA)
    near = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 4.0, 2)], "q long, vec_id long, d2 double, rank int")
    got = {x["q"]: x["vec"] for x in vectors.knn_blend(near, v, v.filter("vec_id in (1, 4)"), 0.5).collect()}
    w = np.array([1.0, 1 / 16])
    assert np.allclose(got[1], 0.5 * (w[0] * np.array([1, 0]) + w[1] * np.array([0, 2])) / w.sum()) and got[4] == [9.0, 9.0]
