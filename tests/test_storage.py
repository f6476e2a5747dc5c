"""Tables in buckets, file lists, the index of trigrams, sketched quantiles, places in an order, and the plans behind them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.functions import stats
from tonewright.operators import catalogue, dataset, evaluation, voicing, windows
from tonewright.plans.catalogue_queries import _songs
from tonewright.plans.testbed import frames
from tonewright.sources import tables as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_of_buckets_have_no_exchange(spark, tmp_path, shuffled_joins):
    a = spark.range(1000).select((F.col("id") % 50).alias("track_id"), F.floor(F.col("id") / 50).alias("idx"), F.col("id").alias("x"))
    b = a.filter("x % 3 = 0").withColumnRenamed("x", "label")
    key = ("track_id", "idx")
    left, right = (S.write_bucketed(t, f"file://{tmp_path}/{n}", key, buckets=8) for t, n in ((a, "a"), (b, "b")))
    met = left.join(right, list(key))
    assert "Exchange" not in plan(met) and "SortMergeJoin" in plan(met)
    assert sorted(met.collect()) == sorted(a.join(b, list(key)).collect())
    again = S.open_bucketed(spark, f"file://{tmp_path}/a", "track_id long, idx long, x long", key, buckets=8)
    assert "Exchange" not in plan(again.join(right, list(key))) and sorted(again.collect()) == sorted(a.collect())
    names = [S.write_bucketed(t.select(F.col("x").alias("clip") if "x" in t.columns else F.col("label").alias("clip")), f"file://{tmp_path}/{n}", ("clip",), buckets=8) for t, n in ((a, "c"), (b, "d"))]
    semi = dataset.training_set(names[1], names[0])
    assert "Exchange" not in plan(semi) and semi.count() == b.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


@pytest.mark.parametrize("missing", range(6))
def test_fields_of_a_file_list_keep_their_places(spark, tmp_path, missing):
    row = ["w", "f", "p", "q", "3", "bob"]
    row[missing] = None
    t = spark.createDataFrame([tuple(row)], "wav string, feature string, f0 string, f0nsf string, speaker_id string, speaker_name string")
    S.write_filelist(t, f"file://{tmp_path}/{missing}")
    assert [tuple(x) for x in S.read_filelist(spark, f"file://{tmp_path}/{missing}").collect()] == [tuple(row)]
    line = t.select(dataset.filelist_line(*map(F.col, t.columns[:5]), name=F.col("speaker_name"))).first()[0]
    assert line == "|".join([x or "" for x in row[:5]] + row[5:] * (row[5] is not None))


def test_speakers_of_repeated_clips(spark):
    clips = spark.createDataFrame([("a_1", 1), ("a_1", 1), ("a_2", 2), ("b", 3)], "clip string, n int")
    manifest = spark.createDataFrame([("a_1", 7), ("a", 8)], "output_key string, speaker_id int")
    got = sorted(tuple(x) for x in dataset.attach_speaker(clips, manifest, whole_first=True).collect())
    assert got == [("a_1", 1, "a_1", 7), ("a_1", 1, "a_1", 7), ("a_2", 2, "a", 8)]


@pytest.mark.parametrize("query", ["SRC1 stem3", "take", "tem1 e", "ta 1", "xyzzy", "e", "", "SRC11"])
def test_index_gives_the_page_of_the_scan(spark, sf_dir, tmp_path, query):
    s = _songs(spark, sf_dir)
    catalogue.build_trigrams(s, f"file://{tmp_path}/i")
    index = spark.read.parquet(f"file://{tmp_path}/i")
    for limit in (5, 400):
        (page, total), (page2, total2) = catalogue.browse(s, query, limit), catalogue.browse_indexed(s, index, query, limit)
        assert page.collect() == page2.collect() and total.collect() == total2.collect()
    found = catalogue.candidates(index, query)
    if found is not None:
        assert re.search(r"PushedFilters: \[.*(In\(gram|EqualTo\(gram)", found._jdf.queryExecution().explainString(found._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) if hasattr(found, "_jvm") else "gram" in plan(found)


def test_features_take_one_shuffle_and_one_sort(spark, sf_dir, tmp_path):
    frames(spark, sf_dir).drop("ts").write.parquet(f"{tmp_path}/f")
    t = spark.read.parquet(f"{tmp_path}/f")
    for df in (windows.frame_features(t), windows.median_smooth(t, "f0", F.col("f0") > 0)):
        assert len(re.findall(r"\bSort \[", plan(df))) == 1 and len(re.findall(r"\bExchange ", plan(df))) == 1


def test_sketched_quantiles_are_within_their_rank_error(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=20_000), np.full(5000, 0.25)])
    t = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    for accuracy in (50, 1000):
        for p in (0.005, 0.5, 0.95, 0.99):
            got = t.agg(stats.quantile("x", p, accuracy)).first()[0]
            low, high = (x < got).mean(), (x <= got).mean()
            assert low - 1 / accuracy <= p <= high + 1 / accuracy
    assert t.agg(stats.quantile("x", 0.95)).first()[0] == pytest.approx(np.percentile(x, 95))


def test_sketches_in_the_operators(spark, sf_dir):
    f = frames(spark, sf_dir).drop("ts")
    exact, sketched = voicing.soft_voicing(f), voicing.soft_voicing(f, voicing.Settings(accuracy=10_000))
    assert sketched.count() == exact.count() and "percentile_approx" in sketched._jdf.queryExecution().toString()
    assert windows.frame_features(f, accuracy=10_000).count() == f.count()


def test_places_in_order(spark):
    keys = [f"k{i:03}" for i in range(300)]
    t = spark.createDataFrame([(k,) for k in reversed(keys)], "track_id string").repartition(5)
    for cuts in (1, 7, 1000):
        got = {x["track_id"]: x["place"] for x in stats.ordered_places(t, "track_id", cuts).collect()}
        assert got == {k: i for i, k in enumerate(keys)}
    want = set()
    for outer in range(5):
        left = [k for i, k in enumerate(keys) if i % 5 != outer]
        want |= {(k, keys.index(k) % 5, outer, q % 4) for q, k in enumerate(left)}
    assert {tuple(x) for x in evaluation.folds(t).collect()} == want


def test_names_of_many_copies(spark):
    """A hot stem, numbers that are taken over the bounds of blocks, names that only look numbered, nulls."""
    stems = ["a"] * 400 + [f"a_{n}" for n in (2, 3, 4, 5, 8, 9, 31, 32, 33, 64, 399, 400, 5000)] + ["a_2"] * 3 + ["a_2_2", "a_02", "a_1", "b", "c_7", "c_99999999999"] + ["b"] * 5 + ["", "", None, None]
    rows = [(i * 7919 % 1009, s) for i, s in enumerate(stems)]
    t = spark.createDataFrame(rows, "no int, stem string").repartition(5)
    used, want, seen = {s for s in stems if s is not None}, {}, {}
    for no, s in sorted(rows):
        if s is None or s not in seen:
            want[no], seen[s] = s, 1
            continue
        seen[s] += 1
        while f"{s}_{seen[s]}" in used:
            seen[s] += 1
        want[no] = f"{s}_{seen[s]}"
    for block in (4, 1024):
        got = catalogue.unique_names(t, "no", block=block)
        assert got.columns == ["no", "stem", "name"]
        assert {r["no"]: r["name"] for r in got.collect()} == want
    assert catalogue.unique_names(t.limit(0), "no").count() == 0
