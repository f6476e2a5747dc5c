"""The pipeline and its stages against brute force, on the small tables with planted rows."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonewright.llm import common, mixing, ngram_join, packing, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The documents with exact and near copies, rows without text, id or source, and columns whose names clash."""
    r = random.Random(3)
    t = common.table(spark, SF, "documents").toPandas()[["doc_id", "text", "source"]]
    rows = [(int(i), t, s) for i, t, s in t.itertuples(index=False)]
    good = [t for _, t, _ in rows if len(words_of(t)) > 150]
    for k, text in enumerate(good[:6]):
        w = text.split(" ")
        for copy in range(3):
            w = [*w]
            w[r.randrange(len(w))] = "changed"
            rows.append((10_000 + 10 * k + copy, " ".join(w), r.choice(["new", None, rows[0][2]])))
        rows.append((10_009 + 10 * k, text, "new"))
    rows += [(20_000, None, "new"), (20_001, "", None), (20_002, "few words", "new"), (20_003, good[6], None), (None, good[7] + " more", "new"), (20_003, good[6], None)]
    path = str(tmp_path_factory.mktemp("pipeline") / "documents.parquet")
    out = spark.createDataFrame([(*x, "extra", 7) for x in rows], "doc_id long, text string, source string, _row string, kept int")
    out.repartition(3).write.parquet(path)
    return path


def plain_near(rows):
    """One row of each class: links by comparing all pairs of shingle sets."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words_of(t)]) else set() for _, t, _ in rows]
    keys = sorted({i for i, _, _ in rows if i is not None})
    root = {i: i for i in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i, j, x, y = rows[a][0], rows[b][0], sets[a], sets[b]
        if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def plain_exact(rows):
    best = {}
    for i, t, s in rows:
        now = best.get(t or "")
        if now is None or (i if i is not None else -1) > (now[0] if now[0] is not None else -1):
            best[t or ""] = (i, t, s)
    return list(best.values())


def triples(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_one_by_one(spark, docs):
    table = spark.read.parquet(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mix", "pack"]
    for name in ("quality", "exact", "near", "mix"):
        rows = triples(table)
        out_frame = stages[name](spark, table, SF)
        assert out_frame.columns == table.columns
        out = triples(out_frame)
        if name == "quality":
            assert all(len(words_of(t)) >= 50 for _, t, _ in out) and not Counter(out) - Counter(rows)
            labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
            assert {i for i, q in labels.items() if q == 1} <= {i for i, _, _ in out} | {i for i, t, _ in rows if len(words_of(t)) < 50}
        elif name == "exact":
            assert sorted(map(str, ((i, t) for i, t, _ in out))) == sorted(map(str, ((i, t) for i, t, _ in plain_exact(rows)))) and len(out) < len(rows)
        elif name == "near":
            assert sorted(map(str, out)) == sorted(map(str, plain_near(rows))) and len(out) < len(rows)
        else:
            taken = Counter((i, t) for i, t, _ in out)
            by, size = Counter(), lambda t: len(words_of(t))
            for _, t, s in rows:
                by[s] += size(t)
            total = sum(size(t) for _, t, _ in out)
            assert all(n <= 2 for n in taken.values()) and 1.5 * sum(by.values()) - max(size(t) for _, t, _ in rows) <= total <= 1.5 * sum(by.values())
            want = {r["_src"]: r["target"] for r in mixing.targets(mixing._base(table, "doc_id", "text", "source")).join(mixing._base(table, "doc_id", "text", "source").select("_key", "_src").distinct(), "_key").collect()}
            for s, goal in want.items():
                assert abs(sum(size(t) for _, t, x in out if x == s) - goal) <= max(size(t) for _, t, x in rows if x == s)
        path = common.scratch_path(spark, f"test-{name}")
        out_frame.write.parquet(path)
        table = spark.read.parquet(path)
    check_packed(triples(table), stages["pack"](spark, table, SF).collect())


def check_packed(rows, pieces):
    """The pieces are the ids of all rows, cut and placed."""
    tok = Tokenizer.from_file(queries.WORD_BPE)
    want = Counter()
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            want[i, k, a, np.array(ids[a : a + packing.CAPACITY], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in pieces) == want
    bins = {}
    for r in pieces:
        assert r["length"] * 4 == len(r["ids"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    found = packing.complete(dict(Counter(r["length"] for r in pieces)))
    assert len(bins) == found.sequences


def test_run_is_the_stages_in_order(spark, docs):
    folder = docs.rpartition("/")[0]
    pieces = corpus_pipeline.run(spark, folder).collect()
    table = spark.read.parquet(docs)
    kept = triples(corpus_pipeline.quality(spark, table, folder))
    rows = plain_near(plain_exact(kept))
    assert {r["doc_id"] for r in pieces} <= {i for i, _, _ in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_packed(triples(mixing.mixed(frame)), pieces)


def test_empty_tables(spark, docs):
    none = spark.read.parquet(docs).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_scratch_tables_of_the_join_are_released(spark, docs):
    table = spark.read.parquet(docs)
    with common.recorded() as made:
        ngram_join.representatives(table).count()
    assert len(made) == 1 and made[0].rpartition("/")[2].startswith("labels-")
    common.release(spark, made)
    assert not made and table.filter(F.col("doc_id") == 20_000).count() == 1
