"""Connected components on long chains, and links of ids with several rows."""

import itertools
import random

import pytest

from tonewright.llm import graph, ngram_join


def test_components_of_a_long_chain_in_no_order(spark):
    r = random.Random(4)
    chain, other = r.sample(range(10**9), 1500), list(range(2 * 10**9, 2 * 10**9 + 300))
    edges = [*itertools.pairwise(chain), *itertools.pairwise(other)]
    got = {x["id"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(c) for c in (chain, other) for i in c}


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 100])
def test_ids_with_several_rows_keep_all_their_sets(spark, block):
    r = random.Random(6)
    text = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    near = lambda w: [*w[:-1], "other"]
    rows, want = [], {}
    for k in range(12):
        a, b, c = 100 * k, 100 * k + 1, 100 * k + 2
        one, two = text(60), text(30 if k % 2 else 60)
        # b is a copy of a by one row and near c by another, and has a row without a word
        rows += [(a, one), (b, one), (b, two), (b, []), (c, near(two))]
        want |= {a: a, b: a, c: a}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {x["_id"]: x["component_id"] for x in ngram_join.classes(docs, ngram_join.Similarity(3, 90, 100), max_block=block).collect()}
    assert got == want
