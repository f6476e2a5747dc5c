"""Connected components of an edge table, with labels that are the smallest id reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import recorded, release, stored


def components(edges: DataFrame) -> DataFrame:
    """id and label of every node of edges (a, b, both long). Each round takes the smallest label among neighbours, passes it
    on to the node that the label named before (so whole trees are hooked on, not only their borders), and then takes the
    label of that label, until nothing changes: some log2(n) rounds, also on chains with ids in no order. Tables are read back
    from storage in each round, so hot nodes are split by the adaptive skew join and lost executors repeat one round only."""
    # Stored before it's used twice: edges may come out differently when a lost task is run again, and both directions of
    # each are needed.
    both = stored(edges.filter("a != b").select("a", "b"), "one-way")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        with recorded() as made:
            step = _round(both, labels)
            release(edges.sparkSession, made, *([step] if step is not None else []))
        if step is None:
            return labels
        labels = step


def _round(both: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The labels after one round, None if nothing changes."""
    near = both.join(labels, both["a"] == labels["id"]).groupBy("b").agg(F.min("label").alias("m"))
    step = stored(labels.join(near, labels["id"] == near["b"], "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
    lower = step.filter("label < old")
    if lower.limit(1).count() == 0:
        return None
    hooks = lower.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("h"))
    step = stored(step.join(hooks, step["id"] == hooks["root"], "left").select("id", F.least("label", "h").alias("label")), "labels")
    up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
    return stored(step.join(up, "label").select("id", F.col("up").alias("label")), "labels")
