"""Nearest neighbours over vectors (vec_id, vec), and indexes of them by speaker that are stored and searched by cell.

An index is a tree of two levels: a speaker's vectors are dealt to some branches, a branch's to its cells. Centres are rows of
tables, a branch's at a time in a task; nothing is collected. Postings are stored in a folder for each speaker and branch, in
order of cell, so that a search reads the folders of the branches that it probes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries, and values of index vectors, in one task: a block of queries meets a block of the index.
QUERY_BLOCK, INDEX_VALUES = 20_000, 4_000_000
#: Queries of a block that are compared with a tile of so many index rows at a time, and pairs whose exact distances are taken.
QUERY_ROWS, TILE_ROWS, PAIRS = 256, 2_000, 100_000
#: Queries of a speaker whose exact neighbours are taken to choose how much is probed, and the share of these neighbours that are
#: to be found in the probed branches, and in the probed cells of all branches.
PROBE_QUERIES, PROBE_RECALL = 256, 0.98
#: A speaker with more vectors than the first is told by so many centres as the second.
COMPRESS_ABOVE, COMPRESS_TO = 200_000, 10_000
#: Vectors a centre that centres are fitted on, taken by hash; a branch has about as many cells as a speaker has branches, four times
#: the fourth root of its vectors, so a task fits a few hundred centres on some ten thousand vectors at any size.
SAMPLE_PER_CENTRE = 64
#: A speaker with so many cells at most has a single branch.
ONE_BRANCH = 64
ROUNDS = 10


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    return frame.sort_values(["q", "d2", "vec_id"]).groupby("q", sort=False).head(k)


def _candidates(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact squared distances of all pairs that may be among the k nearest of a row of x, but for those in
    own: pairs whose distance, less the rounding bound of its quick form, isn't above the k-th smallest with its bound."""
    sums = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d, e = sums - 2 * x @ y.T, sums * (4 * (x.shape[1] + 4) * np.finfo("float64").eps)
    high = d + e
    if own is not None:
        high[own] = np.inf
    last = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if high.shape[1] > k else np.full((len(x), 1), np.inf)
    take = ~(d - e > last)  # NaN stays, and ranks last
    if own is not None:
        take &= ~own
    rows, cols = np.nonzero(take)
    exact = [((x[rows[i : i + PAIRS]] - y[cols[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(rows), PAIRS)]
    return rows, cols, np.concatenate([np.empty(0), *exact])


def nearest_vectors(queries: DataFrame, index: DataFrame, k: int = 8, without_own: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact squared distances to the k nearest of index, ties by id; without_own leaves out the row with the query's own id; with
    by only rows that are equal in these columns meet. Both sides are dealt by hash into blocks of bounded size, and every
    block of queries meets every block of the index, of its own key, in a task of its own, which keeps k rows a query. Neither
    side goes through the driver, and the plan is the same at any size."""
    width = F.max(F.coalesce(F.size("vec"), F.lit(1)))
    if by:
        blocks = queries.groupBy(*by).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_qb"))
        blocks = blocks.join(index.groupBy(*by).agg(F.ceil(F.count("*") * width / INDEX_VALUES).alias("_ib")), list(by))
        queries, index = queries.join(blocks, list(by)), index.join(blocks, list(by))
        q_blocks, i_blocks = F.col("_qb"), F.col("_ib")
    else:
        q_blocks = F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))
        i_blocks = F.lit(index.select(F.greatest(F.ceil(F.count("*") * F.coalesce(width, F.lit(1)) / INDEX_VALUES), F.lit(1))).first()[0])
    block = lambda n: F.pmod(F.xxhash64("vec_id"), n.cast("long"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    # Columns of their own on either side: both may come from one table.
    l_keys, r_keys = [f"_l{i}" for i in range(len(by))], [f"_r{i}" for i in range(len(by))]
    left = queries.select(*[F.col(c).alias(n) for c, n in zip(by, l_keys, strict=True)], F.col("vec_id").alias("q"), F.col("vec").alias("qv"), block(q_blocks).alias("a"), spread(i_blocks).alias("b"))
    right = index.select(*[F.col(c).alias(n) for c, n in zip(by, r_keys, strict=True)], F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec"), block(i_blocks).alias("d"), spread(q_blocks).alias("c"))
    keys = [T.StructField(c, queries.schema[c].dataType) for c in by]
    schema = T.StructType([*keys, T.StructField("q", queries.schema["vec_id"].dataType), T.StructField("vec_id", index.schema["vec_id"].dataType), T.StructField("d2", T.DoubleType())])

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        ids, names = asked["q"].to_numpy(), held["vec_id"].to_numpy()
        y, out = np.stack(held["vec"].to_numpy()).astype("float64"), []
        for at in range(0, len(ids), QUERY_ROWS):
            some, best = ids[at : at + QUERY_ROWS], []
            x = np.stack(asked["qv"].iloc[at : at + QUERY_ROWS].to_numpy()).astype("float64")
            for t in range(0, len(names), TILE_ROWS):
                tile = names[t : t + TILE_ROWS]
                own = some[:, None] == tile[None, :] if without_own else None
                rows, cols, exact = _candidates(x, y[t : t + TILE_ROWS], k, own)
                best.append(_best(pd.DataFrame({"q": some[rows], "vec_id": tile[cols], "d2": exact}), k))
            out.append(_best(pd.concat(best), k))
        return pd.concat(out).assign(**{c: asked[n].iloc[0] for c, n in zip(by, l_keys, strict=True)})[[f.name for f in schema]]

    found = left.groupBy(*l_keys, "a", "b").cogroup(right.groupBy(*r_keys, "c", "d")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(*by, "q").orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def cell_count(n: int) -> int:
    return max(1, min(int(16 * math.sqrt(n)), n // 39))


def _cells_of(n: Column) -> Column:
    """cell_count of a column."""
    return F.greatest(F.lit(1), F.least(F.floor(16 * F.sqrt(n)), F.floor(n / 39))).cast("int")


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the rows of x, at most k, begun at evenly spaced rows; a centre that loses all its rows goes."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1)[None, :] - 2 * x[i : i + TILE_ROWS] @ c.T).argmin(1) for i in range(0, len(x), TILE_ROWS)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = sums[n > 0] / n[n > 0, None]
    return c


def _centres(vectors: DataFrame, plan: DataFrame, by: list[str], name: str) -> DataFrame:
    """k centres for each key of plan (by..., n, k), as (by..., name, centre), from a sample of the key's vectors by hash."""
    share = SAMPLE_PER_CENTRE * F.col("k") / F.col("n")
    taken = vectors.join(plan, by).filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < F.ceil(share * 1_000_000))
    schema = T.StructType([*[vectors.schema[c] for c in by], T.StructField(name, T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        c = k_means(np.stack(g["vec"].to_numpy()).astype("float64"), int(g["k"].iloc[0]))
        return pd.DataFrame({**{b: g[b].iloc[0] for b in by}, name: np.arange(len(c), dtype="int32"), "centre": list(c)})

    found = taken.select(*by, "vec_id", "vec", "k").groupBy(*by).applyInPandas(run, schema)
    # A key of which the sample has no vector is a key of a few: any of its vectors is its centre.
    rest = vectors.join(found.select(*by).distinct(), by, "left_anti").groupBy(*by).agg(F.min_by("vec", "vec_id").cast("array<double>").alias("centre"))
    return found.unionByName(rest.select(*by, F.lit(0).alias(name), "centre"))


def _as_index(centres: DataFrame, name: str) -> DataFrame:
    return centres.withColumnsRenamed({name: "vec_id", "centre": "vec"})


def _means(vectors: DataFrame, by: list[str]) -> DataFrame:
    """The mean of the vectors of each key, as (by..., centre)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    t = vectors.select(*by, array_to_vector(F.col("vec").cast("array<double>")).alias("_f"))
    return t.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("_f"))).alias("centre"))


@dataclass(frozen=True)
class SpeakerIndex:
    """branches (speaker, branch, centre), cells (speaker, branch, cell, centre) and postings (speaker, branch, cell, vec_id, vec)."""

    branches: DataFrame
    cells: DataFrame
    postings: DataFrame


def build_index(vectors: DataFrame, path: str, cells: int | None = None) -> SpeakerIndex:
    """Stores the index of vectors (speaker, vec_id, vec) under path. A speaker has cell_count cells, or as many as given, about as
    many branches as a branch has cells, and each vector is in the cell of its branch whose mean is nearest, after a round in
    which these means were taken over all vectors. All speakers are built in the same jobs."""
    own = vectors.select("speaker", "vec_id", "vec")
    n = own.groupBy("speaker").agg(F.count("*").alias("n"))
    n = n.withColumn("cells", F.lit(cells).cast("int") if cells else _cells_of(F.col("n")))
    plan = n.withColumn("k", F.when(F.col("cells") <= ONE_BRANCH, 1).otherwise(F.ceil(F.sqrt("cells"))).cast("int"))
    _write(_centres(own, plan, ["speaker"], "branch"), f"{path}/branches")
    spark = vectors.sparkSession
    branches = spark.read.parquet(f"{path}/branches")

    at = nearest_vectors(own, _as_index(branches, "branch"), 1, by=("speaker",)).select("speaker", F.col("q").alias("vec_id"), F.col("vec_id").alias("branch"))
    _write(own.join(at, ["speaker", "vec_id"]), f"{path}/dealt")
    dealt, key = spark.read.parquet(f"{path}/dealt"), ["speaker", "branch"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("n_branch")).join(n, "speaker")
    within = sizes.select(*key, F.col("n_branch").alias("n"), F.greatest(F.lit(1), F.rint(F.col("cells") * F.col("n_branch") / F.col("n"))).cast("int").alias("k"))
    _write(_centres(dealt, within, key, "cell"), f"{path}/first-cells")

    def placed(centres: DataFrame) -> DataFrame:
        at = nearest_vectors(dealt, _as_index(centres, "cell"), 1, by=("speaker", "branch"))
        return dealt.join(at.select(*key, F.col("q").alias("vec_id"), F.col("vec_id").alias("cell")), [*key, "vec_id"])

    _write(_means(placed(spark.read.parquet(f"{path}/first-cells")), [*key, "cell"]), f"{path}/cells")
    last = placed(spark.read.parquet(f"{path}/cells")).select(*key, "cell", "vec_id", "vec")
    last.repartitionByRange("speaker", "branch", "cell").sortWithinPartitions("speaker", "branch", "cell", "vec_id").write.partitionBy(*key).parquet(f"{path}/postings")
    return open_index(spark, path, dict(vectors.dtypes)["vec_id"], dict(vectors.dtypes)["vec"])


def _write(t: DataFrame, path: str) -> None:
    t.write.parquet(path)


def open_index(spark: SparkSession, path: str, id_type: str = "long", vec_type: str = "array<double>") -> SpeakerIndex:
    """A stored index; folders of postings are found by their names, read only when a search probes them."""
    branches, cells = spark.read.parquet(f"{path}/branches"), spark.read.parquet(f"{path}/cells")
    speaker = cells.schema["speaker"].dataType.simpleString()
    postings = spark.read.schema(f"cell int, vec_id {id_type}, vec {vec_type}, speaker {speaker}, branch int").parquet(f"{path}/postings")
    return SpeakerIndex(branches, cells, postings)


def probes(queries: DataFrame, index: SpeakerIndex, nprobe: int, nbranch: int) -> DataFrame:
    """(speaker, q, branch, cell) of the nprobe cells nearest to each query (speaker, vec_id, vec), of its speaker's nbranch nearest
    branches: down the tree, a level at a time."""
    at = nearest_vectors(queries, _as_index(index.branches, "branch"), nbranch, by=("speaker",)).select("speaker", F.col("q").alias("vec_id"), F.col("vec_id").alias("branch"))
    below = queries.select("speaker", "vec_id", "vec").join(at, ["speaker", "vec_id"])
    found = nearest_vectors(below, _as_index(index.cells, "cell"), nprobe, by=("speaker", "branch")).drop("rank")
    rank = F.row_number().over(Window.partitionBy("speaker", "q").orderBy("d2", "branch", "vec_id"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= nprobe).select("speaker", "q", "branch", F.col("vec_id").alias("cell"))


def ivf_search(queries: DataFrame, index: SpeakerIndex, k: int = 8, nprobe: int = 1, nbranch: int = 1, prune_rows: int = 1_000_000) -> DataFrame:
    """The k nearest, by exact distances, in the probed cells of each query's speaker. The list of probed cells is broadcast to
    prune folders and rows where it has at most prune_rows rows; beyond that postings are met by a shuffle."""
    asked = probes(queries, index, nprobe, nbranch)
    key = ["speaker", "branch", "cell"]
    needed = asked.filter("cell >= 0").select(*key).distinct()
    needed = F.broadcast(needed) if needed.count() <= prune_rows else needed
    read = index.postings.join(needed, key, "left_semi")
    met = asked.join(queries.select("speaker", F.col("vec_id").alias("q"), "vec"), ["speaker", "q"]).withColumnRenamed("q", "vec_id")
    found = nearest_vectors(met, read, k, by=tuple(key)).drop("rank")
    rank = F.row_number().over(Window.partitionBy("speaker", "q").orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("speaker", "q", "vec_id", "d2", "rank")


def choose_probes(queries: DataFrame, index: SpeakerIndex, k: int = 8, recall: float = PROBE_RECALL, sample: int = PROBE_QUERIES) -> tuple[int, int]:
    """nprobe and nbranch: the least numbers of cells, and of branches, that hold the share recall of the exact k nearest of up
    to sample queries of each speaker (by hash of id). Only these two numbers come to the driver."""
    number = F.row_number().over(Window.partitionBy("speaker").orderBy(F.xxhash64("vec_id"), "vec_id"))
    some = queries.select("speaker", "vec_id", "vec").withColumn("_r", number).filter(F.col("_r") <= sample).drop("_r")
    near = nearest_vectors(some, index.postings, k, by=("speaker",)).select("speaker", "q", "vec_id").join(index.postings.select("speaker", "vec_id", "branch", "cell"), ["speaker", "vec_id"])

    def order(level: DataFrame) -> DataFrame:  # the place of each branch, or cell, among all of the speaker's
        centres = level.withColumn("vec_id", F.struct(*[c for c in ("branch", "cell") if c in level.columns])).select("speaker", "vec_id", "centre")
        met = some.select("speaker", F.col("vec_id").alias("q"), "vec").join(centres, "speaker")
        d2 = F.aggregate(F.zip_with("vec", "centre", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
        return met.select("speaker", "q", "vec_id.*", F.row_number().over(Window.partitionBy("speaker", "q").orderBy(d2, "vec_id")).alias("place"))

    def needed(level: DataFrame, key: list[str]) -> int:
        most = near.join(order(level), ["speaker", "q", *key]).groupBy("speaker").agg(F.percentile("place", F.lit(recall)).alias("p"))
        return math.ceil(most.agg(F.max("p")).first()[0] or 1)

    return needed(index.cells, ["branch", "cell"]), needed(index.branches, ["branch"])


def compress_features(vectors: DataFrame, path: str, above: int = COMPRESS_ABOVE, to: int = COMPRESS_TO, batch: int = 100_000, batches: int = 12) -> DataFrame:
    """vectors (speaker, vec_id, vec) as they are for speakers of at most above; others are told by to centres, whose vec_id is
    their number. Centres begin at vectors chosen by hash, and move by mini-batches: each takes about batch vectors of every
    such speaker, by hash, to their nearest centres, and a centre to the mean of all it has been given so far. Every step is a
    join over all speakers, stored under path. Vectors that have no length or aren't numbers raise no error: a speaker that
    has any stays as it is."""
    plain = vectors.select("speaker", "vec_id", F.col("vec").cast("array<double>").alias("vec"))
    odd = F.max((F.size("vec") < 1) | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = plain.groupBy("speaker").agg(F.count("*").alias("n"), odd.alias("odd"))
    _write(sizes.withColumn("large", (F.col("n") > above) & ~F.coalesce("odd", F.lit(True))), f"{path}/sizes")
    spark = vectors.sparkSession
    sizes = spark.read.parquet(f"{path}/sizes")
    large = sizes.filter("large").select("speaker", "n")
    small = plain.join(large, "speaker", "left_anti")
    if large.limit(1).count() == 0:
        return small
    t = plain.join(large, "speaker").withColumn("_h", F.xxhash64("vec_id", F.lit(11)))
    # The first to vectors in order of hash, found among a few more than that by a bound on the hash.
    share = F.least(F.lit(1.0), (F.lit(to) + 10 * F.sqrt(F.lit(to)) + 10) / F.col("n"))
    first = t.filter((F.col("_h") / 2.0**64 + 0.5) <= share).withColumn("_r", F.row_number().over(Window.partitionBy("speaker").orderBy("_h", "vec_id")))
    _write(first.filter(F.col("_r") <= to).select("speaker", F.col("_r").cast("long").alias("centre_no"), F.col("vec").alias("centre"), F.lit(0).cast("long").alias("had")), f"{path}/centres-0")
    for turn in range(batches):
        centres = spark.read.parquet(f"{path}/centres-{turn}")
        some = t.filter(F.pmod(F.xxhash64("vec_id", F.lit(turn)), F.lit(1 << 30)) < F.lit(1 << 30) * (batch / F.col("n"))).select("speaker", "vec_id", "vec")
        at = nearest_vectors(some, centres.select("speaker", F.col("centre_no").alias("vec_id"), F.col("centre").alias("vec")), 1, by=("speaker",))
        met = some.join(at.select("speaker", F.col("q").alias("vec_id"), F.col("vec_id").alias("centre_no")), ["speaker", "vec_id"])
        got = _means(met, ["speaker", "centre_no"]).join(met.groupBy("speaker", "centre_no").agg(F.count("*").alias("m")), ["speaker", "centre_no"]).withColumnRenamed("centre", "mean")
        moved = F.zip_with("centre", "mean", lambda c, x: c + (x - c) * (F.col("m") / (F.col("m") + F.col("had"))))
        step = centres.join(got, ["speaker", "centre_no"], "left").select("speaker", "centre_no", F.when(F.col("m").isNull(), F.col("centre")).otherwise(moved).alias("centre"), (F.col("had") + F.coalesce("m", F.lit(0))).alias("had"))
        _write(step, f"{path}/centres-{turn + 1}")
    last = spark.read.parquet(f"{path}/centres-{batches}")
    return small.unionByName(last.select("speaker", F.col("centre_no").cast(small.schema["vec_id"].dataType).alias("vec_id"), F.col("centre").alias("vec")))


def knn_blend(neighbours: DataFrame, index: DataFrame, queries: DataFrame, rate: float) -> DataFrame:
    """Each query mixed with the mean of its neighbours, weighted by the squared inverse of their squared distance. A query's few
    neighbours meet as arrays."""
    t = neighbours.join(index.select("vec_id", "vec"), "vec_id").withColumn("w", F.pow(1 / F.greatest(F.col("d2"), F.lit(1e-12)), F.lit(2)))
    t = t.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "vec"))).alias("near"), F.sum("w").alias("total"))
    t = queries.select(F.col("vec_id").alias("q"), F.col("vec").cast("array<double>").alias("own")).join(t, "q", "left")
    mean = lambda i: F.aggregate("near", F.lit(0.0), lambda s, x: s + x["w"] * F.get(x["vec"], i)) / F.col("total")
    mixed = F.transform("own", lambda v, i: rate * F.coalesce(mean(i), v) + (1 - rate) * v)
    return t.select("q", mixed.alias("vec"))
