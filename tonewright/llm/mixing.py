"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of the document id. A document's virtual finish time is the number of its source's
words up to and including it, divided by the source's target; a second copy follows when the source has been through
once. All copies sorted by finish time, cut at the total budget, are the mix: each source gets words in proportion to
its target at any moment. Running sums are made in two levels, over hash buckets of a source and within a bucket, so a
source that holds most rows is spread over as many tasks as its rows need. The cut is one tuple.

Defined results
* null text has no words; null is a source of its own, the last;
* a source without words has target 0 and nothing taken;
* documents of a source are ordered by hash, id, size and a hash of the text; a null id hashes by the text. Rows that
  repeat count as documents of their own, equal ones can stand for each other; ties in finish time are broken by hash, id
  and copy;
* an empty table gives an empty result; extra columns of any name pass through mixed() unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Of all words; a source is read at most MAX_COPIES times.
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
#: Rows of a source that are sorted together: few, so that a hot source is dealt evenly over tasks.
BUCKET_ROWS = 500
#: Ranges of finish times whose sums go to the driver at a time.
RANGES = 1_000
#: A table of sources is broadcast up to this many rows.
BROADCAST_SOURCES = 100_000


def shuffle_hash(id_col: Column, text: Column, seed: str) -> Column:
    """60 bits of MD5 of the id as a long: other engines can compute it too. Rows without an id are spread by their text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.md5(text)))), 1, 15), 16, 10).cast("long")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    src = F.col(f"`{source_col}`").cast("string")
    text = text_of(text_col)
    t = packed(docs, _id=id_col, _src=src, _size=word_count(text), _h=shuffle_hash(F.col(f"`{id_col}`"), text, SEED), _tie=F.xxhash64(text))
    return t.withColumn("_key", F.when(F.col("_src").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_src"))))


def targets(base: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """_key, source_size, n_docs and target of each source. Targets are min(cap, weight * level) with the level that
    makes them add up to the budget, which is where resharing the excess by weight ends."""
    s = base.groupBy("_key", "_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_docs"))
    one = Window.partitionBy(F.lit(0))  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("_rank", F.row_number().over(one.orderBy(F.col("_src").asc_nulls_last())))
    s = s.withColumns({"_w": F.element_at(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1), "_cap": (max_copies * F.col("source_size")).cast("double")})
    s = s.withColumns({"_budget": F.lit(share) * F.sum("source_size").over(one), "_all_w": F.sum("_w").over(one)})
    before = one.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    s = s.withColumn("_level", (F.col("_budget") - F.col("_cap_before")) / (F.col("_all_w") - F.col("_w_before")))
    s = s.withColumn("_lambda", F.min(F.when(F.col("_w") * F.col("_level") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(one)["_level"])
    level = F.col("_w") * F.col("_lambda")
    target = F.when(F.col("_lambda").isNull() | (level >= F.col("_cap")), F.col("_cap")).otherwise(level)
    return s.select("_key", "source_size", "n_docs", target.alias("target"))


def scheduled(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES, bucket_rows=BUCKET_ROWS, whole_rows=False):
    """The documents with their source's figures and _before, the words of the source ahead of them, and the cut: the
    largest (finish, hash, id, copy) that the budget has room for, or None. Words are counted once, into a narrow table;
    whole_rows carries _row along for those who need the documents themselves."""
    full = _base(docs, id_col, text_col, source_col)
    base = narrow = stored(full.drop("_row"), "mix-sizes")
    src = stored(targets(base, weights, share, max_copies), "mix-sources")
    facts = src.agg(F.count("*").alias("k"), F.max("n_docs").alias("n"), F.sum("source_size").alias("size")).first()
    bits = max(4, min(30, math.ceil(math.log2(max(1, (facts["n"] or 0) / bucket_rows)))))
    known = F.broadcast(src) if facts["k"] <= BROADCAST_SOURCES else src
    placed = lambda t: t.withColumn("_bucket", F.shiftright("_h", 60 - bits)).join(known, "_key")
    base = placed(narrow)
    sums = base.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_s"))
    upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("_key", "_bucket", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_ahead")), "mix-buckets")
    within = Window.partitionBy("_key", "_bucket").orderBy("_h", "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = lambda t: t.join(sums, ["_key", "_bucket"]).withColumn("_before", F.col("_ahead") + F.sum("_size").over(within) - F.col("_size"))
    rows = stored(ahead(base), "mix-plan")
    budget = math.floor(share * (facts["size"] or 0))
    cut = _cut(rows, budget, max_copies, bucket_rows)
    return (ahead(placed(full)) if whole_rows else rows), cut


def finish(copy: int) -> Column:
    done = F.col("_before") + F.col("_size") + copy * F.col("source_size")
    return F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))


def _cut(rows: DataFrame, budget: int, max_copies: int, bucket_rows: int):
    """Sums over ranges of the finish time find the range that the budget ends in. It's divided again until its rows are
    few enough to sort in one task, or share one finish time."""
    copies = F.explode(F.array(*[F.struct(finish(c).alias("f"), F.lit(c).alias("c")) for c in range(max_copies)]))
    inside = rows.select("_h", "_id", "_size", copies.alias("_x")).select(F.col("_x.f").alias("f"), "_h", "_id", F.col("_x.c").alias("c"), "_size")
    low, high, ahead = 0.0, float(max_copies + 1), 0
    while True:
        at = F.least(F.floor((F.col("f") - low) / (high - low) * RANGES), F.lit(RANGES)).cast("long")
        sums = inside.groupBy(at.alias("r")).agg(F.sum("_size").alias("s"), F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("z")).orderBy("r").collect()  # RANGES + 1 rows
        last = None
        for row in sums:
            if ahead > budget:
                break
            last, before, ahead = row, ahead, ahead + row["s"]
        if last is None:
            return None
        inside, ahead = inside.filter(at == last["r"]), before
        if last["n"] <= bucket_rows or last["a"] == last["z"]:
            break
        low, high = last["a"], last["z"]
    upto = Window.partitionBy(F.lit(0)).orderBy("f", "_h", "_id", "c").rowsBetween(Window.unboundedPreceding, 0)
    if last["a"] == last["z"] and last["n"] > bucket_rows:  # only sizes of 0 share a finish time within a source: a row or two a source has a size
        sized = inside.filter("_size > 0").withColumn("total", F.sum("_size").over(upto) + ahead)
        over = sized.filter(F.col("total") > budget).agg(F.min(F.struct("f", "_h", "_id", "c")).alias("x")).first()["x"]
        taken = inside if over is None else inside.filter(F.struct("f", "_h", "_id", "c") < F.struct(*[F.lit(v).cast(k) for v, (_, k) in zip(over, inside.select("f", "_h", "_id", "c").dtypes, strict=True)]))
    else:
        taken = inside.withColumn("total", F.sum("_size").over(upto) + ahead).filter(F.col("total") <= budget)
    top = taken.agg(F.max(F.struct("f", "_h", "_id", "c")).alias("x")).first()["x"]
    return top if top is not None else (last["a"], -1, None, -1)  # nothing of this range


def within_cut(cut, copy: int) -> Column:
    if cut is None:
        return F.lit(False)
    f, h, i, c = cut
    here, at, key = finish(copy), F.col("_h"), F.col("_id")
    same_id = key.eqNullSafe(F.lit(i))
    before_id = key.isNull() & F.lit(i is not None) | F.coalesce(key < F.lit(i), F.lit(False))
    return (here < f) | (here == f) & ((at < h) | (at == h) & (before_id | same_id & F.lit(copy <= c)))


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", max_copies=MAX_COPIES, **how) -> DataFrame:
    """_id, size, source_size, target, copies (a list) and taken, the words that the mix takes; _row with whole_rows."""
    rows, cut = scheduled(docs, id_col, text_col, source_col, max_copies=max_copies, **how)
    copies = F.filter(F.array(*[F.when(within_cut(cut, c), F.struct(F.lit(c).alias("copy"), finish(c).alias("finish"))) for c in range(max_copies)]), lambda x: x.isNotNull())
    rows = rows.withColumn("copies", copies)
    return rows.select("_id", "_h", *(["_row"] if "_row" in rows.columns else []), F.col("_size").alias("size"), "source_size", "target", "copies", (F.size("copies") * F.col("_size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mix in its order: a row of docs for each copy taken, range-sorted by finish time."""
    rows = plan(docs, id_col, text_col, source_col, whole_rows=True, **how).select("_h", "_id", "_row", F.explode("copies").alias("_c"))
    key = [F.col("_c.finish"), F.col("_h"), F.col("_id")]
    return unpacked(rows.repartitionByRange(*key).sortWithinPartitions(*key), docs.columns)


QUERY = "op7_mixing"

SQL = """
WITH d AS (SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src NULLS LAST) AS rk FROM d GROUP BY src),
s1 AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[CAST((rk - 1) % 3 + 1 AS BIGINT)] AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM s1
  WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (budget - cap_before) / (all_w - w_before) AS lvl FROM s2),
lam AS (SELECT first(lvl ORDER BY cap / w, rk) AS l FROM s3 WHERE w * lvl <= cap),
s AS (SELECT src, source_size, CASE WHEN l IS NULL OR w * l >= cap THEN cap ELSE w * l END AS target FROM s3 LEFT JOIN lam ON true),
r AS (SELECT d.*, s.source_size, s.target, CAST(sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
c AS (SELECT doc_id, h, size, c, CASE WHEN target > 0 THEN CAST(upto + c * source_size AS DOUBLE) / target ELSE 0 END AS f FROM r, (VALUES (0), (1)) AS v(c)),
g AS (SELECT *, sum(size) OVER (ORDER BY f, h, doc_id, c ROWS UNBOUNDED PRECEDING) AS total FROM c),
t AS (SELECT doc_id, CAST(sum(CASE WHEN total <= (SELECT floor(1.5 * sum(size)) FROM d) THEN size ELSE 0 END) AS BIGINT) AS taken FROM g GROUP BY doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, t.taken FROM r JOIN t USING (doc_id)
"""
