"""Quantiles, and positions in an order, of tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(value: str | Column, p: float, accuracy: int | None = None) -> Column:
    """The quantile p, exact and on straight lines between values: a group keeps all its values. With accuracy a mergeable sketch of
    bounded size stands for them, and gives a value whose rank is off by one in accuracy of the group's size at most."""
    return F.percentile(value, F.lit(p)) if accuracy is None else F.percentile_approx((F.col(value) if isinstance(value, str) else value).cast("double"), p, accuracy)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: what the product and the sum lose is added at the end."""

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * 134217729.0
        return big - (big - x), x - (big - (big - x))

    (ah, al), (bh, bl), product = halves(a), halves(b), a * b
    total = product + c
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    back = total - product
    out = total + (lost + ((product - (total - back)) + (c - back)))
    return F.when(F.isnan(out), total).otherwise(out)  # infinite values have no parts


def fused_quantile(values: Column, p: float) -> Column:
    """The quantile p of an array, rounded as quantile_cont of the SQL twins is: where it's cut by floor(), the last bit tells."""
    v, at = F.array_sort(values), (F.size(values) - 1) * F.lit(p)
    k = F.floor(at).cast("int")
    part = at - k
    low, high = F.get(v, k).cast("double"), F.get(v, F.least(k + 1, F.size(values) - 1)).cast("double")
    return F.when(part == 0, low).otherwise(_fused(low, 1 - part, high * part))


def shuffle_key(*parts: str | Column, seed: int) -> Column:
    """A text that rows are shuffled by: the MD5 of the parts and the seed."""
    return F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(str(seed))))


def shuffled_places(rows: DataFrame, key: str, seed: int, by: tuple[str, ...] = (), name: str = "place", digits: int = 2) -> DataFrame:
    """rows with their place, from 0, in the order of shuffle_key(key), then key, among the rows that are equal in by; and size, how
    many these are. Places are made in two levels, over the first digits of the key and within them, so that no group of rows is
    sorted in one task."""
    t = rows.withColumn("_h", shuffle_key(key, seed=seed)).withColumn("_s", F.substring("_h", 1, digits))
    counts = t.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** digits rows
    every = Window.partitionBy(*by, *([] if by else [F.lit(0)]))
    counts = counts.select(*by, "_s", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"), F.sum("_n").over(every).alias("size"))
    nth = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h", key)) - 1
    return t.withColumn("_nth", nth).join(counts, [*by, "_s"]).withColumn(name, F.col("_nth") + F.col("_base")).drop("_h", "_s", "_nth", "_base")


def slot_places(rows: DataFrame, slot: str, *order: str | Column, by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of slot and within it of order, among the rows that are equal in by. Only rows of
    one slot are sorted together; what is summed up over slots is a row for each."""
    counts = rows.groupBy(*by, slot).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in (*by, slot)], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    t = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, slot).orderBy(*order)) - 1)
    on = [t[c].eqNullSafe(counts[f"_by_{c}"]) for c in (*by, slot)]
    return t.join(counts, on).withColumn(name, F.col("_nth") + F.col("_base")).select(*rows.columns, name)


def ordered_places(rows: DataFrame, key: str, cuts: int = 1000, name: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """rows and their place, from 0, in order of key, nulls first, among the rows that are equal in by. Ranges between cuts, a bounded
    number of keys that are taken by hash, are counted and numbered one by one."""
    found = sorted({r[0] for r in rows.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(cuts).collect()})
    t = rows.withColumn("_s", F.size(F.filter(F.array(*map(F.lit, found)), lambda c: c <= F.coalesce(F.col(key), c))) if found else F.lit(0))
    t = t.withColumn("_s", F.when(F.col(key).isNull(), -1).otherwise(F.col("_s")))
    return slot_places(t, "_s", key, by=by, name=name).drop("_s")
