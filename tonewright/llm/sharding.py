"""Sharding by extendible hashing.

A document belongs to the bucket named by the first bits of its hash. The directory starts from one bucket; a bucket
over the byte limit is split on another bit, and only that one, until every bucket fits. The sums of all prefixes of a
few more bits than the total needs give most of the directory in one pass; rows of buckets that are still too large
go to another pass with more bits. A bucket with one hash value can't be split and may stay over the limit.

Defined results
* null text has no bytes; a null id hashes by the text;
* rows that share an id share a bucket, whatever its size;
* an empty table gives an empty result; extra columns of any name pass through write_shards() unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, scratch_path, stored, text_of
from .mixing import shuffle_hash

LIMIT = 8 << 20
SEED = "shard-1"
BITS = 60
#: Bits of a pass beyond those that equal buckets would need, and of each pass after the first.
MORE_BITS = 4
NEXT_BITS = 8
MAX_FIRST_BITS = 20
#: A part of the directory is broadcast up to this many cells.
BROADCAST_CELLS = 500_000


def directory(sized: DataFrame, limit: int) -> list[tuple[DataFrame, int]]:
    """For each pass, cells (cell, depth, shard_bytes, shard_docs) and their bits: the shard of every hash prefix."""
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(MAX_FIRST_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + MORE_BITS))
    passes, rows, low = [], sized, 0
    while True:
        cells = rows.groupBy(F.shiftright("_h", BITS - bits).alias("cell")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"), F.min("_h").alias("a"), F.max("_h").alias("z"))
        cells = stored(cells, "cells")
        each = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        each = each.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = each.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("a").alias("a"), F.max("z").alias("z"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("a") == F.col("z"))).drop("a", "z")
        leaf = each.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("x"))
        leaf = stored(leaf.select("cell", "x.*"), "directory")
        passes.append((leaf, bits))
        open_ = cells.join(leaf, "cell", "left_anti").select("cell")
        if bits == BITS or open_.limit(1).count() == 0:
            return passes
        open_ = stored(open_, "open-cells")
        rows = stored(rows.withColumn("cell", F.shiftright("_h", BITS - bits)).join(open_, "cell", "left_semi").drop("cell"), "oversized")
        low, bits = bits + 1, min(BITS, bits + NEXT_BITS)


def assigned(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, _row, n_bytes, depth, prefix (the shard's name as a number of depth bits), shard_bytes, shard_docs."""
    text = text_of(text_col)
    full = packed(docs, _id=id_col, _bytes=F.octet_length(text).cast("long"), _h=shuffle_hash(F.col(f"`{id_col}`"), text, SEED))
    rows = None
    left = full
    for leaf, bits in directory(stored(full.select("_h", "_bytes"), "sizes"), limit):
        known = F.broadcast(leaf) if leaf.count() <= BROADCAST_CELLS else leaf
        at = left.withColumn("cell", F.shiftright("_h", BITS - bits))
        met = at.join(known, "cell").drop("cell")
        rows = met if rows is None else rows.unionByName(met)
        left = at.join(known, "cell", "left_anti").drop("cell")
    prefix = F.expr(f"shiftright(_h, {BITS} - depth)")
    return rows.select("_id", "_row", F.col("_bytes").alias("n_bytes"), "depth", prefix.alias("prefix"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs with a folder of Parquet files for each shard and returns what was written: shard and _row."""
    t = assigned(docs, limit, id_col, text_col)
    name = F.concat_ws("-", F.col("depth"), F.lpad(F.bin("prefix"), F.greatest(F.col("depth"), F.lit(1)), F.lit("0")))
    t = t.select("_row", name.alias("shard")).repartition("shard")  # a shard has at most limit bytes
    t.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(t.schema).parquet(folder)


def read_back(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards, and gives per row read from them its id, n_bytes, depth and prefix of its shard, and the shard's
    bytes and documents as they were found in it."""
    back = write_shards(docs, scratch_path(docs.sparkSession, "shards"), limit, id_col, text_col)
    text = F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit(""))
    rows = back.select(F.col("_row").getField(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), "shard")
    found = stored(rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")), "shards-found")
    found = F.broadcast(found) if found.count() <= BROADCAST_CELLS else found
    part = lambda k: F.split_part("shard", F.lit("-"), F.lit(k))
    prefix = F.conv(part(2), 2, 10).cast("long")
    return rows.join(found, "shard").select(id_col, "n_bytes", part(1).cast("int").alias("depth"), prefix.alias("prefix"), "shard_bytes", "shard_docs")


QUERY = "op10_sharding"

SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT d.*, CAST(k AS INTEGER) AS depth, h >> CAST({BITS} - k AS INTEGER) AS prefix FROM d, range(0, {BITS + 1}) AS t(k)),
b AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM l GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR min(h) = max(h)),
r AS (SELECT doc_id, min(l.depth) AS depth FROM l JOIN b ON b.depth = l.depth AND b.prefix = l.prefix GROUP BY doc_id)
SELECT l.doc_id, l.n_bytes, l.depth, l.prefix, b.shard_bytes, b.shard_docs
FROM r JOIN l ON l.doc_id = r.doc_id AND l.depth = r.depth JOIN b ON b.depth = l.depth AND b.prefix = l.prefix
"""
