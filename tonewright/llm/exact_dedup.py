"""Exact deduplication by progressive refinement.

Rows are narrowed in three steps: by length, by prefix hash within a length, by the hash of the full content. Length and
prefix hash are read in one pass into a narrow table of counts; a length held once is also a pair held once, so pairs held
twice or more are what both steps leave. These pairs are marked in a table of CELLS hash cells, a bound that doesn't grow
with the corpus, and full content is hashed only for rows whose cell is marked. Rows that share a cell by chance are told
apart by their full hashes. All grouping is on narrow keys with partial aggregation, so a length or a group of copies of
any size adds one row a map task and key to a shuffle.

Defined results
* null text counts as empty, so null and empty texts are copies of each other;
* of equal texts the largest id stays, null ids rank below all others;
* rows that repeat with the same id and text each say kept, dedup() returns one of them;
* an empty table gives an empty result; extra columns of any name pass through dedup() unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked

#: Characters of the prefix that is hashed in the second step.
PREFIX_CHARS = 256
#: Cells of the table that marks shared pairs; it's broadcast (8 bytes a marked cell, and the hash table around them).
CELLS = 1 << 21
#: The table of groups of copies is broadcast up to this many rows (about 60 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def refine(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, cells: int = CELLS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per row: _id, _text, _row (all columns), digest (SHA-256 hex, null where the row was settled before the last
    step), keep_id, group_size and kept."""
    base = packed(docs, _id=id_col, _text=text_of(text_col)).withColumn("_len", F.octet_length("_text"))
    base = base.withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix_chars)))

    pairs = base.groupBy("_len", "_prefix").agg(F.count("*").alias("n")).filter("n > 1")
    cell = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(cells))
    marked = stored(pairs.select(cell.alias("_cell")).distinct(), "dedup-cells").withColumn("_shared", F.lit(True))

    hashed = base.withColumn("_cell", cell).join(F.broadcast(marked), "_cell", "left").drop("_cell")  # at most cells rows
    hashed = hashed.withColumn("digest", F.when(F.col("_shared"), F.sha2(F.col("_text"), 256)))
    groups = hashed.filter("digest is not null").groupBy("digest").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stored(groups.withColumnRenamed("digest", "_digest"), "dedup-groups")
    groups = F.broadcast(groups) if groups.limit(broadcast_rows + 1).count() <= broadcast_rows else groups

    alone = hashed.filter("digest is null").withColumns({"_keep": F.lit(None).cast(docs.schema[id_col].dataType), "_n": F.lit(None).cast("long")})
    met = hashed.filter("digest is not null").join(groups, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    both = alone.unionByName(met)
    return both.select(
        "_id", "_text", "_row", "digest",
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: the id under its own name, keep_id, group_size, kept and text_sha256."""
    found = refine(docs, id_col, text_col, **how)
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.coalesce("digest", F.sha2(F.col("_text"), 256)).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of equal texts, its columns as they were."""
    found = refine(docs, id_col, text_col, **how)
    alone = unpacked(found.filter("group_size = 1"), docs.columns)
    first = found.filter("group_size > 1 and kept").select("_id", "digest", "_row").dropDuplicates(["_id", "digest"])
    return alone.unionByName(unpacked(first, docs.columns))


QUERY = "op1_exact_dedup"

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
