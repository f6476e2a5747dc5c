"""Views over the given tables that stand for pitch frames, notes, samples and the like, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).cast("int").alias("idx"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(80 + F.col("value")).alias("f0"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("conf"),
        (F.lit(-60.0) + F.pmod(F.col("event_id") * 13, F.lit(60))).alias("rms_db"), (F.col("value") / 100).alias("flux"),
        (F.pmod(F.col("event_id") * 31, F.lit(100)).cast("double") / 100).alias("hf"), "ts",
    )


FRAMES = """frames AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE 80 + value END AS f0, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS conf,
  CAST(-60 AS DOUBLE) + (event_id * 13) % 60 AS rms_db, value / 100 AS flux, CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS hf, ts FROM events)"""


def notes(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    t = table(spark, sf_dir, "lineitem").withColumn("note_no", F.row_number().over(w))
    start = F.lit(0.25) * F.col("note_no")
    return t.select(
        F.col("l_suppkey").alias("track_id"), "note_no", start.alias("start"), (start + F.col("l_quantity") / 200).alias("end"),
        (48 + F.pmod("l_partkey", F.lit(25))).cast("int").alias("pitch"), "l_orderkey", "l_partkey",
    )


NOTES = """notes AS (SELECT l_suppkey AS track_id, note_no, CAST(0.25 AS DOUBLE) * note_no AS "start", CAST(0.25 AS DOUBLE) * note_no + l_quantity / 200 AS "end",
  CAST(48 + l_partkey % 25 AS INTEGER) AS pitch, l_orderkey, l_partkey
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS note_no FROM lineitem))"""


def est_notes(spark, sf_dir) -> DataFrame:
    """Estimates of most notes, some of them found twice."""
    n = notes(spark, sf_dir).filter(F.pmod("l_orderkey", F.lit(10)) != 3)
    twice = n.filter(F.pmod("l_orderkey", F.lit(4)) == 1)
    shift = (F.pmod("l_orderkey", F.lit(9)) - 4) * F.lit(0.02)
    out = lambda t, no, late: t.select(
        "track_id", (F.col("note_no") + no).alias("note_no"), (F.col("start") + shift + late).alias("start"), (F.col("end") + shift + late).alias("end"),
        (F.col("pitch") + F.when(F.pmod("l_partkey", F.lit(7)) == 0, 1).otherwise(0)).alias("pitch"),
    )
    return out(n, 0, F.lit(0.0)).unionByName(out(twice, 1_000_000, F.lit(0.02)))


EST = """est AS (SELECT track_id, note_no + c * 1000000 AS note_no, "start" + (l_orderkey % 9 - 4) * CAST(0.02 AS DOUBLE) + c * CAST(0.02 AS DOUBLE) AS "start", "end" + (l_orderkey % 9 - 4) * CAST(0.02 AS DOUBLE) + c * CAST(0.02 AS DOUBLE) AS "end",
  pitch + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS pitch FROM notes, (VALUES (0), (1)) AS v(c) WHERE l_orderkey % 10 <> 3 AND (c = 0 OR l_orderkey % 4 = 1))"""


def samples(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("clip"), F.col("l_linenumber").alias("member"), (F.row_number().over(w) - 1).cast("int").alias("pos"), ((F.col("l_discount") - 0.05) * 20).alias("x")
    )


def keyed(t: DataFrame) -> DataFrame:
    """(clip, member) as one number in clip, for operators that take one key."""
    return t.withColumn("clip", (F.col("clip") * 1000 + F.col("member")).cast("long")).drop("member")


def unkeyed(t: DataFrame) -> DataFrame:
    """clip and member again."""
    others = [c for c in t.columns if c != "clip"]
    return t.select(F.floor(F.col("clip") / 1000).alias("clip"), (F.col("clip") % 1000).cast("int").alias("member"), *others)


SAMPLES = """samples AS (SELECT l_suppkey AS clip, l_linenumber AS member,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS INTEGER) AS pos,
  (l_discount - CAST(0.05 AS DOUBLE)) * 20 AS x FROM lineitem)"""


def folders(spark, sf_dir) -> DataFrame:
    name = F.concat_ws("_", "p_name", F.pmod("p_size", F.lit(120)).cast("string"), F.pmod("p_size", F.lit(5)).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("folder"))


FOLDERS = "folders AS (SELECT p_partkey, p_name || '_' || (p_size % 120) || '_' || (p_size % 5) AS folder FROM part)"
