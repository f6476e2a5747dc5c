"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Where stored() notes the folders that it makes, if anyone wants to know (see recorded()).
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; where that's unset a local session gets a
    folder of its own, and a cluster an error, since each machine would see another one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tonewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def recorded():
    """A list of the scratch folders that are made inside; those still in it at the end are handed on to a recording outside."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer += made


def release(spark: SparkSession, made: list[str], *kept: DataFrame) -> None:
    """Deletes the scratch folders in made, and takes them off it, but for those that the tables kept are read from. Nothing
    else may be read from them later: what was made of them has to be stored by now."""
    used = [f for df in kept for f in df.inputFiles()]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in made if not any(f"/{p.rstrip('/').rpartition('/')[2]}/" in f for f in used)]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        made.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, lost executors recompute nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **named: str | Column) -> DataFrame:
    """The named expressions beside the whole row as one struct, so that no column of df can clash with ours."""
    cols = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    return df.select(*cols, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The original columns from packed(); columns gives their names."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
