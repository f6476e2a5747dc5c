"""From raw documents to packed sequences: five operators, each run on what the one before it kept.

Each stage takes (spark, docs, sf_dir). For a null text all of them count it as empty; tables without rows give tables
without rows; columns of docs that a stage doesn't use pass through it, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from tonewright.llm.common import recorded, release, scratch_path, table
from tonewright.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, those without words among them. Repeated rows are judged one by one."""
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one of them if it's there several times; null ids rank below."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle and a similarity of 0.8; the smallest doc_id of each class stays, with all its rows, as do rows
    without an id or without words."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order. A document that it takes twice is two rows, equal in all columns; a null source is the last one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its ids and its place. Rows that are equal are packed as often as they occur, each
    piece of them in a place of its own; which of the equal rows is where makes no difference to the result."""
    out = packing.pack(docs, WORD_BPE)
    return out.select(F.col("_id").alias("doc_id"), "piece", "start", "length", "ids", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Tokenising has no SQL form; tests/llm/test_pipeline.py runs the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. When a stage's result is written, what it and its input were read from is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with recorded() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
            release(spark, made)
        release(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
