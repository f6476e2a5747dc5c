"""The opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, binary_output, divergence, exact_dedup, mixing, ngram_join, packing, quality_rules, secrets, sharding, token_counts, toxicity, warc
from .common import table

#: The operators take the tokenizer's file as a parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark, sf_dir):
    return token_counts.counted(table(spark, sf_dir, "documents"), PIECES)


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), *quality_rules.COLUMNS)


def op5_warc(spark, sf_dir):
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_best_fit_packing(spark, sf_dir):
    found = packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = packing.packed_pieces(found)
    return out.select(F.col("_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long"))


def op7_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_binary_output(spark, sf_dir):
    return binary_output.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Similarity(3, 90, 100)).withColumnRenamed("_id", "doc_id")


def op10_sharding(spark, sf_dir):
    return sharding.read_back(table(spark, sf_dir, "documents"))


def op11_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.find(docs, secrets.train(docs)))


def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_toxicity, op3_token_counts, op4_quality_rules, op5_warc,
        op6_best_fit_packing, op7_mixing, op8_binary_output, op9_ngram_join, op10_sharding,
        op11_secrets, op12_tokenizer_alignment, op13_source_divergence,
    )
}
SQL = {m.QUERY: m.SQL for m in (exact_dedup, quality_rules, warc, mixing, ngram_join, sharding, divergence)}
