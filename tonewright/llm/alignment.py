"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids ends together.

The first tokenizer is byte-level and reads a blank and the text, the second is a sentencepiece file that adds the blank
itself. Tokens are byte ranges. Every token points to the farthest-right token of the other kind that overlaps it, if that
reaches beyond it, or else to the one that ends with it; the last token of a group, of the second kind, points to itself.
Doubling the pointers of a whole block of texts at once takes every token to the last one of its group, in about log2 of
the longest chain of overlaps rounds, and that token is the group's label.

A block of texts becomes one row: figures and hashes of its documents, the distinct pairs of ids that end together with how
often they do, and for each link the place of its pair in that list. Pairs are counted over all blocks by a shuffle of these
lists, whose hot pairs have a row for each block and not for each link, and the counts go back to the block's row by
its number. Nothing is broadcast, and nothing passes through the driver.

Defined results
* null and empty texts have no tokens: zeros and an empty groups_sha256; so have texts whose tokens' bytes don't give the
  text back, such as one with the second tokenizer's blank mark in it, and their links aren't counted;
* rows that repeat are documents of their own, an empty table gives an empty result; null ids stay null;
* a text of any length is aligned whole, one over BLOCK bytes in a block of its own; other columns aren't carried along.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, recorded, release, stored, text_of
from .encoding import _byte_letters, _gather, encoder, piece_encoder

#: Bytes of text that are aligned together.
BLOCK = 1_000_000
MARK = "▁"


@dataclass(frozen=True)
class Bytes:
    """The bytes of every id of a vocabulary, one after another, and where each begins."""

    flat: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Bytes:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, tokens)))]).astype("int32"))

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and where each begins; the last number is the end."""
        return _gather(self.flat, self.at, ids.astype("int64"))


def byte_level(tokenizer) -> Bytes:
    raw = {ord(c): b for b, c in enumerate(_byte_letters())}
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return Bytes.of([x.translate(raw).encode("latin-1") if all(ord(c) in raw for c in x) else x.encode() for x in tokens])


def pieces(model) -> Bytes:
    every = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return Bytes.of([bytes([int(p[3:-1], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in every])


@functools.cache
def _tables(a_path: str, b_path: str):
    """Both encoders and their bytes, and the decimals of ids with what may follow: a comma in a group, a bar after the first
    tokenizer's part and a semicolon after the second's."""
    a, b = encoder(a_path), piece_encoder(b_path)
    a_bytes, b_bytes = byte_level(a.tokenizer), pieces(b.model)
    written = [f"{i}{x}" for n, end in ((len(a_bytes.at) - 1, "|"), (len(b_bytes.at) - 1, ";")) for i in range(n) for x in (",", end)]
    return a, b, a_bytes, b_bytes, pa.array(written, pa.large_string())


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of either kind the token of the second kind that its group ends with, by pointer jumping; and for each of
    the second kind the first one of the first kind that reaches its end. Ends are ascending, the last ones are equal."""
    n = len(a_ends)
    of_a, of_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    to = np.concatenate([n + of_a, np.where(a_ends[of_b] > b_ends, of_b, n + np.arange(len(b_ends)))])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n, of_b
        to = further


def align_block(texts: pa.Array, a_path: str, b_path: str) -> dict:
    """n_a, n_b, n_groups and groups_sha256 of each text, and the id pairs (a << 32 | b) of all links in order."""
    a, b, a_bytes, b_bytes, written = _tables(a_path, b_path)
    spaced = pc.binary_join_element_wise("", texts, " ")
    (a_ids, a_at), (b_ids, b_at) = a.encode_column(spaced), b.encode_column(texts)
    whole, sizes = np.frombuffer(spaced.cast(pa.large_string()).buffers()[2] or b"", np.uint8), pc.binary_length(spaced).to_numpy(zero_copy_only=False)
    given = np.concatenate([[0], np.cumsum(sizes)])
    (a_flat, a_upto), (b_flat, b_upto) = a_bytes.joined(a_ids), b_bytes.joined(b_ids)

    def same(flat, upto, at, k):
        return np.array_equal(flat[upto[at[k]] : upto[at[k + 1]]], whole[given[k] : given[k + 1]])

    good = np.array([s > 1 and same(a_flat, a_upto, a_at, k) and same(b_flat, b_upto, b_at, k) for k, s in enumerate(sizes)], bool)

    def left(ids, at, upto):  # ids and ends of the good texts, ends counted over these texts alone
        keep, n = np.repeat(good, np.diff(at)), np.where(good, np.diff(at), 0)
        return ids[keep], np.cumsum(np.diff(upto)[keep].astype("int64")), np.concatenate([[0], np.cumsum(n)])

    (a_ids, a_ends, a_at), (b_ids, b_ends, b_at) = left(a_ids, a_at, a_upto), left(b_ids, b_at, b_upto)
    n = len(texts)
    if not len(b_ids):
        return {"n_a": np.zeros(n, "int64"), "n_b": np.zeros(n, "int64"), "n_groups": np.zeros(n, "int64"), "groups_sha256": [""] * n, "pairs": np.empty(0, "int64")}
    a_label, b_label, first = labels(a_ends, b_ends)
    last = np.flatnonzero(b_label == np.arange(len(b_ids)))  # of each group
    number = np.zeros(len(b_ids), "int64")
    number[last] = np.arange(len(last))
    a_group, b_group = number[a_label], number[b_label]
    a_last = first[last]  # it ends where the group ends
    # In the order of writing a group's second part comes after its first.
    b_before, a_upto = np.concatenate([[0], last[:-1] + 1]), a_last + 1
    code = np.empty(len(a_ids) + len(b_ids), "int64")
    code[np.arange(len(a_ids)) + b_before[a_group]] = 2 * a_ids.astype("int64") + (np.arange(len(a_ids)) == a_last[a_group])
    code[np.arange(len(b_ids)) + a_upto[b_group]] = 2 * (len(a_bytes.at) - 1 + b_ids.astype("int64")) + (np.arange(len(b_ids)) == b_label)
    lists = pa.LargeListArray.from_arrays(pa.array(a_at + b_at), written.take(pa.array(code)))
    texts_of = pc.binary_join(lists, pa.scalar("", pa.large_string()))
    groups = np.concatenate([[0], np.cumsum(b_label == np.arange(len(b_ids)))])[b_at]
    return {
        "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(groups),
        "groups_sha256": [hashlib.sha256(x.as_py()[:-1].encode()).hexdigest() if ok else "" for x, ok in zip(texts_of, good, strict=True)],
        "pairs": a_ids[a_last].astype("int64") << 32 | b_ids[last].astype("int64"),
    }


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of texts: block, ids, n_a, n_b, n_groups and groups_sha256 of its documents, the distinct pairs and
    their times, and links, the place of each link's pair (unsigned 32-bit, compressed)."""
    t = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row")
    lists = [("ids", t.schema["_id"].dataType), *[(c, T.IntegerType()) for c in ("n_a", "n_b", "n_groups")], ("groups_sha256", T.StringType()), ("pairs", T.LongType()), ("times", T.IntegerType())]
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(k)) for n, k in lists], T.StructField("links", T.BinaryType())])

    def run(batches):
        count = itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))])
            k = 0
            while k < b.num_rows:
                z = max(k + 1, int(np.searchsorted(upto, upto[k] + BLOCK, "right")) - 1)
                got = align_block(b.column(1).slice(k, z - k), a_path, b_path)
                pairs, links, times = np.unique(got["pairs"], return_inverse=True, return_counts=True)
                cols = [b.column(0).slice(k, z - k), *[pa.array(got[c].astype("int32")) for c in ("n_a", "n_b", "n_groups")], pa.array(got["groups_sha256"], pa.string()), pa.array(pairs), pa.array(times.astype("int32"))]
                small = pa.compress(links.astype("<u4").tobytes(), "zstd", asbytes=True)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([pa.array([next(count)], pa.int64()), *map(one, cols), pa.array([small], pa.binary())], names=schema.names)
                k = z

    return t.mapInArrow(run, schema)


def pair_counts(entries: DataFrame) -> DataFrame:
    """a, b, pair, n (links with the pair) and best (no pair with this b has more), from rows pair, times."""
    n = entries.groupBy("pair").agg(F.sum("times").cast("long").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    n = stored(n.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    return n.join(n.groupBy("b").agg(F.max("n").alias("top")), "b").select("a", "b", "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id under its own name, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    with recorded() as made:
        whole = stored(blocks(docs, a_path, b_path, id_col, text_col), "aligned")
        entries = whole.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("block", "at", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
        known = pair_counts(entries).select("pair", "n", "best")
        back = entries.join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("known"))
        out = stored(_figures(whole.drop("pairs", "times").join(back, "block", "left"), id_col), "alignment")
        release(docs.sparkSession, made, out)
    return out


def _figures(whole: DataFrame, id_col: str) -> DataFrame:
    """The documents of blocks that come with known, the counts of their pairs."""
    kind = whole.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = {c: batch.column(c)[k].values for c in batch.schema.names if c not in ("block", "known", "links")}
                n_groups = b["n_groups"].to_numpy()
                links = np.frombuffer(pa.decompress(batch.column("links")[k].as_py(), int(n_groups.sum(dtype="int64")) * 4, "zstd", asbytes=True), "<u4")
                known = batch.column("known")[k].values
                size = len(known) if known is not None else 0
                n, best = np.zeros(size, "int64"), np.zeros(size, bool)
                if size:
                    at = known.field("at").to_numpy()
                    n[at], best[at] = known.field("n").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(n_groups)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links], dtype="int64")])[ends])  # noqa: B023, E731
                figures = [b["n_a"], b["n_b"], b["n_groups"], b["n_groups"], pa.array(total(best)), pa.array(total(n))]
                yield pa.RecordBatch.from_arrays([b["ids"], *[x.cast(pa.int64()) for x in figures], b["groups_sha256"]], names=schema.names)

    return whole.mapInArrow(run, schema)


QUERY = "op12_tokenizer_alignment"
