"""Token ids as flat binary files.

A part is three flat little-endian files: NAME.bin with the ids of its documents one after another (16 bits where the
vocabulary allows, else 32), NAME.off with the 64-bit offset of each document and of the end, and NAME.doc with the
64-bit document ids. Documents are in ascending order of id over all parts; a manifest holds each part's base, the
ids in all parts before it, from prefix sums of the counts. Tasks write under a name of their attempt and rename at the
end, so a lost executor's part is simply written again. Reading maps files of a local or mounted folder into memory.

Defined results
* null text counts as empty: the end token alone;
* null document ids come first and are read back as null;
* rows that repeat are written as often as they occur, an empty table gives no part;
* columns other than the id and the text aren't written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, scratch_path, stored, text_of
from .encoding import encoder, with_end

END_ID = 2


def _store(uri: str):
    """A file system and a path in it: pyarrow's, for file://, hdfs://, s3:// or gs://."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs under folder and returns the manifest: part, n_docs, n_null (documents without an id), n_tokens,
    width (bytes an id) and base."""
    t = packed(docs, _id=F.col(f"`{id_col}`").cast("long"), _text=text_of(text_col)).drop("_row")
    t = t.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")

    def put(batches):
        task, enc = TaskContext.get(), encoder(tokenizer)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        name, own = f"part-{task.partitionId():06d}", f".{task.taskAttemptId()}.tmp"
        where, root = _store(folder)
        where.create_dir(root, recursive=True)
        offsets, ids, nulls, total, out = [np.zeros(1, "int64")], [], 0, 0, None
        for b in batches:
            if out is None:
                out = where.open_output_stream(f"{root}/{name}.bin{own}")
            found, at = with_end(*enc.encode_column(b.column(1)), end_id)
            out.write(found.astype(f"<u{width}").tobytes())
            offsets.append(at[1:] + total)
            total += len(found)
            nulls += b.column(0).null_count
            ids.append(b.column(0).fill_null(0).to_numpy())
        if out is None:
            return
        out.close()
        for kind, data in (("off", np.concatenate(offsets).astype("<u8")), ("doc", np.concatenate(ids).astype("<i8"))):
            with where.open_output_stream(f"{root}/{name}.{kind}{own}") as f:
                f.write(data.tobytes())
        for kind in ("bin", "off", "doc"):
            where.move(f"{root}/{name}.{kind}{own}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "n_docs": sum(map(len, ids)), "n_null": nulls, "n_tokens": total, "width": width}])

    parts = stored(t.mapInArrow(put, "part long, n_docs long, n_null long, n_tokens long, width long"), "manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def get(frames):
        where, root = _store(folder)
        local = type(where).__name__ == "LocalFileSystem"

        def flat(path: str, kind: str):
            if local:
                return np.memmap(path, kind, "r")
            with where.open_input_file(path) as f:
                return np.frombuffer(f.read(), kind)

        for frame in frames:
            for m in frame.itertuples():
                path = f"{root}/part-{m.part:06d}"
                ids, off, doc = flat(f"{path}.bin", f"<u{m.width}"), flat(f"{path}.off", "<u8").astype("int64"), flat(f"{path}.doc", "<i8")
                for a in range(0, m.n_docs, 2000):
                    z = min(a + 2000, m.n_docs)
                    key = pd.array(doc[a:z], dtype="Int64")
                    key[: max(0, m.n_null - a)] = pd.NA
                    yield pd.DataFrame({"doc_id": key, "start": m.base + off[a:z], "n_tokens": np.diff(off[a : z + 1]), "ids": [ids[off[k] : off[k + 1]].astype("<u4").tobytes() for k in range(a, z)]})

    return manifest.repartition(n, "part").mapInPandas(get, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer, end_id, id_col, text_col)
    return read(docs.sparkSession, folder)


QUERY = "op8_binary_output"
