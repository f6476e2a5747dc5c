"""Queries that write tables through the sinks and read them back through the sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import music
from ..sources import tables as S
from .catalog import Catalog, rounded
from .testbed import FRAMES, NOTES, SAMPLES, frames, notes, samples, table

Q = Catalog()


def shared_folder(spark) -> str:
    """A new place in the folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tonewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/io-{uuid.uuid4().hex}"


def written(spark, t, name: str = ""):
    """t as stored in the shared folder."""
    path = shared_folder(spark)
    t.write.parquet(path)
    return spark.read.schema(t.schema).parquet(path)


@Q.add("s1_frames", f"WITH {FRAMES} SELECT track_id, idx, round(CAST(CAST(f0 AS FLOAT) AS DOUBLE), 3) AS f0, round(CAST(CAST(conf AS FLOAT) AS DOUBLE), 3) AS conf FROM frames WHERE track_id % 2 = 0")
def s1(spark, sf_dir):
    path = shared_folder(spark)
    f = frames(spark, sf_dir)
    S.write_frames(f.select("track_id", "idx", *[F.col(c).cast("float").alias(c) for c in ("f0", "conf", "rms_db", "flux", "hf")], F.when(F.col("track_id") % 2 == 0, "a").otherwise("b").alias("backend")), path)
    return rounded(S.read_frames(spark, path, "a").select("track_id", "idx", "f0", "conf"), digits=3)


def _full_notes(spark, sf_dir):
    n = notes(spark, sf_dir)
    return n.select("track_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round(F.col("end") - F.col("start"), 4).alias("duration"), "pitch", music.note_name("pitch").alias("name"), F.lit(1.0).alias("hz"), F.lit(1.0).alias("note_hz"), F.lit(0.0).alias("cents"), F.lit(64).alias("velocity"), F.lit(0.5).alias("confidence"))


@Q.add("s2_notes_json", f"""WITH {NOTES} SELECT track_id, len(list(pitch)) AS n, list(pitch ORDER BY note_no) AS pitches FROM notes GROUP BY track_id""")
def s2(spark, sf_dir):
    path = shared_folder(spark)
    n = _full_notes(spark, sf_dir)
    S.write_notes_json(n, n.select("track_id").distinct(), path)
    back = spark.read.schema("track_id long, notes array<struct<start: double, pitch: int>>").json(path)
    return back.select("track_id", F.size("notes").cast("long").alias("n"), F.transform("notes", lambda x: x["pitch"]).alias("pitches"))


@Q.add("s2_notes_csv", f"""WITH {NOTES} SELECT track_id, round("start", 4) AS "start", pitch FROM notes""")
def s2_csv(spark, sf_dir):
    path = shared_folder(spark)
    S.write_notes_csv(_full_notes(spark, sf_dir), path)
    return spark.read.option("header", True).schema("track_id long, start double, end double, duration double, pitch int").csv(path, enforceSchema=True).select("track_id", "start", "pitch")


@Q.add("s3_notes_reference", f"""WITH {NOTES} SELECT track_id, 'A' || (1 + note_no % 2) AS annotator, round("start", 4) AS "start", round("end", 4) AS "end" FROM notes""")
def s3(spark, sf_dir):
    path = shared_folder(spark)
    n = notes(spark, sf_dir)
    name = F.concat(F.lit("x_"), F.col("track_id").cast("string"), F.lit("_notesA"), (1 + F.col("note_no") % 2).cast("string"))
    t = n.select(F.concat_ws(",", "start", F.lit(440.0), F.col("end") - F.col("start")).alias("line"), name.alias("name"))
    _named_files(t, path, ".csv")
    return rounded(S.read_notes_reference(spark, path).select("track_id", "annotator", "start", "end"))


def _named_files(lines, path: str, suffix: str) -> None:
    """Text files under names that the readers parse, from (name, line) in order of line or of pos where there is one: a small
    writer for round trips."""
    pos = "pos" if "pos" in lines.columns else "line"
    grouped = lines.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("line").alias("v")))), lambda x: x["v"]), "\n").alias("text"))
    _put(grouped.select("name", F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("data")), path, suffix)


def _put(files, path: str, suffix: str) -> None:
    """Writes a file for each row of (name, data)."""

    def put(frames):
        import pandas as pd
        from pyarrow import fs

        for f in frames:
            for name, data in zip(f["name"], f["data"], strict=True):
                where, root = fs.FileSystem.from_uri(path) if not path.startswith("file:") else (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))
                where.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with where.open_output_stream(f"{root}/{name}{suffix}") as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"n": [len(f)]})

    files.mapInPandas(put, "n int").agg(F.sum("n")).collect()


MIDI = "CASE WHEN f0 > 0 THEN 69 + 12 * log2(f0 / 440) END"


@Q.add("s4_pitch_labels_pv", f"WITH {FRAMES} SELECT track_id, idx + 1 AS idx, round({MIDI}, 4) AS midi FROM frames")
def s4(spark, sf_dir):
    """A number a line, 0 for unvoiced; the first is that of frame 1."""
    path = shared_folder(spark)
    f = frames(spark, sf_dir).select(F.col("track_id").cast("string").alias("name"), F.col("idx").alias("pos"), F.format_string("%.12f", F.coalesce(music.hz_to_midi("f0"), F.lit(0.0))).alias("line"))
    _named_files(f, path, ".pv")
    return rounded(S.read_pitch_labels(spark, path, "pv").select(F.regexp_extract("file", r"(\d+)\.pv$", 1).cast("long").alias("track_id"), "idx", "midi"))


@Q.add("s4_pitch_labels_csv", f"WITH {FRAMES} SELECT track_id, idx, round({MIDI}, 4) AS midi FROM frames")
def s4_csv(spark, sf_dir):
    """A header that names the column, then a row a frame."""
    path = shared_folder(spark)
    f = frames(spark, sf_dir).select(F.col("track_id").cast("string").alias("name"), F.col("idx").alias("pos"), F.concat_ws(",", F.col("idx").cast("string"), F.format_string("%.12f", F.coalesce(music.hz_to_midi("f0"), F.lit(0.0)))).alias("line"))
    head = f.select("name").distinct().select("name", F.lit(-1).alias("pos"), F.lit("frame,midi").alias("line"))
    _named_files(f.unionByName(head), path, ".csv")
    return rounded(S.read_pitch_labels(spark, path, "csv").select(F.regexp_extract("file", r"(\d+)\.csv$", 1).cast("long").alias("track_id"), "idx", "midi"))


@Q.add("s4_pitch_labels_tsv", f"""WITH {NOTES} SELECT track_id, round("start", 4) AS onset, round("end", 4) AS "offset", CAST(pitch AS DOUBLE) AS note FROM notes""")
def s4_tsv(spark, sf_dir):
    path = shared_folder(spark)
    cell = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    n = notes(spark, sf_dir).select(F.col("track_id").cast("string").alias("name"), F.col("note_no").alias("pos"), F.concat_ws("\t", cell("start"), cell("end"), cell("pitch")).alias("line"))
    head = n.select("name").distinct().select("name", F.lit(0).alias("pos"), F.lit("onset\toffset\tnote").alias("line"))
    _named_files(n.unionByName(head), path, ".tsv")
    return rounded(S.read_pitch_labels(spark, path, "tsv").select(F.regexp_extract("file", r"(\d+)\.tsv$", 1).cast("long").alias("track_id"), "onset", "offset", "note"))


@Q.add("s7_audio_files", "SELECT 'in/' || (s_nationkey % 5) || '/' || s_suppkey || '.wav' AS name, 'out/' || (s_nationkey % 5) || '/' || s_suppkey || '.notes.json' AS output FROM supplier WHERE s_suppkey % 3 <> 0")
def s7(spark, sf_dir):
    """Audio files and others in nested folders, with the place of each result."""
    path = shared_folder(spark)
    s = table(spark, sf_dir, "supplier")
    ending = F.when(F.col("s_suppkey") % 3 == 0, F.lit(".txt")).otherwise(F.lit(".wav"))
    _put(s.select(F.concat_ws("/", F.lit("in"), (F.col("s_nationkey") % 5).cast("string"), F.concat(F.col("s_suppkey").cast("string"), ending)).alias("name"), F.encode("s_name", "UTF-8").alias("data")), path, "")
    t = S.list_audio_files(spark, f"{path}/in", recursive=True, output=f"{path}/out", suffix=".notes.json")
    tail = lambda c, k: F.substring_index(c, "/", -k)
    return t.select(tail(F.col("path"), 3).alias("name"), tail(F.col("output"), 3).alias("output"))


def wav_bytes(x) -> bytes:
    """16-bit mono at 16 kHz."""
    import struct

    import numpy as np

    body = np.round(np.clip(np.asarray(x, "float64"), -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


@Q.add("s8_decode_wav", f"WITH {SAMPLES}, w AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY member, pos) - 1 AS pos, x FROM samples) SELECT clip, pos // 64 AS chunk_no, count(*) AS n, round(sum((pos % 64 + 1) * round_even(x * 32767, 0) / 32768), 3) + 0.0 AS placed FROM w GROUP BY ALL")
def s8(spark, sf_dir):
    """The members of each clip one after another in a WAV file, read back in chunks."""
    path = shared_folder(spark)
    t = samples(spark, sf_dir).groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "pos", "x"))), lambda v: v["x"]).alias("samples"))

    def files(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"name": f["clip"].astype(str), "data": [wav_bytes(x) for x in f["samples"]]})

    _put(t.mapInPandas(files, "name string, data binary"), path, ".wav")
    back = S.decode_wav(spark.read.format("binaryFile").load(path), 64)
    placed = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select(F.regexp_extract("clip", r"(\d+)\.wav$", 1).cast("long").alias("clip"), F.col("chunk_no").cast("long").alias("chunk_no"), F.size("samples").cast("long").alias("n"), placed.alias("placed")), digits=3)


@Q.add("s5_filelist", "SELECT 'w' || p_partkey AS wav, 'f' || p_size AS feature, CAST(p_size AS VARCHAR) AS speaker_id FROM part")
def s5(spark, sf_dir):
    path = shared_folder(spark)
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("wav"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("feature"), F.col("p_size").alias("speaker_id"), F.lit(None).cast("string").alias("speaker_name"))
    S.write_filelist(t, path, pitch=False)
    return S.read_filelist(spark, path, pitch=False).drop("speaker_name")


@Q.add("s6_manifest", "SELECT p_name || p_partkey AS path, CAST(p_size AS INTEGER) AS speaker_id, 'k' || p_partkey AS output_key FROM part")
def s6(spark, sf_dir):
    path = shared_folder(spark)
    p = table(spark, sf_dir, "part")
    S.write_manifest(p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("speaker_name"), F.col("p_size").alias("speaker_id"), F.lit(1).alias("repeat"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("output_key")), path)
    return S.read_manifest(spark, path).select("path", "speaker_id", "output_key")


@Q.add("s9_features", "SELECT CAST(label AS VARCHAR) AS clip, vec_id, len(embedding) AS n, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * CAST(embedding[i] AS DOUBLE))), 3) + 0.0 AS placed FROM embeddings")
def s9(spark, sf_dir):
    path = shared_folder(spark)
    e = table(spark, sf_dir, "embeddings")
    S.write_features(e.select(F.col("label").cast("string").alias("clip"), F.col("vec_id").cast("int").alias("pos"), F.col("embedding").alias("vec")), path)
    placed = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(S.read_features(spark, path, 64).select("clip", F.col("pos").cast("long").alias("vec_id"), F.size("vec").cast("long").alias("n"), placed.alias("placed")), digits=3)
