"""Reading and writing the tables of this library, with explicit schemas."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import AUDIO_EXTENSIONS
from ..operators.dataset import filelist_line

FRAMES = "track_id long, idx int, f0 float, conf float, rms_db float, flux float, hf float, backend string"
NOTE_FIELDS = ("start", "end", "duration", "pitch", "name", "hz", "note_hz", "cents", "velocity", "confidence")
MANIFEST = (
    "version int, source string, root string, speakers array<struct<id: int, name: string>>, "
    "entries array<struct<path: string, speaker_name: string, speaker_id: int, repeat: int, output_key: string>>"
)


def write_frames(frames: DataFrame, path: str) -> None:
    """Parquet clustered by track and sorted by frame, so that later jobs find a track together."""
    frames.repartition("track_id").sortWithinPartitions("track_id", "idx").write.parquet(path)


def read_frames(spark: SparkSession, path: str, backend: str) -> DataFrame:
    """Frames of one pitch backend as doubles; tracks of another backend are to be made again."""
    t = spark.read.schema(FRAMES).parquet(path).filter(F.col("backend") == backend)
    return t.select("track_id", "idx", *[F.col(c).cast("double").alias(c) for c in ("f0", "conf", "rms_db", "flux", "hf")])


def write_bucketed(t: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """t stored in buckets of keys, a file each, sorted within, and read back: joins and groups on the keys of tables with the same
    number of buckets need no shuffle. The table isn't left in the catalogue; open_bucketed() finds it again."""
    name = f"bucketed_{uuid.uuid4().hex}"
    t.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").option("path", path).saveAsTable(name)
    return _opened(t.sparkSession, name)


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], order: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """A table that write_bucketed() stored with these keys, order and number of buckets."""
    name, listed = f"bucketed_{uuid.uuid4().hex}", lambda cols: ", ".join(f"`{c}`" for c in cols)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({listed(keys)}) SORTED BY ({listed((*keys, *order))}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _opened(spark, name)


def _opened(spark: SparkSession, name: str) -> DataFrame:
    t = spark.table(name)
    t.schema  # noqa: B018  resolved with its buckets, which stay when the catalogue forgets the name; files stay too
    spark.sql(f"DROP TABLE {name}")
    return t


def write_notes_csv(notes: DataFrame, path: str, key: str = "track_id") -> None:
    notes.select(key, *NOTE_FIELDS).write.option("header", True).csv(path)


def write_notes_json(notes: DataFrame, meta: DataFrame, path: str, key: str = "track_id") -> None:
    """A JSON object a track: its meta fields and its notes in order of time."""
    listed = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*NOTE_FIELDS))).alias("notes"))
    meta.join(listed, key, "left").write.json(path)


def read_notes_reference(spark: SparkSession, path: str) -> DataFrame:
    """Notes of headerless files start, hz, duration whose names carry track and annotator."""
    t = spark.read.schema("start double, hz double, duration double").csv(path).withColumn("_f", F.input_file_name())
    part = lambda k: F.regexp_extract("_f", r"_(\d+)_notes(A\d+)\.csv$", k)
    return t.select(part(1).try_cast("long").alias("track_id"), part(2).alias("annotator"), "start", (F.col("start") + F.col("duration")).alias("end"), "hz")


def read_pitch_labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, idx, midi) from label files, null for unvoiced. "pv": a number a line, the first for frame 1; "csv": a header
    with midi, the first row for frame 0; "tsv": onset, offset and note of every note as (file, onset, offset, note)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    lines = text.select("file", F.posexplode(F.split(F.rtrim("value", F.lit("\r\n \t")), "\r?\n")).alias("line", "v"))
    if kind == "pv":
        return lines.select("file", (F.col("line") + 1).alias("idx"), F.nullif(F.trim("v").try_cast("double"), F.lit(0.0)).alias("midi"))
    if kind == "tsv":
        cell = lambda k: F.get(F.split("v", "\t"), F.lit(k)).try_cast("double")
        return lines.filter("line > 0").select("file", cell(0).alias("onset"), cell(1).alias("offset"), cell(2).alias("note"))
    if kind == "csv":
        head = text.select(F.col("file").alias("_f"), (F.array_position(F.transform(F.split(F.substring_index(F.col("value"), "\n", 1), ","), lambda x: F.trim(F.rtrim(x, F.lit("\r")))), F.lit("midi")) - 1).cast("int").alias("_k"))
        t = lines.filter("line > 0").join(head, F.col("file") == F.col("_f"))
        return t.select("file", (F.col("line") - 1).alias("idx"), F.nullif(F.get(F.split("v", ","), F.col("_k")).try_cast("double"), F.lit(0.0)).alias("midi"))
    raise ValueError(f"unknown kind of labels: {kind}")


FILELIST_WITH_PITCH = ("wav", "feature", "f0", "f0nsf", "speaker_id", "speaker_name")
FILELIST_WITHOUT_PITCH = ("wav", "feature", "speaker_id", "speaker_name")


def write_filelist(rows: DataFrame, path: str, pitch: bool = True) -> None:
    """Lines of fields between bars, each in its place: a null field is empty, and the speaker's name, the last, is left out."""
    *fields, name = FILELIST_WITH_PITCH if pitch else FILELIST_WITHOUT_PITCH
    rows.select(filelist_line(*map(F.col, fields), name=F.col(name))).write.text(path)


def read_filelist(spark: SparkSession, path: str, pitch: bool = True) -> DataFrame:
    """The fields of every line as texts, null where one is empty or left out."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).select(*[F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(FILELIST_WITH_PITCH if pitch else FILELIST_WITHOUT_PITCH)])


def write_manifest(entries: DataFrame, path: str, version: int = 1, source: str = "folder", root: str = "") -> None:
    """The manifest as JSON lines: entries has one for each training file, header a single one with the speakers (at most 110)
    and the number of entries."""
    entry = entries.select("path", "speaker_name", "speaker_id", "repeat", "output_key")
    entry.write.json(f"{path}/entries")
    one = entry.agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_set(F.struct(F.col("speaker_id").alias("id"), F.col("speaker_name").alias("name")))).alias("speakers"))
    one.select(F.lit(version).alias("version"), F.lit(source).alias("source"), F.lit(root).alias("root"), "speakers", "n_entries").write.json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest; an empty or incomplete one fails."""
    kinds = spark.createDataFrame([], MANIFEST).schema["entries"].dataType.elementType
    t = spark.read.schema(kinds).json(f"{path}/entries")
    none = spark.read.schema("n_entries long").json(f"{path}/header").filter("n_entries = 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
    t = t.unionByName(none)  # an empty manifest is an invalid entry
    bad = F.col("path").isNull() | F.col("output_key").isNull() | ~F.coalesce(F.col("speaker_id").between(0, 109), F.lit(False)) | ~F.coalesce(F.col("repeat") >= 1, F.lit(False))
    return t.withColumn("path", F.when(~bad, F.col("path")).otherwise(F.raise_error(F.lit("the manifest has an invalid entry"))))


def list_audio_files(spark: SparkSession, folder: str, recursive: bool = False, output: str | None = None, suffix: str = ".json") -> DataFrame:
    """path, length and time of the audio files of a folder in order of path; their content isn't read. With output, also the
    place of each file's result there: its folder below folder stays, suffix takes the place of its ending. A folder without
    audio files fails."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")
    t = t.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*AUDIO_EXTENSIONS))
    if not t.limit(1).count():
        raise ValueError(f"there are no audio files in {folder}")
    if output is not None:
        # Spark gives paths with a scheme, and "file:/x" for "file:///x": what's before the folder's own name is cut off.
        root = folder.rstrip("/").split("://")[-1].lstrip("/")
        below = F.substr("path", F.instr("path", F.lit(root + "/")) + F.lit(len(root) + 1))
        t = t.withColumn("output", F.concat(F.lit(output.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./]+$", ""), F.lit(suffix)))
    return t.orderBy("path")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of uncompressed 16-bit or float audio; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, channels, bits, body = 12, None, 0, 1, 16, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if bits == 16 and kind in (1, 0xFFFE):
        x = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype("float32") / 32768
    elif bits == 32 and kind in (3, 0xFFFE):
        x = np.frombuffer(body[: len(body) // 4 * 4], "<f4")
    else:
        raise ValueError(f"unsupported WAV format {kind} with {bits} bits")
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


#: Samples that a task gathers before it passes their chunks on.
HELD_SAMPLES = 1 << 20


def decode_wav(files: DataFrame, chunk: int = 160_000) -> DataFrame:
    """Chunk rows (clip, rate, chunk_no, start, samples) from binaryFile rows, those of small files together."""
    names = ["clip", "rate", "chunk_no", "start", "samples"]

    def run(frames):
        for f in frames:
            rows, held = [], 0
            for path, content in zip(f["path"], f["content"], strict=True):
                rate, x = parse_wav(bytes(content))
                for n, at in enumerate(range(0, max(1, len(x)), chunk)):
                    rows.append((path, rate, n, at, x[at : at + chunk]))
                    held += min(chunk, len(x) - at)
                    if held >= HELD_SAMPLES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "clip string, rate int, chunk_no int, start long, samples array<float>")


def write_features(features: DataFrame, path: str) -> None:
    features.repartition("clip").sortWithinPartitions("clip", "pos").write.parquet(path)


def read_features(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(clip, pos, vec); a vector of another width fails."""
    t = spark.read.schema("clip string, pos int, vec array<float>").parquet(path)
    return t.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("vector of another width in clip "), F.col("clip")))))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """pos: the place of each row among those of its key."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
