"""Session recordings: folders of arrays, archives of folders, metadata, audio.

Files are found and split by Spark; a task only decodes the bytes of its files and
emits bounded batches.  Inputs are never changed or deleted.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 512
MIN_ARCHIVE_BYTES = 100

_floats = T.ArrayType(T.FloatType())
# Stored array names, our column names and types.
ARRAYS = (
    ("timestamps", "t", T.DoubleType()),
    ("face_ids", "face_id", T.IntegerType()),
    ("is_primary", "is_primary", T.BooleanType()),
    ("bboxes", "bbox", T.ArrayType(T.IntegerType())),
    ("raw_landmarks", "raw_landmarks", _floats),
    ("clean_landmarks", "clean_landmarks", _floats),
    ("raw_blendshapes", "raw_channels", _floats),
    ("clean_blendshapes", "clean_channels", _floats),
    ("raw_pose_euler", "raw_euler", _floats),
    ("clean_pose_euler", "clean_euler", _floats),
    ("raw_pose_trans", "raw_trans", _floats),
    ("clean_pose_trans", "clean_trans", _floats),
    ("quality_scores", "quality_score", T.DoubleType()),
    ("blur_scores", "blur", T.DoubleType()),
    ("is_valid", "is_valid", T.BooleanType()),
    ("eligibility_levels", "level", T.IntegerType()),
    ("speaker_probabilities", "speaker_probability", T.DoubleType()),
    ("roles", "role", T.StringType()),
    ("audio_features", "spectral", _floats),
    ("audio_energy", "energy", T.DoubleType()),
    ("audio_speech_prob", "prob", T.DoubleType()),
)
NAMES = "channel_names"
FRAME_FILE, AUDIO_FILE, META_FILE = "face_motion.npz", "audio_features.json", "metadata.json"


def frame_schema(columns: Sequence[str] | None = None) -> T.StructType:
    kept = [T.StructField(c, t) for _, c, t in ARRAYS if columns is None or c in columns]
    head = [T.StructField("session_id", T.StringType()), T.StructField("frame_idx", T.LongType())]
    tail = [T.StructField(NAMES, T.ArrayType(T.StringType()))] if columns is None or NAMES in columns else []
    return T.StructType(head + kept + tail + [T.StructField("corrupt", T.StringType())])


def _decode(session: str, data: bytes, schema: T.StructType) -> Iterator[pd.DataFrame]:
    """Frames of one stored session in bounded batches; a bad file gives one row saying why."""
    wanted = set(schema.names)
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as stored:
            n = len(stored["timestamps"])
            found = {c: stored[a] for a, c, _ in ARRAYS if c in wanted and a in stored.files}
            # Arrays of another length than the frames can't be placed: their column is null, and a row says why.
            arrays = {c: values for c, values in found.items() if np.ndim(values) and len(values) == n}
            unplaced = [f"{c}: {len(v) if np.ndim(v) else 'no'} values for {n} frames" for c, v in found.items() if c not in arrays]
            names = [str(x) for x in stored["blendshape_names"]] if "blendshape_names" in stored.files else None
    except Exception as error:
        yield _shaped({"session_id": [session], "corrupt": [f"{type(error).__name__}: {error}"]}, schema, 1)
        return
    if unplaced:
        yield _shaped({"session_id": [session], "corrupt": ["; ".join(unplaced)]}, schema, 1)
    for at in range(0, n, BATCH):
        size = min(BATCH, n - at)
        frame = {"session_id": [session] * size, "frame_idx": np.arange(at, at + size)}
        for c, values in arrays.items():
            part = values[at : at + size]
            frame[c] = list(part.reshape(size, -1)) if part.ndim > 1 else part
        if NAMES in wanted:
            frame[NAMES] = [names] * size
        yield _shaped(frame, schema, size)


def _shaped(values: dict, schema: T.StructType, size: int) -> pd.DataFrame:
    """All columns of the schema, absent ones null."""
    return pd.DataFrame({c: values[c] if c in values else [None] * size for c in schema.names})


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def _session_of(path: str = "path"):
    return F.element_at(F.split(path, "/"), -2)


def read_sessions(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Frames of every stored session below ``path``; unreadable files have ``corrupt`` set.

    Only the named ``columns`` are decoded, so a lean reader never touches landmarks.
    """
    schema = frame_schema(columns)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for session, data in zip(batch["session_id"], batch["content"]):
                yield from _decode(session, data, schema)

    files = _files(spark, path, FRAME_FILE).select(_session_of().alias("session_id"), "content")
    return files.mapInPandas(decode, schema)


def _members(data: bytes, suffix: str) -> Iterator[tuple[str, bytes]]:
    if len(data) < MIN_ARCHIVE_BYTES:
        raise ValueError(f"an archive of {len(data)} bytes")
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as archive:
        for member in archive:
            if member.isfile() and member.name.endswith(suffix):
                folders = member.name.split("/")
                yield (folders[0] if len(folders) > 1 else "default_session"), archive.extractfile(member).read()
        # The loop ends quietly where an archive is cut off; reading on to its end does not.
        while archive.fileobj.read(1 << 20):
            pass


def archive_frames(name: str, data: bytes, schema: T.StructType) -> Iterator[pd.DataFrame]:
    """Frames of the sessions inside one archive, batch by batch; damage is a row with ``corrupt`` set."""
    try:
        for session, member in _members(data, FRAME_FILE):
            yield from _decode(session, member, schema)
    except Exception as error:
        yield _shaped({"session_id": [name], "corrupt": [f"{type(error).__name__}: {error}"]}, schema, 1)


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Frames of the sessions inside every archive, one task per archive; damage has ``corrupt`` set."""
    schema = frame_schema(columns)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield from archive_frames(name, data, schema)

    return _files(spark, path, "*.tar.gz").select("path", "content").mapInPandas(decode, schema)


AUDIO = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("energy_rms", T.DoubleType()),
        T.StructField("is_speech", T.BooleanType()),
        T.StructField("vad_confidence", T.DoubleType()),
        T.StructField("spectral_features", T.ArrayType(T.FloatType())),
    ]
)
AUDIO_COLUMNS = ("session_id", "slice_idx", "t", "energy_rms", "is_speech", "vad_confidence", "spectral", "corrupt")


def _audio_rows(texts: DataFrame) -> DataFrame:
    """``session_id``, ``text`` of a JSON list to one row per slice, position kept.

    A document that is no such list gives one row with ``corrupt`` set; so does a row of ``texts``.
    """
    parsed = F.from_json("text", T.ArrayType(AUDIO))
    why = F.col("corrupt") if "corrupt" in texts.columns else F.lit(None).cast("string")
    # What can't be parsed is null, or one all-null element for a text that is no list.
    list_like = F.rlike("text", F.lit(r"^\s*\[")) & parsed.isNotNull() & ~F.exists(parsed, lambda a: a.isNull())
    rows = texts.withColumns({"_a": F.when(list_like, parsed), "corrupt": F.coalesce(why, F.when(~F.coalesce(list_like, F.lit(False)), "audio: no list of slices"))})
    rows = rows.filter(F.col("corrupt").isNotNull() | (F.size("_a") > 0)).select("session_id", "corrupt", F.posexplode_outer("_a").alias("slice_idx", "a"))
    return rows.select(
        "session_id", F.col("slice_idx").cast("long").alias("slice_idx"), F.col("a.timestamp").alias("t"), "a.energy_rms", "a.is_speech",
        "a.vad_confidence", F.col("a.spectral_features").alias("spectral"), "corrupt",
    )


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio slices stored next to the frames; unreadable documents have ``corrupt`` set."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=AUDIO_FILE, recursiveFileLookup=True)
    return _audio_rows(texts.select(_session_of("_metadata.file_path").alias("session_id"), F.col("value").alias("text")))


def read_chunk_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio slices stored inside archives; damaged archives have ``corrupt`` set."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    for session, member in _members(data, AUDIO_FILE):
                        yield pd.DataFrame({"session_id": [session], "text": [member.decode("utf-8", "replace")], "corrupt": [None]})
                except Exception as error:
                    yield pd.DataFrame({"session_id": [name], "text": [None], "corrupt": [f"{type(error).__name__}: {error}"]})

    archives = _files(spark, path, "*.tar.gz").select("path", "content")
    return _audio_rows(archives.mapInPandas(texts, "session_id string, text string, corrupt string"))


METADATA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("source_description", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("total_video_frames", T.LongType()),
        T.StructField("total_audio_frames", T.LongType()),
        T.StructField("tracked_face_ids", T.ArrayType(T.IntegerType())),
        T.StructField("primary_face_id", T.IntegerType()),
        T.StructField("eligibility_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("role_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("average_capture_fps", T.DoubleType()),
        T.StructField("average_inference_fps", T.DoubleType()),
        T.StructField("hardware_telemetry", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Session metadata documents, with the telemetry as a string map and the creation time parsed."""
    rows = (
        spark.read.schema(METADATA).option("multiLine", "true").option("pathGlobFilter", META_FILE)
        .option("recursiveFileLookup", "true").json(path)
    )
    return rows.withColumn("created_at", F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss"))).withColumnRenamed(
        "hardware_telemetry", "telemetry"
    )


def session_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Stored bytes per session folder, read from file listings only."""
    found = None
    for name in (FRAME_FILE, META_FILE):
        part = _files(spark, path, name).select(_session_of().alias("session_id"), "length")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("session_id").agg(F.sum("length").alias("size_bytes"))


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("corrupt").isNull()).drop("corrupt")


def corrupt_files(df: DataFrame) -> DataFrame:
    return df.filter(F.col("corrupt").isNotNull()).select("session_id", "corrupt")


