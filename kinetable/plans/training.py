"""The training build: accepted frames, normalized faces, features, split, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS
from kinetable.functions import vision
from kinetable.operators import alignment, evaluation, features, joins, vectors
from kinetable.operators.filters import is_rest, training_frames
from kinetable.session import staged

FEATURES = ("dental", "pose_delta", "channels")
LANDMARK_FEATURES = ("canonical", "deltas")
AUDIO = ("spectral", "energy", "prob")


def build_training(
    frames: DataFrame,
    audio: DataFrame | None = None,
    lean: bool = True,
    names: Sequence[str] = CHANNELS,
    model: alignment.FaceModel | None = None,
    min_frames: int = 10,
    seed: int = 42,
    by: Sequence[str] | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Training rows of all sessions.

    ``frames``: session_id, frame_idx, t (seconds), role, channels, pose (3), and
    landmarks unless ``lean``; a session's audio is taken from its own columns if it has
    any spectra there, else from ``audio`` by position, else it is silent.  ``materialize`` stores the accepted frames once in
    the shared checkpoint folder, since medians, split and features all read them.
    """
    key = ["session_id"]
    kept = ["session_id", "frame_idx", "t", "role", "channels", "pose", *[c for c in AUDIO if c in frames.columns]]
    if not lean:
        kept.append("landmarks")
    rows = frames.select(*[c for c in kept if c in frames.columns])
    rows = training_frames(rows, min_frames)
    rows = with_audio(rows, audio)
    if materialize:
        rows = staged(rows)
    get = vision.channels("channels", names)
    # What needs whole sessions or the whole table reads narrow columns of these rows.
    out = evaluation.split(rows, ["session_id", "frame_idx"], seed=seed, by=by)
    out = features.fallback_spectrum(out, from_rows=rows)
    out = vectors.pose_delta(out, key, from_rows=rows).drop("pose")
    if not lean:
        model = model or alignment.FaceModel()
        rest = is_rest(
            F.col("role") if "role" in rows.columns else None,
            *[get(n) if n in names else None for n in ("jawOpen", "mouthSmileLeft", "mouthSmileRight")],
        )
        neutral = alignment.neutral_faces(rows, key, "landmarks", rest, model)
        out = alignment.normalize_frames(out, neutral, key, "landmarks", model).drop("landmarks", "residual")
    return out.withColumns(
        {"dental": vision.dental_features(get), "emotion_id": vision.emotion_id(get), "t_ns": vision.to_ns(F.col("t"))}
    )


def with_audio(rows: DataFrame, audio: DataFrame | None) -> DataFrame:
    """Audio columns of every session: stored ones, else those of ``audio``, else silence."""

    def filled(df: DataFrame) -> DataFrame:
        bare = df.drop(*AUDIO)
        if audio is not None:
            return joins.join_audio_positional(bare, audio)
        return bare.withColumns({"energy": F.lit(0.0), "prob": F.lit(1.0), "spectral": F.array_repeat(F.lit(0.0), 64)})

    if "spectral" not in rows.columns:
        return filled(rows)
    stored = rows.filter(F.col("spectral").isNotNull()).select("session_id").distinct()
    has = rows.join(stored, "session_id", "left_semi")
    lacks = filled(rows.join(stored, "session_id", "left_anti"))
    # Types as stored, so that both parts fit together.
    types = {f.name: f.dataType for f in rows.schema if f.name in AUDIO}
    for name, default in (("energy", F.lit(0.0)), ("prob", F.lit(1.0))):
        if name not in types:
            has = has.withColumn(name, default)
    lacks = lacks.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})
    return has.unionByName(lacks)


def feature_stats(training: DataFrame) -> DataFrame:
    """Mean, deviation, min and max of every component of every feature.

    The build is staged, as every feature reads its own columns of it.
    """
    training = staged(training.select(*[c for c in (*FEATURES, *LANDMARK_FEATURES) if c in training.columns]))
    parts = []
    for name in (*FEATURES, *LANDMARK_FEATURES):
        if name in training.columns:
            stats = vectors.wide_vector_stats if name in LANDMARK_FEATURES else vectors.vector_stats
            parts.append(stats(training, name).withColumn("feature", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def training_totals(training: DataFrame) -> DataFrame:
    """Row counts of the splits and of each emotion, as one row."""
    return training.agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if("is_train").alias("train_frames"),
        F.count_if(~F.col("is_train")).alias("val_frames"),
        *[F.count_if(F.col("emotion_id") == e).alias(f"emotion_{e}") for e in range(5)],
    )
