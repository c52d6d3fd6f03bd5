"""Joins of frames with audio: nearest in time, by position, carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.ordered import Timeline, row_index, running
from kinetable.session import staged


def align_audio(
    frames: DataFrame,
    audio: DataFrame,
    width: float,
    key: str = "session_id",
    t: str = "t",
    frame: str = "frame_idx",
    index: str = "slice_idx",
) -> DataFrame:
    """Add to each frame the index of its audio slice.

    Sessions with as many frames as slices pair by position; all others take the
    slice nearest in time, the lowest index on a tie.  ``width`` is the extent of a
    work slice.  Frames of sessions without audio get null.
    """
    counts = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_f")).join(
        audio.groupBy(key).agg(F.count(F.lit(1)).alias("_a")), key, "left"
    )
    same = staged(counts.filter(F.col("_f") == F.col("_a")).select(key))

    by_place = row_index(frames.join(same, key, "left_semi"), Timeline((key,), (t, frame), width), "_i")
    places = row_index(
        audio.join(same, key, "left_semi").select(key, index), Timeline((key,), (index,), 100_000), "_i"
    )
    paired = by_place.join(places, [key, "_i"]).select(*frames.columns, index)

    rest = frames.join(same, key, "left_anti")
    # Equal times: only the lowest index can win.
    points = audio.join(same, key, "left_anti").groupBy(key, t).agg(F.min(index).alias("_audio"))
    keep = F.struct(*[F.col(c) for c in rest.columns])
    blank = F.lit(None).cast(rest.select(keep.alias("r")).schema["r"].dataType)
    union = rest.select(key, t, F.lit(1).alias("_kind"), F.col(frame).alias("_id"), F.lit(None).cast("long").alias("_audio"), keep.alias("_row")).unionByName(
        points.select(key, t, F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_id"), F.col("_audio").cast("long"), blank.alias("_row"))
    )
    line = Timeline((key,), (t, "_kind", "_id"), width)
    point = F.when(F.col("_audio").isNotNull(), F.struct(t, "_audio"))
    # A slice at the very time of a frame comes first, so looking back finds it.
    merged = staged(running(union, line, {"_back": ("max", point)}))
    merged = running(merged, line, {"_ahead": ("min", point)}, backward=True).filter(F.col("_kind") == 1)
    back, ahead = F.col(t) - F.col("_back")[t], F.col("_ahead")[t] - F.col(t)
    nearest = (
        F.when(back.isNull() | (ahead < back), F.col("_ahead._audio"))
        .when(ahead.isNull() | (back < ahead), F.col("_back._audio"))
        .otherwise(F.least(F.col("_back._audio"), F.col("_ahead._audio")))
    )
    near = merged.select("_row.*", nearest.alias(index))
    return paired.select(*frames.columns, F.col(index).cast("long")).unionByName(near)


def attach_audio(aligned: DataFrame, audio: DataFrame, key: str = "session_id", index: str = "slice_idx") -> DataFrame:
    """Audio columns of the aligned slice; the join key spreads a long session."""
    values = audio.select(key, index, *[c for c in audio.columns if c not in aligned.columns])
    return aligned.join(values, [key, index], "left")


def join_audio_positional(frames: DataFrame, audio: DataFrame, key: str = "session_id", index: str = "frame_idx") -> DataFrame:
    """Audio of the same position; defaults where the row or one of its fields is missing.

    ``audio`` has (key, slice_idx, energy_rms, vad_confidence, spectral), all nullable.
    """
    found = audio.select(
        F.col(key), F.col("slice_idx").alias(index), F.lit(True).alias("_hit"),
        F.coalesce("energy_rms", F.lit(0.02)).alias("_e"), F.coalesce("vad_confidence", F.lit(0.8)).alias("_p"),
        F.when(F.size("spectral") == 64, F.col("spectral")).alias("_s"),
    )
    silent = F.array_repeat(F.lit(0.0), 64).cast(found.schema["_s"].dataType)
    return frames.join(found, [key, index], "left").select(
        *frames.columns,
        F.coalesce("_e", F.lit(0.0)).alias("energy"),
        F.coalesce("_p", F.lit(1.0)).alias("prob"),
        F.coalesce("_s", silent).alias("spectral"),
    )


def carry_audio(frames: DataFrame, audio: DataFrame, width: float, values: list[str], key: str = "session_id", t: str = "t",
                frame: str = "frame_idx", index: str = "slice_idx") -> DataFrame:
    """Give each frame the values of the latest audio row at or before its time."""
    rest = F.struct(*[F.col(c) for c in frames.columns])
    payload = F.struct(*[F.col(v) for v in values])
    row_type = frames.select(rest.alias("r")).schema["r"].dataType
    pay_type = audio.select(payload.alias("p")).schema["p"].dataType
    union = frames.select(key, t, F.lit(1).alias("_kind"), F.col(frame).alias("_id"), rest.alias("_row"), F.lit(None).cast(pay_type).alias("_pay")).unionByName(
        audio.select(key, t, F.lit(0).alias("_kind"), F.col(index).alias("_id"), F.lit(None).cast(row_type).alias("_row"), payload.alias("_pay"))
    )
    line = Timeline((key,), (t, "_kind", "_id"), width)
    latest = F.when(F.col("_pay").isNotNull(), F.struct(t, "_id", "_pay"))
    out = running(union, line, {"_last": ("max", latest)}).filter(F.col("_kind") == 1)
    return out.select("_row.*", *[F.col("_last._pay")[v].alias(v) for v in values])
