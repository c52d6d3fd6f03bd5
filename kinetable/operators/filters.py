"""Row filters and status rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_frames(
    df: DataFrame,
    min_level: int | None = None,
    face_id: int | None = None,
    role: str | None = None,
    primary_only: bool = False,
) -> DataFrame:
    """All given conditions; one whose column is absent is skipped."""
    tests = {
        "level": None if min_level is None else F.col("level") >= min_level,
        "face_id": None if face_id is None else F.col("face_id") == face_id,
        "role": None if role is None else F.col("role") == role,
        "is_primary": F.col("is_primary") if primary_only else None,
    }
    for column, test in tests.items():
        if test is not None and column in df.columns:
            df = df.filter(test)
    return df


def get_sample(df: DataFrame, wanted: DataFrame, names: Sequence[str] = (), values: Sequence[str] = (), key=("session_id", "frame_idx")) -> DataFrame:
    """The frames listed in ``wanted``, their channel arrays zipped with the names to maps.

    The shorter of names and values decides how many channels a map has.
    """
    rows = df.join(wanted.select(*key).distinct(), list(key), "left_semi")
    labels = F.array(*[F.lit(n) for n in names])
    for column in values:
        both = F.least(F.size(column), F.lit(len(names)))
        rows = rows.withColumn(column, F.map_from_arrays(F.slice(labels, F.lit(1), both), F.slice(column, F.lit(1), both)))
    return rows


def accepted_role(role: Column) -> Column:
    # Accepted role spellings.
    return F.coalesce(
        role.isin("SPEAKER", "SPEAKER_PAUSE", "FaceRole.SPEAKER", "FaceRole.SPEAKER_PAUSE"), F.lit(False)
    )


def accept_frames(df: DataFrame, key=("session_id",), role: str = "role") -> DataFrame:
    """Speech rows; a session without any keeps all its rows."""
    if role not in df.columns:
        return df
    match = accepted_role(F.col(role))
    per = df.groupBy(*key).agg(F.max(match).alias("_any"))
    return df.join(per, list(key)).filter(match | ~F.col("_any")).select(*df.columns)


def min_frames_gate(df: DataFrame, n: int = 10, key=("session_id",)) -> DataFrame:
    """Rows of sessions with at least ``n`` rows."""
    large = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(large.select(*key), list(key), "left_semi")


def training_frames(df: DataFrame, n: int = 10, key=("session_id",), role: str = "role") -> DataFrame:
    """:func:`min_frames_gate`, :func:`accept_frames` and the gate again, with one aggregate.

    All three only need two counts per session, so rows are joined once.
    """
    match = accepted_role(F.col(role)) if role in df.columns else F.lit(True)
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(match).alias("_hits"))
    kept = F.when(F.col("_hits") == 0, F.col("_n")).otherwise(F.col("_hits"))
    per = per.filter((F.col("_n") >= n) & (kept >= n))
    return df.join(per, list(key)).filter(match | (F.col("_hits") == 0)).select(*df.columns)


def any_word(text: Column, words: Sequence[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def valid_candidate(
    df: DataFrame, words: Sequence[str], min_s: float = 70, max_s: float = 10800,
    key: str = "id", title: str = "title", duration: str = "duration",
) -> DataFrame:
    """Candidates with an 11-character id, a clean title and a plausible (or unknown) duration."""
    fits = F.col(duration).isNull() | F.col(duration).between(min_s, max_s)
    clean = ~F.coalesce(any_word(F.col(title), words), F.lit(False))
    return df.filter((F.length(key) == 11) & clean & fits)


def is_rest(role: Column | None, jaw: Column | None, smile_left: Column | None, smile_right: Column | None) -> Column:
    """A resting face: pausing or listening, else jaw and smile channels all low."""
    active = F.lit(False)
    for channel, limit in ((jaw, 0.08), (smile_left, 0.12), (smile_right, 0.12)):
        if channel is not None:
            active = active | F.coalesce(channel > limit, F.lit(False))
    if role is None:
        return ~active
    return F.coalesce(role.contains("PAUSE") | role.contains("LISTENER"), F.lit(False)) | ~active


def rest_frames(df: DataFrame, rest: Column, minimum: int = 5, key=("session_id",)) -> DataFrame:
    """Resting rows; a session with too few keeps all its rows."""
    per = df.groupBy(*key).agg(F.count_if(rest).alias("_rest"))
    return df.join(per, list(key)).filter(rest | (F.col("_rest") < minimum)).select(*df.columns)


def purge_completed(df: DataFrame, min_s: float = 15.0, min_frames: int = 50) -> DataFrame:
    """Drop completions that are too short to be real."""
    short = (F.coalesce("duration_seconds", F.lit(0.0)) < min_s) | (F.coalesce("frame_count", F.lit(0)) < min_frames)
    return df.filter(~short)


def reset_short(df: DataFrame, min_s: float = 15.0) -> DataFrame:
    """Put completed or failed queue rows shorter than ``min_s`` back to pending."""
    hit = F.col("status").isin("completed", "failed") & (F.coalesce("duration_seconds", F.lit(0.0)) < min_s)
    blank = {
        "status": F.lit("pending"), "completed_at": F.lit(None), "session_id": F.lit(None),
        "frame_count": F.lit(0), "duration_seconds": F.lit(0.0), "error_message": F.lit(None),
    }
    fields = {f.name: f.dataType for f in df.schema}
    return df.withColumns(
        {c: F.when(hit, v.cast(fields[c])).otherwise(F.col(c)) for c, v in blank.items() if c in fields}
    ).withColumn("was_reset", hit)


def reset_status(df: DataFrame, from_status: str) -> DataFrame:
    """Interrupted or failed rows back to pending; ``was_reset`` marks the changed ones."""
    hit = F.coalesce(F.col("status") == from_status, F.lit(False))
    out = df.withColumn("was_reset", hit).withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))
    if from_status == "failed" and "error_message" in df.columns:
        out = out.withColumn("error_message", F.when(~F.col("was_reset"), F.col("error_message")))
    return out


def classify_yield(df: DataFrame, frames: str = "frame_count", minimum: int = 30) -> DataFrame:
    """Captures with fewer than ``minimum`` frames have failed."""
    few = F.col(frames) < minimum
    return df.withColumn("status", F.when(few, "failed").otherwise("completed")).withColumn(
        "error_message",
        F.when(few, F.format_string("Zero or insufficient frames recorded (%d frames)", F.col(frames))),
    )
