"""Speaker labelling: which rows are speech, pause or listening, and how good they are.

"Time since the last articulating row" is a running maximum, so the whole gate is
one sliced cumulative pass - no per-session state is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.operators.ordered import Timeline, running, scan
from kinetable.operators.windows import gap_columns, timeline


def gate_labels(cfg: Config, has_audio: bool) -> list[Column]:
    """The label columns of a row, given ``_tau``: time since speech, null if never."""
    tau, several = F.col("_tau"), F.col("n_faces") > 1
    hold, word, limit = (F.lit(cfg.span(s)) for s in (cfg.syllable_hold_s, cfg.word_hold_s, cfg.pause_limit_s))
    single = F.col("n_faces") == 1
    blocked = F.lit(cfg.strict_single_face) & several
    speaking = F.col("articulating") | (single & F.coalesce(tau <= hold, F.lit(False)))
    between = single & F.coalesce(tau <= word, F.lit(False))
    pausing = single & F.coalesce(tau <= limit, F.lit(False))

    def choose(when_blocked, when_speaking, when_between, when_pausing, otherwise):
        return (
            F.when(blocked, when_blocked)
            .when(speaking, when_speaking)
            .when(between, when_between)
            .when(pausing, when_pausing)
            .otherwise(otherwise)
        )

    valid, motion = F.col("is_valid"), F.col("motion_score")
    level_several = F.when(F.col("hits") < 5, 0).when(F.col("rejected"), 1).otherwise(2)
    heard = F.col("speech_active") if has_audio else F.lit(False)
    judged = choose(
        F.lit(None),
        F.lit("ACTIVE_SPEECH"),
        F.lit("BETWEEN_WORDS"),
        F.lit("CONVERSATIONAL_PAUSE"),
        F.when(single, F.lit("SILENCE")),
    )
    return [
        tau.alias("since_speech"),
        judged.alias("conversational_state"),
        choose(
            F.lit("LISTENER"),
            F.lit("SPEAKER"),
            F.lit("SPEAKER"),
            F.lit("SPEAKER_PAUSE"),
            F.when(valid, F.lit("LISTENER")).otherwise(F.lit("UNKNOWN")),
        ).alias("role"),
        F.bround(
            choose(
                motion * 0.25,
                F.least(F.lit(0.99), F.greatest(F.lit(0.75), motion)),
                F.greatest(F.lit(0.70), motion * 0.85),
                F.greatest(F.lit(0.60), motion * 0.75),
                motion * 0.15,
            ),
            3,
        ).alias("speaker_probability"),
        choose(
            level_several,
            F.when(valid, 4).otherwise(2),
            F.when(valid, 4).otherwise(2),
            F.when(valid, 3).otherwise(2),
            F.when(valid, 3).otherwise(0),
        ).alias("level"),
        choose(F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(False)).alias("gate_active"),
        (~(blocked | speaking | between | pausing) & single & heard).alias("is_narration"),
    ]


def speaker_gate(df: DataFrame, cfg: Config, line: Timeline | None = None, compat: bool = False, gaps: bool = False) -> DataFrame:
    """Label every face row.

    Reads ``n_faces``, ``articulating``, ``motion_score``, ``is_valid``, ``hits``,
    ``rejected`` and optionally ``speech_active``; adds ``since_speech``,
    ``conversational_state``, ``role``, ``speaker_probability``, ``level``,
    ``gate_active`` and ``is_narration``.

    A frame with several faces closes the gate when the single-face rule is on; the
    time of the last speech survives it.  Otherwise each articulating face of the
    frame is a speaker (faces of one frame must be adjacent in ``line.order``).
    ``conversational_state`` is null where the gate did not judge the row, unless
    ``compat`` repeats the last judged value.  ``gaps`` also adds ``dt`` and ``is_gap``
    (see :func:`windows.frame_gaps`) in the same pass.
    """
    line = line or timeline(cfg)
    t = line.order[0]
    strict = F.lit(cfg.strict_single_face)
    several = F.col("n_faces") > 1
    counts = F.col("articulating") & ~(strict & several)
    out = scan(df, line, run={"_last": ("max", F.when(counts, F.col(t)))}, prev={"_t0": F.col(t)} if gaps else None)
    tau = F.when(F.col("_last").isNotNull(), F.greatest(F.col(t) - F.col("_last"), F.lit(0)))
    out = out.withColumn("_tau", tau).select(
        *df.columns,
        *(gap_columns(F.col(t), F.col("_t0"), cfg) if gaps else []),
        *gate_labels(cfg, "speech_active" in df.columns),
    )
    if compat:
        seen = F.when(
            F.col("conversational_state").isNotNull(), F.struct(*line.order, "conversational_state")
        )
        out = running(out, line, {"_state": ("max", seen)})
        out = out.withColumn("conversational_state", F.col("_state.conversational_state")).drop("_state")
    return out


def narration_without_face(frames: DataFrame, audio: DataFrame, on=("session_id", "frame_idx")) -> DataFrame:
    """Audio rows heard while no face was visible: ``is_narration`` follows the speech flag."""
    faces = frames.select(*on).distinct()
    alone = audio.join(faces, list(on), "left_anti")
    return alone.withColumn("is_narration", F.col("is_speech"))


def state_seconds(df: DataFrame, key=("session_id",), count_between: bool = True) -> DataFrame:
    """Accumulated ``dt`` of gated single-face rows per session and state."""
    gated = df.filter(F.col("gate_active") & (F.col("n_faces") == 1) & F.col("dt").isNotNull())
    if not count_between:
        gated = gated.filter(F.col("conversational_state") != "BETWEEN_WORDS")
    return gated.groupBy(*key, "conversational_state").agg(F.sum("dt").alias("seconds"))


def gate_filter(df: DataFrame, require_single: bool = True) -> DataFrame:
    """Rows recorded while the gate is open; ``n_faces`` is the face count of the frame."""
    kept = F.col("gate_active")
    return df.filter(kept & (F.col("n_faces") == 1) if require_single else kept)


def with_face_count(df: DataFrame, frame=("session_id", "frame_idx"), name: str = "n_faces") -> DataFrame:
    """Add the number of faces in each row's frame (partial counts, then an equi-join)."""
    counts = df.groupBy(*frame).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, list(frame))
