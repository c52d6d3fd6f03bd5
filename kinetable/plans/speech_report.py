"""Gaps, speech gate, state totals and progress per session, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.operators.ordered import Timeline
from kinetable.operators.speech import speaker_gate

STATES = ("ACTIVE_SPEECH", "BETWEEN_WORDS", "CONVERSATIONAL_PAUSE", "SILENCE")


def speech_report(frames: DataFrame, cfg: Config, line: Timeline) -> DataFrame:
    """One row per session: frames, gaps, time per state, and its share of a 30-minute target."""
    gated = speaker_gate(frames, cfg, line, gaps=True)
    state = F.col("conversational_state")
    totals = gated.groupBy(*line.key).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("is_gap").alias("gaps"),
        *[
            F.coalesce(F.sum(F.when(state == s, F.col("dt"))), F.lit(0)).alias(s.lower())
            for s in STATES
        ],
        F.max(line.order[0]).alias("_t1"),
        F.min(line.order[0]).alias("_t0"),
    )
    target = F.lit(cfg.span(1800.0))
    share = (F.col("_t1") - F.col("_t0")) / target * 100.0
    return totals.withColumn("progress_pct", F.least(F.lit(100.0), share)).drop("_t0", "_t1")
