"""Views that give the driver tables the shapes the operators expect.

Each view exists twice: as a DataFrame and as the SQL text of the same view, so a
query and its SQL counterpart start from the same rows.  One second of session
time stands for one day of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.operators.ordered import Timeline

DAY_US = 86_400_000_000
CFG = Config(unit=DAY_US, slice_s=7.0, gap_s=1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


ROLE_OF_EVENT = {"purchase": "SPEAKER", "click": "SPEAKER_PAUSE", "view": "LISTENER", "signup": "UNKNOWN"}


def ev_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a user is a session, the event type its role."""
    role = F.lit(None).cast("string")
    for kind, label in ROLE_OF_EVENT.items():
        role = F.when(F.col("event_type") == kind, label).otherwise(role)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("frame_idx"),
        micros("ts").alias("t"),
        F.col("value").alias("x"),
        "event_type",
        role.alias("role"),
        (F.col("event_id") % 5).cast("int").alias("level"),
        (F.col("event_id") % 4).cast("int").alias("face_id"),
        (F.col("event_id") % 3 == 0).alias("is_primary"),
    )


EV = """ev AS (SELECT user_id AS session_id, event_id AS frame_idx, epoch_us(ts) AS t, value AS x, event_type,
  CASE event_type WHEN 'purchase' THEN 'SPEAKER' WHEN 'click' THEN 'SPEAKER_PAUSE' WHEN 'view' THEN 'LISTENER'
    WHEN 'signup' THEN 'UNKNOWN' END AS role,
  CAST(event_id % 5 AS INTEGER) AS level, CAST(event_id % 4 AS INTEGER) AS face_id, event_id % 3 = 0 AS is_primary
  FROM events)"""

LINE = Timeline(("session_id",), ("t", "frame_idx"), CFG.span(CFG.slice_s))
# Recursions: two slices per session, so that states are handed over once.
FOLD_LINE = Timeline(("session_id",), ("t", "frame_idx"), CFG.span(16.0))

MULTI_US = DAY_US // 2


def ev_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as faces: all events of a user within half a day share one frame."""
    frame = F.floor(F.col("t") / MULTI_US).cast("long")
    return ev_frames(spark, sf_dir).select(
        "session_id", frame.alias("frame_idx"), (frame * MULTI_US).alias("t"),
        F.col("frame_idx").alias("det_idx"), "x", "event_type", "role", "level", "face_id",
    )


FACES = f"""faces AS (SELECT session_id, t // {MULTI_US} AS frame_idx, (t // {MULTI_US}) * {MULTI_US} AS t,
  frame_idx AS det_idx, x, event_type, role, level, face_id FROM ev)"""

FACE_LINE = Timeline(("session_id",), ("t", "det_idx"), CFG.span(CFG.slice_s))
FACE_FOLD_LINE = Timeline(("session_id",), ("t", "det_idx"), CFG.span(16.0))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("session_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("v")
    )


VEC = "vec AS (SELECT label AS session_id, vec_id AS frame_idx, embedding AS v FROM embeddings)"

VEC_LINE = Timeline(("session_id",), ("frame_idx",), 200)
VEC_GLOBAL = Timeline((), ("frame_idx",), 100)
EV_GLOBAL = Timeline((), ("frame_idx",), 500)
