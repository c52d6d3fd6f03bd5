"""Queries that run the live operators over a table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinetable.functions import text, vision
from kinetable.operators import windows
from kinetable.plans.bindings import CFG, EV, MULTI_US, ROLE_OF_EVENT, micros
from kinetable.plans.queries_catalog import AV, stored_pages
from kinetable.plans.queries_features import SPELL
from kinetable.plans.queries_speech import OVER, UPTO, US, WATCH
from kinetable.plans.registry import query
from kinetable.session import checkpoint_folder
from kinetable.streaming import feeds, live


def _live(spark, sf):
    """Events as a stream of frames."""
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "ACTIVE_SPEECH").when(kind == "click", "CONVERSATIONAL_PAUSE")
    return live.table_stream(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), micros("ts").alias("t"), F.col("event_id").alias("frame_idx"), "event_type", F.col("value").alias("x"), state.alias("state"),
        (F.col("event_id") % 5).cast("int").alias("level"),
    )


@query("stream_gaps", f"""WITH {EV}, d AS (SELECT *, greatest(t - lag(t) {OVER}, CASE WHEN lag(t) {OVER} IS NOT NULL THEN {US['floor']} END) AS dt, coalesce(t - lag(t) {OVER} > {US['gap']}, false) AS is_gap FROM ev)
  SELECT session_id, frame_idx, dt, is_gap, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN dt END) {UPTO}, 0) AS BIGINT) AS speech_seconds, 0::BIGINT AS between_seconds,
  CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN dt END) {UPTO}, 0) AS BIGINT) AS pause_seconds FROM d""")
def _(spark, sf):
    out = live.to_table(live.stream_gaps(_live(spark, sf).select("session_id", "t", "frame_idx", "state"), CFG))
    return out.select("session_id", "frame_idx", "dt", "is_gap", "speech_seconds", "between_seconds", "pause_seconds")


@query("stream_watch", f"""WITH {WATCH}, p AS (SELECT ev.session_id, t, row_number() OVER (PARTITION BY ev.session_id ORDER BY t DESC, frame_idx DESC) AS r FROM ev JOIN watch USING (session_id) WHERE t <= start AND t >= start - {US['preroll']})
  SELECT session_id, 'start' AS event, start AS t FROM watch UNION ALL SELECT session_id, 'stop', stop FROM watch WHERE stop IS NOT NULL UNION ALL SELECT session_id, 'pre_roll', t FROM p WHERE r <= 60""")
def _(spark, sf):
    frames = _live(spark, sf).select(
        "session_id", "t", "frame_idx", F.col("event_type").isin("purchase", "click").alias("usable"), (F.col("event_type") != "error").alias("keep"))
    out = live.to_table(live.stream_watch(frames, CFG))
    return out.select("session_id", "event", "t")


@query("stream_carry", f"WITH {AV} SELECT f.session_id, f.frame_idx, a.x FROM fr f ASOF LEFT JOIN au a ON a.session_id = f.session_id AND a.t <= f.t")
def _(spark, sf):
    rows = _live(spark, sf).withColumnRenamed("frame_idx", "id")
    frames = rows.filter(F.col("event_type") == "purchase").select("session_id", "t", "id")
    audio = rows.filter(F.col("event_type") == "view").select("session_id", "t", "id", "x")
    return live.to_table(live.stream_carry(frames, audio, ["x"])).select("session_id", F.col("id").alias("frame_idx"), "x")


@query("stream_cap", f"""WITH {EV}, u AS (SELECT *, sum(level) {UPTO} - level AS used, row_number() {OVER} - 1 AS taken FROM ev) SELECT session_id, frame_idx FROM u WHERE used < 50 AND taken < 40""")
def _(spark, sf):
    frames = _live(spark, sf).select("session_id", "t", "frame_idx", "level")
    return live.to_table(live.stream_cap(frames, "level", 50, 40)).select("session_id", "frame_idx")


def _detections(spark, sf):
    """Events of a user within half a day are the faces of one frame."""
    frame = F.floor(F.col("t") / MULTI_US).cast("long")
    x, level = F.col("x"), F.col("level")
    return _live(spark, sf).select(
        "session_id", frame.alias("frame_idx"), (frame * MULTI_US).alias("t"), F.col("frame_idx").alias("det_idx"), (x / 500.0).alias("cx"), (level / 5.0).alias("cy"),
        (x / 100.0).alias("mouth"), F.array(x / 500.0, level / 5.0).alias("points"), "event_type",
    )


@query("stream_faces")
def _(spark, sf):
    out = live.to_table(live.stream_faces(_detections(spark, sf), CFG))
    return out.drop("points", "event_type")


@query("stream_frames")
def _(spark, sf):
    faces = live.to_table(live.stream_faces(_detections(spark, sf), CFG))
    rejected = F.col("event_type") == "error"
    score = vision.composite_score(F.lit(1.0), F.col("cx"), F.col("mouth") * 100, F.lit(1.0), F.col("jitter"))
    judged = windows.articulation(faces, CFG).select(
        "session_id", "frame_idx", "t", "det_idx", "face_id", "n_faces", "hits", score.alias("score"), rejected.alias("rejected"), "articulating", "motion_score", "points")
    base = f"{checkpoint_folder(spark)}/faces-{uuid.uuid4().hex}"
    judged.write.parquet(base)
    stream = spark.readStream.schema(judged.schema).parquet(base)
    return live.to_table(live.stream_frames(stream, CFG, smooth="points")).drop("points", "smooth_points")


@query("live_status", f"""WITH {EV}, l AS (SELECT session_id, arg_max(event_type, (t, frame_idx)) AS last, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS session_frames,
  count(*) FILTER (WHERE event_type = 'purchase') * 0.25::DOUBLE AS speech_seconds, count(*) FILTER (WHERE event_type = 'click') * 0.25::DOUBLE AS pause_seconds, 1::INTEGER AS faces_detected, 4.0::DOUBLE AS fps FROM ev GROUP BY session_id)
  SELECT session_id, session_frames, speech_seconds, pause_seconds, faces_detected, fps, CASE last WHEN 'purchase' THEN 'ACTIVE_SPEECH' WHEN 'click' THEN 'CONVERSATIONAL_PAUSE' ELSE 'SILENCE' END AS conversational_state, last IN ('purchase', 'click') AS is_recording,
  CASE last WHEN 'purchase' THEN '[*] RECORDING: ACTIVE SYLLABLE SPEECH' WHEN 'click' THEN '[*] RECORDING: CONVERSATIONAL PAUSE / IDLE' ELSE '[-] WAITING: SILENCE / LISTENER DETECTED (Audio Gate Closed)' END AS badge FROM l""")
def _(spark, sf):
    frames = _live(spark, sf).withColumns({
        "conversational_state": F.coalesce("state", F.lit("SILENCE")), "gate_active": F.col("event_type").isin(*list(ROLE_OF_EVENT)[:2]), "n_faces": F.lit(1), "dt": F.lit(0.25)})
    base = f"{checkpoint_folder(spark)}/status-{uuid.uuid4().hex}"
    feeds.stream_status(frames, f"{base}/rows", f"{base}/progress").awaitTermination()
    out = feeds.status_table(spark, f"{base}/rows")
    return out.select("session_id", "session_frames", "speech_seconds", "pause_seconds", "faces_detected", "fps", "conversational_state", "is_recording", "badge")


@query("stream_queue", f"""WITH {SPELL} SELECT DISTINCT coalesce(CASE WHEN regexp_full_match(trim(spelling), '[0-9A-Za-z_-]{{11}}') THEN trim(spelling) ELSE nullif(regexp_extract(trim(spelling), '{text.ID_PATTERN}', 1), '') END, trim(spelling)) AS key FROM urls""")
def _(spark, sf):
    pages = live.table_stream(spark, sf, "pages")
    video = F.substring(F.md5("url"), 1, 11)
    forms = F.array(
        F.concat(F.lit("https://www.youtube.com/watch?v="), video), F.concat(F.lit("https://youtu.be/"), video), video, F.col("url"))
    urls = pages.select(F.col("page_id").alias("pos"), F.explode(forms).alias("url"))
    registry = stored_pages(spark, sf).withColumns({
        "title": F.col("key"), "last_session": F.col("key"), "total_frames": F.col("pos"), "total_duration_seconds": F.col("pos").cast("double")})
    base = f"{checkpoint_folder(spark)}/queue-{uuid.uuid4().hex}"
    feeds.stream_queue(urls, registry, f"{base}/rows", f"{base}/progress").awaitTermination()
    return feeds.queue_table(spark, f"{base}/rows", feeds.QUEUE_SCHEMA).select("key")
