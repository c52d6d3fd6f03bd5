"""Queries of the event-time operators, over the events replayed out of order in waves of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators import windows
from kinetable.plans.bindings import CFG, DAY_US, EV, LINE, ev_frames
from kinetable.plans.queries_speech import OVER, UPTO, US
from kinetable.plans.queries_state import ROWS, STEP
from kinetable.plans.registry import query
from kinetable.session import checkpoint_folder
from kinetable.streaming import event_time, live
from kinetable.streaming.event_time import Lateness

WAVES, SPREAD_DAYS, FILE_ROWS = 5, 2, 1_000_000
#: Rows arrive up to two days after others of their time.
SHIFT = f"frame_idx * 7919 % {SPREAD_DAYS * 86_400} * 1000000"
WHEN = "timestamp_micros(t)"
LATENESS = Lateness(WHEN, f"{SPREAD_DAYS} days")


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream in five waves, each with rows out of order by up to two days.

    A sixth wave has two rows of a session of their own, a month later, with which the stream
    closes: the watermark passes all others.
    """
    rows = ev_frames(spark, sf).select("session_id", "frame_idx", "t", "x", "event_type", "level")
    place = F.col("t") + F.expr(SHIFT)
    span = rows.agg(F.min(place).alias("low"), (F.max(place) + 1).alias("high"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    wave = F.floor((place - F.col("low")) * WAVES / (F.col("high") - F.col("low"))).cast("int")
    base = f"{checkpoint_folder(spark)}/waves-{uuid.uuid4().hex}"
    dealt = rows.join(F.broadcast(span), F.lit(True)).withColumn("wave", wave)  # one row
    total = span.first()
    files = total.n // WAVES // FILE_ROWS + 1
    for k in range(WAVES):
        dealt.filter(F.col("wave") == k).select(*rows.columns).repartition(files).write.parquet(f"{base}/{k}")
    end = spark.createDataFrame([(-1, -1 - i, (total.last or 0) + 30 * DAY_US, None, kind, 0) for i, kind in enumerate(("purchase", "view"))], rows.schema)
    end.coalesce(1).write.parquet(f"{base}/end")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    return source.parquet(base)


def _on_time(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_late")).drop("is_late")


@query("stream_gaps_unordered", f"""WITH {EV}, d AS (SELECT *, greatest(t - lag(t) {OVER}, CASE WHEN lag(t) {OVER} IS NOT NULL THEN {US['floor']} END) AS dt, coalesce(t - lag(t) {OVER} > {US['gap']}, false) AS is_gap FROM ev)
  SELECT session_id, frame_idx, dt, is_gap, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN dt END) {UPTO}, 0) AS BIGINT) AS speech_seconds,
  CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN dt END) {UPTO}, 0) AS BIGINT) AS pause_seconds, false AS is_late FROM d""")
def _(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "ACTIVE_SPEECH").when(kind == "click", "CONVERSATIONAL_PAUSE")
    frames = replayed(spark, sf).select("session_id", "t", "frame_idx", state.alias("state"))
    out = live.to_table(live.stream_gaps(frames, CFG, lateness=LATENESS))
    return out.select("session_id", "frame_idx", "dt", "is_gap", "speech_seconds", "pause_seconds", "is_late")


# The watermark of a wave is half a day behind the newest row of the waves before it.
WAVED = f"""{EV}, p AS (SELECT *, t + {SHIFT} AS place FROM ev),
  v AS (SELECT p.*, CAST(floor((place - low) * {WAVES} / (high - low)) AS INTEGER) AS wave FROM p, (SELECT min(place) AS low, max(place) + 1 AS high FROM p)),
  m AS (SELECT wave, max(max(t // 1000)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000 AS mark FROM v GROUP BY wave)"""


@query("stream_late_rows", f"""WITH {WAVED} SELECT session_id, count(*) FILTER (WHERE NOT coalesce(t // 1000 <= mark, false)) AS on_time, count(*) FILTER (WHERE t // 1000 <= mark) AS late FROM v JOIN m USING (wave) GROUP BY session_id""")
def _(spark, sf):
    frames = replayed(spark, sf).select("session_id", "t", "frame_idx")
    rows = event_time.in_order(frames, event_time.passed, ["t", "frame_idx"], {}, [], Lateness(WHEN, "12 hours"))
    return event_time.late_counts(live.to_table(rows))


def _windows(rows: DataFrame) -> DataFrame:
    edges = [F.unix_micros(c).alias(c) for c in ("window_start", "window_end")]
    return rows.select("session_id", *edges, "n_rows", "total").filter("session_id >= 0")


@query("stream_sliding_windows", f"""WITH {EV}, w AS (SELECT session_id, level, unnest([t // {DAY_US} - 1, t // {DAY_US}]) * {DAY_US} AS window_start FROM ev)
  SELECT session_id, window_start, window_start + {2 * DAY_US} AS window_end, count(*) AS n_rows, CAST(sum(level) AS BIGINT) AS total FROM w GROUP BY session_id, window_start""")
def _(spark, sf):
    rows = event_time.windowed_counts(replayed(spark, sf), LATENESS, width="2 days", slide="1 day", values=[F.sum("level").alias("total")])
    return _windows(live.to_table(rows))


@query("stream_session_windows", f"""WITH {EV}, g AS (SELECT *, CASE WHEN t - lag(t) {OVER} <= {DAY_US // 4} THEN 0 ELSE 1 END AS opens FROM ev), n AS (SELECT *, sum(opens) {UPTO} AS s FROM g)
  SELECT session_id, min(t) AS window_start, max(t) + {DAY_US // 4} AS window_end, count(*) AS n_rows, CAST(sum(level) AS BIGINT) AS total FROM n GROUP BY session_id, s""")
def _(spark, sf):
    rows = event_time.windowed_counts(replayed(spark, sf), LATENESS, gap="6 hours", values=[F.sum("level").alias("total")])
    return _windows(live.to_table(rows))


@query("stream_latest_audio", f"""WITH {EV} SELECT f.session_id, f.frame_idx, CASE WHEN f.t - a.t <= {3 * DAY_US} THEN a.x END AS x FROM (SELECT * FROM ev WHERE event_type = 'purchase') f
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') a ON a.session_id = f.session_id AND a.t <= f.t""")
def _(spark, sf):
    rows = replayed(spark, sf).withColumnRenamed("frame_idx", "id")
    frames, audio = rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'view'")
    out = live.to_table(event_time.latest_within(frames, audio, ["x"], LATENESS, "3 days"))
    return out.filter("session_id >= 0").select("session_id", F.col("id").alias("frame_idx"), "x")


@query("stream_carry_unordered", f"""WITH {EV} SELECT f.session_id, f.frame_idx, a.x FROM (SELECT * FROM ev WHERE event_type = 'purchase') f
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') a ON a.session_id = f.session_id AND a.t <= f.t""")
def _(spark, sf):
    rows = replayed(spark, sf).withColumnRenamed("frame_idx", "id")
    frames, audio = rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'view'")
    out = _on_time(live.to_table(live.stream_carry(frames, audio, ["x"], lateness=LATENESS)))
    return out.select("session_id", F.col("id").alias("frame_idx"), "x")


# The watch that begins anew after each loss, row by row.
AGAIN = f"""RECURSIVE {ROWS}, e AS (SELECT *, event_type IN ('purchase', 'click') AS on1, event_type <> 'error' AS keep1 FROM o),
  r AS (SELECT session_id, 0::BIGINT AS rn, NULL::BIGINT AS t, false AS rec, NULL::BIGINT AS run, NULL::BIGINT AS seen, 0::BIGINT AS recording, NULL::VARCHAR AS event FROM e WHERE rn = 1
  UNION ALL SELECT session_id, rn, t, CASE WHEN up THEN true WHEN down THEN false ELSE rec END, CASE WHEN NOT rec AND on1 THEN coalesce(run, t) END, CASE WHEN up OR (rec AND keep1) THEN t ELSE seen END,
    recording + CASE WHEN up THEN 1 ELSE 0 END, CASE WHEN up THEN 'start' WHEN down THEN 'stop' END FROM (
    SELECT o.session_id, o.rn, o.t, o.on1, o.keep1, r.rec, r.run, r.seen, r.recording, NOT r.rec AND o.on1 AND coalesce(o.t - r.run >= {US['trigger']}, false) AS up,
      r.rec AND NOT o.keep1 AND o.t - r.seen >= {US['loss']} AS down {STEP.replace('JOIN o', 'JOIN e AS o')}))"""


@query("watch_again", f"""WITH {AGAIN} SELECT session_id, recording, max(CASE WHEN event = 'start' THEN t END) AS start, max(CASE WHEN event = 'stop' THEN t END) AS stop
  FROM r WHERE event IS NOT NULL GROUP BY session_id, recording""")
def _(spark, sf):
    on = F.col("event_type").isin("purchase", "click")
    return windows.watch_sessions(ev_frames(spark, sf), CFG, on, F.col("event_type") != "error", LINE, rearm=True)


@query("stream_watch_again", f"WITH {AGAIN} SELECT session_id, event, t FROM r WHERE event IS NOT NULL")
def _(spark, sf):
    frames = replayed(spark, sf).select(
        "session_id", "t", "frame_idx", F.col("event_type").isin("purchase", "click").alias("usable"), (F.col("event_type") != "error").alias("keep"))
    out = _on_time(live.to_table(live.stream_watch(frames, CFG, rearm=True, lateness=LATENESS)))
    return out.filter("event <> 'pre_roll'").select("session_id", "event", "t")
