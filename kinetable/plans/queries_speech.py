"""Queries over events as frames: filters, gaps, gates, sliding frames, sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from kinetable.operators import filters, speech, windows
from kinetable.operators.ordered import Timeline, row_index
from kinetable.plans.bindings import (
    CFG, DAY_US, EV, EV_GLOBAL, FACE_LINE, FACES, LINE, MULTI_US, ev_faces, ev_frames, micros, table,
)
from kinetable.plans.registry import query
from kinetable.plans.speech_report import STATES, speech_report

US = {name: CFG.span(value) for name, value in {
    "hold": 0.25, "word": 0.55, "limit": 1.80, "gap": 1.0, "floor": 1e-4, "trigger": 0.30, "loss": 1.80,
    "window": 0.40, "preroll": 2.0,
}.items()}
OVER = "OVER (PARTITION BY session_id ORDER BY t, frame_idx)"
UPTO = "OVER (PARTITION BY session_id ORDER BY t, frame_idx ROWS UNBOUNDED PRECEDING)"

# F: filters

@query("filter_frames", f"""WITH {EV} SELECT session_id, frame_idx, level, face_id, role FROM ev
  WHERE level >= 3 AND role = 'SPEAKER' AND is_primary""")
def _(spark, sf):
    out = filters.filter_frames(ev_frames(spark, sf), min_level=3, role="SPEAKER", primary_only=True)
    return out.select("session_id", "frame_idx", "level", "face_id", "role")


@query("accept_frames", f"""WITH {EV}, m AS (SELECT *, coalesce(role IN ('SPEAKER','SPEAKER_PAUSE'), false) AS hit FROM ev),
  a AS (SELECT *, bool_or(hit) OVER (PARTITION BY session_id) AS has FROM m)
  SELECT session_id, frame_idx, role FROM a WHERE hit OR NOT has""")
def _(spark, sf):
    return filters.accept_frames(ev_frames(spark, sf)).select("session_id", "frame_idx", "role")


@query("min_frames_gate", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
  SELECT session_id, frame_idx FROM n WHERE n >= 65""")
def _(spark, sf):
    return filters.min_frames_gate(ev_frames(spark, sf), 65).select("session_id", "frame_idx")


@query("rest_frames", f"""WITH {EV}, r AS (SELECT *, coalesce(role LIKE '%PAUSE%' OR role LIKE '%LISTENER%', false)
    OR NOT (x > 0.08) AS rest FROM ev), c AS (SELECT *, sum(CASE WHEN rest THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS k FROM r)
  SELECT session_id, frame_idx, role, x FROM c WHERE rest OR k < 5""")
def _(spark, sf):
    rest = filters.is_rest(F.col("role"), F.col("x"), None, None)
    return filters.rest_frames(ev_frames(spark, sf), rest).select("session_id", "frame_idx", "role", "x")


@query("gate_filter", f"""WITH {EV}, {FACES}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id, frame_idx) AS n_faces FROM faces)
  SELECT session_id, frame_idx, det_idx FROM n WHERE n_faces = 1 AND role IN ('SPEAKER','SPEAKER_PAUSE')""")
def _(spark, sf):
    rows = speech.with_face_count(ev_faces(spark, sf)).withColumn("gate_active", filters.accepted_role(F.col("role")))
    return speech.gate_filter(rows).select("session_id", "frame_idx", "det_idx")


# W1, W3, W11, W9

@query("frame_gaps", f"""WITH {EV}, d AS (SELECT *, t - lag(t) {OVER} AS d FROM ev)
  SELECT session_id, frame_idx, greatest(d, {US['floor']}) AS dt, coalesce(d > {US['gap']}, false) AS is_gap FROM d WHERE d IS NOT NULL
  UNION ALL SELECT session_id, frame_idx, NULL, false FROM d WHERE d IS NULL""")
def _(spark, sf):
    return windows.frame_gaps(ev_frames(spark, sf), CFG, LINE).select("session_id", "frame_idx", "dt", "is_gap")


@query("mouth_velocity", f"""WITH {EV}, d AS (SELECT *, lag(x) {OVER} AS x0, (t - lag(t) {OVER}) / {DAY_US}.0::DOUBLE AS dt FROM ev)
  SELECT session_id, frame_idx, CASE WHEN dt > 1e-4 THEN abs(x - x0) / dt ELSE 0.0 END AS velocity FROM d""")
def _(spark, sf):
    return windows.velocity(ev_frames(spark, sf), CFG, "x", line=LINE).select("session_id", "frame_idx", "velocity")


@query("monotonic_ms", f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() {OVER} AS rn,
    CAST(round_even(t / {DAY_US}.0::DOUBLE * 1000, 0) AS BIGINT) AS ms FROM ev),
  r AS (SELECT session_id, frame_idx, rn, greatest(0, ms) AS ts_ms FROM o WHERE rn = 1
    UNION ALL SELECT o.session_id, o.frame_idx, o.rn, greatest(r.ts_ms + 1, o.ms) FROM r JOIN o ON o.session_id = r.session_id AND o.rn = r.rn + 1)
  SELECT session_id, frame_idx, ts_ms FROM r""")
def _(spark, sf):
    return windows.monotonic_ms(ev_frames(spark, sf), CFG, LINE).select("session_id", "frame_idx", "ts_ms")


@query("hit_count", f"""WITH {EV} SELECT session_id, face_id, frame_idx,
  row_number() OVER (PARTITION BY session_id, face_id ORDER BY t, frame_idx) AS hits FROM ev""")
def _(spark, sf):
    line = Timeline(("session_id", "face_id"), ("t", "frame_idx"), LINE.width)
    return windows.hit_count(ev_frames(spark, sf), CFG, line=line).select("session_id", "face_id", "frame_idx", "hits")


# W4, W5

def _windowed(spark, sf):
    frames = ev_frames(spark, sf).withColumn("mouth", F.col("x") / 100.0)
    return windows.mouth_window(windows.velocity(frames, CFG, "mouth", line=LINE), CFG, line=LINE)


MOUTH = f"""{EV}, d AS (SELECT *, x / 100.0::DOUBLE AS mouth, lag(x / 100.0::DOUBLE) {OVER} AS m0, (t - lag(t) {OVER}) / {DAY_US}.0::DOUBLE AS dt,
    row_number() {OVER} AS rn FROM ev),
  v AS (SELECT *, CASE WHEN dt > 1e-4 THEN abs(mouth - m0) / dt ELSE 0.0 END AS velocity FROM d),
  w AS (SELECT a.session_id, a.frame_idx, list(b.velocity ORDER BY b.rn) AS vs, list(b.mouth) AS ms FROM v a JOIN v b
    ON b.session_id = a.session_id AND b.rn BETWEEN a.rn - 29 AND a.rn AND a.t - b.t <= {US['window']} GROUP BY ALL),
  mw AS (SELECT session_id, frame_idx, list_reduce(list_prepend(0.0::DOUBLE, vs), lambda p, q: p + q) / len(vs) AS mean_velocity,
    CASE WHEN len(ms) >= 2 THEN list_max(ms) - list_min(ms) ELSE 0.0 END AS mouth_range, list_max(ms) AS mouth_peak FROM w)"""


@query("mouth_window", f"WITH {MOUTH} SELECT * FROM mw")
def _(spark, sf):
    return _windowed(spark, sf).select("session_id", "frame_idx", "mean_velocity", "mouth_range", "mouth_peak")


@query("articulation", f"""WITH {MOUTH} SELECT session_id, frame_idx, mean_velocity >= 0.16 AND mouth_range >= 0.012 AND mouth_peak >= 0.018 AS articulating,
  least(1.0::DOUBLE, mean_velocity / {0.16 * 2.2!r}::DOUBLE) AS motion_score FROM mw""")
def _(spark, sf):
    return windows.articulation(_windowed(spark, sf), CFG).select("session_id", "frame_idx", "articulating", "motion_score")


# W6, W7, W8, T8, A20

def _gate_input(frames):
    return frames.withColumns({
        "n_faces": F.lit(1), "articulating": F.col("event_type") == "purchase",
        "motion_score": F.least(F.lit(1.0), F.col("x") / 100.0), "is_valid": F.col("level") >= 1,
        "hits": F.lit(1), "rejected": F.col("event_type") == "error", "speech_active": F.col("event_type") == "view",
    })


GATE = f"""{EV}, g0 AS (SELECT *, event_type = 'purchase' AS art, least(1.0::DOUBLE, x / 100.0::DOUBLE) AS m, level >= 1 AS ok FROM ev),
  g1 AS (SELECT *, t - max(CASE WHEN art THEN t END) {UPTO} AS tau, t - lag(t) {OVER} AS d FROM g0),
  gate AS (SELECT *, CASE WHEN art OR tau <= {US['hold']} THEN 'ACTIVE_SPEECH' WHEN tau <= {US['word']} THEN 'BETWEEN_WORDS'
    WHEN tau <= {US['limit']} THEN 'CONVERSATIONAL_PAUSE' ELSE 'SILENCE' END AS state FROM g1)"""


@query("speaker_gate", f"""WITH {GATE} SELECT session_id, frame_idx, tau AS since_speech, state AS conversational_state,
  CASE state WHEN 'ACTIVE_SPEECH' THEN 'SPEAKER' WHEN 'BETWEEN_WORDS' THEN 'SPEAKER' WHEN 'CONVERSATIONAL_PAUSE' THEN 'SPEAKER_PAUSE'
    ELSE CASE WHEN ok THEN 'LISTENER' ELSE 'UNKNOWN' END END AS role,
  CASE state WHEN 'ACTIVE_SPEECH' THEN CASE WHEN ok THEN 4 ELSE 2 END WHEN 'BETWEEN_WORDS' THEN CASE WHEN ok THEN 4 ELSE 2 END
    WHEN 'CONVERSATIONAL_PAUSE' THEN CASE WHEN ok THEN 3 ELSE 2 END ELSE CASE WHEN ok THEN 3 ELSE 0 END END AS level,
  state <> 'SILENCE' AS gate_active FROM gate""")
def _(spark, sf):
    return _gated(spark, sf).select(
        "session_id", "frame_idx", "since_speech", "conversational_state", "role", "level", "gate_active"
    )


def _gated(spark, sf):
    frames = _gate_input(ev_frames(spark, sf)).drop("role", "level")
    return speech.speaker_gate(frames, CFG, LINE)


@query("speaker_probability", f"""WITH {GATE} SELECT session_id, frame_idx, round_even(CASE state
  WHEN 'ACTIVE_SPEECH' THEN least(0.99::DOUBLE, greatest(0.75::DOUBLE, m)) WHEN 'BETWEEN_WORDS' THEN greatest(0.70::DOUBLE, m * 0.85::DOUBLE)
  WHEN 'CONVERSATIONAL_PAUSE' THEN greatest(0.60::DOUBLE, m * 0.75::DOUBLE) ELSE m * 0.15::DOUBLE END * 1000, 0) / 1000 AS speaker_probability FROM gate""")
def _(spark, sf):
    return _gated(spark, sf).select("session_id", "frame_idx", "speaker_probability")


@query("narration_without_face", f"""WITH {EV} SELECT a.session_id, a.frame_idx, a.x > 100 AS is_narration FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev f WHERE f.session_id = a.session_id AND f.t // {MULTI_US} = a.t // {MULTI_US} AND f.event_type <> 'view') AND a.event_type = 'view'""")
def _(spark, sf):
    """Views are audio slices; a half day without any other event of the user is one without a face."""
    rows = ev_frames(spark, sf).withColumn("half", F.floor(F.col("t") / MULTI_US))
    audio = rows.filter("event_type = 'view'").withColumn("is_speech", F.col("x") > 100)
    out = speech.narration_without_face(rows.filter("event_type <> 'view'"), audio, on=("session_id", "half"))
    return out.select("session_id", "frame_idx", "is_narration")


@query("narration", f"""WITH {GATE} SELECT session_id, frame_idx, state = 'SILENCE' AND event_type = 'view' AS is_narration FROM gate""")
def _(spark, sf):
    return _gated(spark, sf).select("session_id", "frame_idx", "is_narration")


@query("state_seconds", f"""WITH {GATE} SELECT session_id, state AS conversational_state,
  CAST(sum(greatest(d, {US['floor']})) AS BIGINT) AS seconds FROM gate WHERE state <> 'SILENCE' AND d IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    frames = _gate_input(ev_frames(spark, sf)).drop("role", "level")
    return speech.state_seconds(speech.speaker_gate(frames, CFG, LINE, gaps=True))


@query("state_seconds_no_between", f"""WITH {GATE} SELECT session_id, state AS conversational_state,
  CAST(sum(greatest(d, {US['floor']})) AS BIGINT) AS seconds FROM gate WHERE state IN ('ACTIVE_SPEECH', 'CONVERSATIONAL_PAUSE')
  AND d IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    frames = _gate_input(ev_frames(spark, sf)).drop("role", "level")
    gated = speech.speaker_gate(frames, CFG, LINE, gaps=True)
    return speech.state_seconds(gated, count_between=False)


def _face_input(spark, sf):
    rows = speech.with_face_count(ev_faces(spark, sf))
    return rows.withColumns({
        "articulating": F.col("event_type") == "purchase", "motion_score": F.least(F.lit(1.0), F.col("x") / 100.0),
        "is_valid": F.col("level") >= 1, "hits": F.col("level") + 3, "rejected": F.col("event_type") == "error",
    }).drop("role", "level")


FGATE = f"""{EV}, {FACES}, f0 AS (SELECT *, count(*) OVER (PARTITION BY session_id, frame_idx) AS n_faces, event_type = 'purchase' AS art,
    level >= 1 AS ok, level + 3 AS hits, event_type = 'error' AS rejected FROM faces)"""
FUPTO = "OVER (PARTITION BY session_id ORDER BY t, det_idx ROWS UNBOUNDED PRECEDING)"


@query("multi_face_rule", f"""WITH {FGATE}, f1 AS (SELECT *, t - max(CASE WHEN art AND n_faces = 1 THEN t END) {FUPTO} AS tau FROM f0),
  f2 AS (SELECT *, CASE WHEN n_faces > 1 THEN 'M' WHEN art OR tau <= {US['hold']} THEN 'A' WHEN tau <= {US['word']} THEN 'B'
    WHEN tau <= {US['limit']} THEN 'P' ELSE 'S' END AS s FROM f1)
  SELECT session_id, det_idx, CASE s WHEN 'M' THEN 'LISTENER' WHEN 'A' THEN 'SPEAKER' WHEN 'B' THEN 'SPEAKER' WHEN 'P' THEN 'SPEAKER_PAUSE'
    ELSE CASE WHEN ok THEN 'LISTENER' ELSE 'UNKNOWN' END END AS role,
  CASE s WHEN 'M' THEN CASE WHEN hits < 5 THEN 0 WHEN rejected THEN 1 ELSE 2 END WHEN 'P' THEN CASE WHEN ok THEN 3 ELSE 2 END
    WHEN 'S' THEN CASE WHEN ok THEN 3 ELSE 0 END ELSE CASE WHEN ok THEN 4 ELSE 2 END END AS level, s IN ('A', 'B', 'P') AS gate_active FROM f2""")
def _(spark, sf):
    return speech.speaker_gate(_face_input(spark, sf), CFG, FACE_LINE).select(
        "session_id", "det_idx", "role", "level", "gate_active"
    )


@query("multi_face_gate", f"""WITH {FGATE}, f1 AS (SELECT *, t - max(CASE WHEN art THEN t END) {FUPTO} AS tau FROM f0),
  f2 AS (SELECT *, CASE WHEN art THEN 'A' WHEN n_faces > 1 THEN 'S' WHEN tau <= {US['hold']} THEN 'A' WHEN tau <= {US['word']} THEN 'B'
    WHEN tau <= {US['limit']} THEN 'P' ELSE 'S' END AS s FROM f1)
  SELECT session_id, det_idx, CASE s WHEN 'A' THEN 'SPEAKER' WHEN 'B' THEN 'SPEAKER' WHEN 'P' THEN 'SPEAKER_PAUSE'
    ELSE CASE WHEN ok THEN 'LISTENER' ELSE 'UNKNOWN' END END AS role,
  CASE s WHEN 'P' THEN CASE WHEN ok THEN 3 ELSE 2 END WHEN 'S' THEN CASE WHEN ok THEN 3 ELSE 0 END ELSE CASE WHEN ok THEN 4 ELSE 2 END END AS level FROM f2""")
def _(spark, sf):
    cfg = replace(CFG, strict_single_face=False)
    return speech.speaker_gate(_face_input(spark, sf), cfg, FACE_LINE).select("session_id", "det_idx", "role", "level")


@query("primary_face", f"""WITH {EV}, {FACES}, s AS (SELECT *, x / 500.0::DOUBLE * 0.5::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt((x / 500.0::DOUBLE - 0.5::DOUBLE)
    * (x / 500.0::DOUBLE - 0.5::DOUBLE) + (level / 10.0::DOUBLE - 0.5::DOUBLE) * (level / 10.0::DOUBLE - 0.5::DOUBLE)) / 0.707::DOUBLE) * 0.3::DOUBLE + least(face_id, 30) / 30.0::DOUBLE * 0.2::DOUBLE AS score FROM faces)
  SELECT session_id, frame_idx, det_idx, row_number() OVER (PARTITION BY session_id, frame_idx ORDER BY score DESC, det_idx) = 1 AS is_primary FROM s""")
def _(spark, sf):
    rows = ev_faces(spark, sf).withColumns(
        {"area": F.col("x") / 500.0, "cx": F.col("x") / 500.0, "cy": F.col("level") / 10.0, "hits": F.col("face_id")}
    )
    return windows.primary_face(rows).select("session_id", "frame_idx", "det_idx", "is_primary")


# W13 to W21

@query("lag_features", f"""WITH {EV} SELECT session_id, frame_idx, [{", ".join(
    (f"coalesce(lag({c}, {k}) {OVER}, 0.0::DOUBLE)" if k else c) for k in range(16) for c in ("x", "level::DOUBLE"))}] || list_transform(range(32), lambda i: 0.0::DOUBLE) AS features FROM ev""")
def _(spark, sf):
    frames = ev_frames(spark, sf).withColumn("level", F.col("level").cast("double"))
    return windows.lag_features(frames, LINE, "x", "level", width=40).select("session_id", "frame_idx", "features")


def _sequence_sql(source, partition, order, length, stride, value):
    keys = f"{partition}, " if partition else ""
    over = f"OVER ({'PARTITION BY ' + partition if partition else ''} ORDER BY {order})"
    total = f"OVER ({'PARTITION BY ' + partition if partition else ''})"
    return f"""i AS (SELECT {keys}{value} AS val, row_number() {over} - 1 AS i, count(*) {total} AS n FROM {source}),
  s AS (SELECT {keys}i, val, unnest(range(greatest(0, CAST(ceil((i - {length - 1}) / {stride}.0) AS BIGINT)), i // {stride} + 1)) AS seq, n FROM i)
  SELECT {keys}seq, count(*) AS n_rows, list(val ORDER BY i) AS rows FROM s WHERE seq < greatest(1, (n - {length}) // {stride}) GROUP BY {keys}seq"""


@query("sequence_windows", f"WITH {EV}, " + _sequence_sql("ev", "session_id", "t, frame_idx", 16, 4, "frame_idx"))
def _(spark, sf):
    out = windows.sequence_windows(ev_frames(spark, sf), LINE, F.col("frame_idx"), 16, 4)
    return out.withColumn("n_rows", F.col("n_rows").cast("long"))


@query("sequence_windows_global", f"WITH {EV}, " + _sequence_sql("ev", "", "frame_idx", 64, 16, "x"))
def _(spark, sf):
    out = windows.sequence_windows(ev_frames(spark, sf), EV_GLOBAL, F.col("x"))
    return out.withColumn("n_rows", F.col("n_rows").cast("long"))


@query("best_segment", f"""WITH {EV}, c AS (SELECT session_id, CAST(round(x * 100) AS BIGINT) AS c, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ev),
  s AS (SELECT session_id, i, n, sum(c) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM c),
  b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, i) AS r FROM s WHERE i % 5 = 0 AND i < n - 20)
  SELECT session_id, i AS start, CAST(s AS BIGINT) AS segment_sum FROM b WHERE r = 1
  UNION ALL SELECT session_id, 0, NULL FROM c GROUP BY session_id HAVING max(n) <= 20""")
def _(spark, sf):
    frames = ev_frames(spark, sf).withColumn("cents", F.round(F.col("x") * 100).cast("long"))
    return windows.best_segment(frames, LINE, "cents", length=20, step=5, width=40)


@query("differences", f"""WITH {EV} SELECT session_id, frame_idx, x - lag(x) {OVER} AS diff1,
  (x - lag(x) {OVER}) - (lag(x) {OVER} - lag(x, 2) {OVER}) AS diff2 FROM ev""")
def _(spark, sf):
    return windows.differences(ev_frames(spark, sf), LINE, "x", width=40).select("session_id", "frame_idx", "diff1", "diff2")


@query("round_robin", """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 7 AS part FROM orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", micros("o_orderdate").alias("t"))
    line = Timeline((), ("t", "o_orderkey"), 1)
    return windows.round_robin(orders, 7, line).select("o_orderkey", "part")


@query("tail_split", f"""WITH {EV}, n AS (SELECT *, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
  SELECT session_id, frame_idx, i < floor(n * 0.85::DOUBLE) AS is_train FROM n""")
def _(spark, sf):
    return windows.tail_split(ev_frames(spark, sf), LINE).select("session_id", "frame_idx", "is_train")


@query("throughput", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC) AS r FROM ev),
  a AS (SELECT session_id, count(*) AS n, (max(t) - min(t)) / {DAY_US}.0::DOUBLE AS s, sum(level) / CAST(count(*) AS DOUBLE) AS l FROM r WHERE r <= 60 GROUP BY session_id)
  SELECT session_id, n, CASE WHEN n >= 2 AND s > 0 THEN (n - 1) / s ELSE 0.0 END AS capture_fps, l AS avg_latency, CASE WHEN l > 0 THEN 1000.0::DOUBLE / l ELSE 0.0 END AS inference_fps FROM a""")
def _(spark, sf):
    return windows.throughput(ev_frames(spark, sf), ["session_id"], "t", "level", CFG)


WATCH = f"""{EV}, w0 AS (SELECT session_id, frame_idx, t, event_type IN ('purchase', 'click') AS on1, event_type <> 'error' AS keep1 FROM ev),
  w1 AS (SELECT *, max(CASE WHEN NOT on1 THEN t END) {UPTO} AS off_t FROM w0),
  w2 AS (SELECT *, min(CASE WHEN on1 THEN t END) OVER (PARTITION BY session_id, off_t) AS run FROM w1),
  st AS (SELECT session_id, min(t) AS start FROM w2 WHERE on1 AND t - run >= {US['trigger']} GROUP BY session_id),
  w3 AS (SELECT w0.*, st.start, greatest(st.start, max(CASE WHEN keep1 THEN t END) OVER (PARTITION BY w0.session_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS seen
    FROM w0 JOIN st USING (session_id) WHERE t > start),
  en AS (SELECT session_id, min(t) AS stop FROM w3 WHERE NOT keep1 AND t - seen >= {US['loss']} GROUP BY session_id),
  watch AS (SELECT st.session_id, start, stop FROM st LEFT JOIN en USING (session_id))"""


def _watch(spark, sf):
    on = F.col("event_type").isin("purchase", "click")
    return windows.watch_sessions(ev_frames(spark, sf), CFG, on, F.col("event_type") != "error", LINE)


@query("watch_sessions", f"WITH {WATCH} SELECT * FROM watch")
def _(spark, sf):
    return _watch(spark, sf)


@query("pre_roll", f"""WITH {WATCH}, p AS (SELECT ev.session_id, frame_idx, row_number() OVER (PARTITION BY ev.session_id ORDER BY t DESC, frame_idx DESC) AS r
    FROM ev JOIN watch USING (session_id) WHERE t <= start AND t >= start - {US['preroll']}) SELECT session_id, frame_idx FROM p WHERE r <= 60""")
def _(spark, sf):
    return windows.pre_roll(ev_frames(spark, sf), _watch(spark, sf), CFG, LINE).select("session_id", "frame_idx")


@query("cap_session", f"""WITH {EV}, u AS (SELECT *, sum(level) {UPTO} - level AS used, row_number() {OVER} - 1 AS taken FROM ev)
  SELECT session_id, frame_idx FROM u WHERE used < 50 AND taken < 40""")
def _(spark, sf):
    return windows.cap_session(ev_frames(spark, sf), CFG, F.col("level"), 50, 40, LINE).select("session_id", "frame_idx")


@query("ordered_positions", f"WITH {EV} SELECT session_id, frame_idx, row_number() {OVER} - 1 AS idx FROM ev")
def _(spark, sf):
    return row_index(ev_frames(spark, sf), LINE).select("session_id", "frame_idx", "idx")


REPORT_SQL = f"""WITH {GATE} SELECT session_id, count(*) AS frames, sum(CASE WHEN d > {US['gap']} THEN 1 ELSE 0 END)::BIGINT AS gaps,
  {", ".join(f"coalesce(sum(CASE WHEN state = '{s}' AND d IS NOT NULL THEN greatest(d, {US['floor']}) END), 0)::BIGINT AS {s.lower()}" for s in STATES)},
  least(100.0::DOUBLE, (max(t) - min(t)) / {CFG.span(1800.0)}::DOUBLE * 100.0::DOUBLE) AS progress_pct FROM gate GROUP BY session_id"""


@query("speech_report", REPORT_SQL)
def flagship(spark, sf):
    """Gaps, gate, state totals and progress: the end-to-end report."""
    return speech_report(_gate_input(ev_frames(spark, sf)).drop("role", "level"), CFG, LINE)
