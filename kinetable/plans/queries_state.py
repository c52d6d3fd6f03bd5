"""Queries for keyed recursions; the SQL side walks each session row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import folds
from kinetable.plans.bindings import CFG, DAY_US, EV, FACE_FOLD_LINE, FOLD_LINE, ev_faces, ev_frames
from kinetable.plans.registry import query

ROWS = f"{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_idx) AS rn FROM ev)"
STEP = "FROM r JOIN o ON o.session_id = r.session_id AND o.rn = r.rn + 1"
PI2 = repr(2.0 * 3.141592653589793)


def _frames(spark, sf, *columns):
    return ev_frames(spark, sf).select("session_id", "frame_idx", "t", *columns)


@query("quality_state", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, x / 60.0::DOUBLE >= 0.65 AND event_type <> 'error' AS good, t AS changed FROM o WHERE rn = 1
  UNION ALL SELECT o.session_id, o.frame_idx, o.rn, CASE WHEN r.good THEN NOT ((o.x / 60.0::DOUBLE < 0.5 OR o.event_type = 'error') AND o.t - r.changed >= {CFG.span(0.15)})
    ELSE o.x / 60.0::DOUBLE >= 0.65 AND o.event_type <> 'error' END,
    CASE WHEN r.good THEN CASE WHEN (o.x / 60.0::DOUBLE < 0.5 OR o.event_type = 'error') AND o.t - r.changed >= {CFG.span(0.15)} THEN o.t ELSE r.changed END
    ELSE CASE WHEN o.x / 60.0::DOUBLE >= 0.65 AND o.event_type <> 'error' THEN o.t ELSE r.changed END END {STEP})
  SELECT session_id, frame_idx, good AS is_valid FROM r""")
def _(spark, sf):
    rows = _frames(spark, sf, (F.col("x") / 60.0).alias("score"), (F.col("event_type") == "error").alias("rejected"))
    return folds.quality_state(rows, CFG, FOLD_LINE).select("session_id", "frame_idx", "is_valid")


@query("one_euro", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, t, x AS v, NULL::DOUBLE AS s FROM o WHERE rn = 1
  UNION ALL SELECT session_id, frame_idx, rn, t, b * x + (1.0::DOUBLE - b) * v, s FROM (
    SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / ({PI2}::DOUBLE * (1.0::DOUBLE + 0.007::DOUBLE * abs(s))) / te) AS b FROM (
    SELECT *, CASE WHEN s0 IS NULL THEN raw ELSE a * raw + (1.0::DOUBLE - a) * s0 END AS s FROM (
    SELECT *, (x - v) * rate AS raw, 1.0::DOUBLE / rate AS te, 1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / ({PI2}::DOUBLE * 1.0::DOUBLE) / (1.0::DOUBLE / rate)) AS a FROM (
    SELECT o.session_id, o.frame_idx, o.rn, o.t, o.x, r.v, r.s AS s0, 1.0::DOUBLE / greatest(1e-4::DOUBLE, (o.t - r.t) / {DAY_US}.0::DOUBLE) AS rate {STEP})))))
  SELECT session_id, frame_idx, v AS smooth_x FROM r""")
def _(spark, sf):
    return folds.one_euro(_frames(spark, sf, "x"), CFG, ["x"], FOLD_LINE).select("session_id", "frame_idx", "smooth_x")


# Seven components a row: three landmarks, two channels, an angle and a shift.
@query("clean_layer", f"""WITH RECURSIVE {ROWS}, c AS (SELECT session_id, frame_idx, t, rn, unnest([1, 2, 3, 4, 5, 6, 7]) AS k, unnest([x, x / 2, x / 3, x / 100, x / 500, x, x / 10]) AS x FROM o),
  r AS (SELECT session_id, frame_idx, rn, t, k, x AS v, NULL::DOUBLE AS s FROM c WHERE rn = 1
  UNION ALL SELECT session_id, frame_idx, rn, t, k, b * x + (1.0::DOUBLE - b) * v, s FROM (
    SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / ({PI2}::DOUBLE * (1.0::DOUBLE + 0.007::DOUBLE * abs(s))) / te) AS b FROM (
    SELECT *, CASE WHEN s0 IS NULL THEN raw ELSE a * raw + (1.0::DOUBLE - a) * s0 END AS s FROM (
    SELECT *, (x - v) * rate AS raw, 1.0::DOUBLE / rate AS te, 1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / ({PI2}::DOUBLE * 1.0::DOUBLE) / (1.0::DOUBLE / rate)) AS a FROM (
    SELECT o.session_id, o.frame_idx, o.rn, o.t, o.k, o.x, r.v, r.s AS s0, 1.0::DOUBLE / greatest(1e-4::DOUBLE, (o.t - r.t) / {DAY_US}.0::DOUBLE) AS rate {STEP.replace('JOIN o', 'JOIN c AS o')} AND o.k = r.k))))),
  l AS (SELECT session_id, frame_idx, any_value(t) AS t, list(v ORDER BY k) AS v FROM r GROUP BY session_id, frame_idx)
  SELECT l.session_id, l.frame_idx, l.t, [x, x / 2, x / 3] AS landmarks, [x / 100, x / 500] AS channels, [x, x, x, x / 10, x / 10, x / 10] AS pose, v[1:3] AS clean_landmarks,
    list_transform(v[4:5], lambda y: round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, y)), 5)) AS clean_channels,
    [round_even(v[6], 2), round_even(v[6], 2), round_even(v[6], 2), round_even(v[7], 3), round_even(v[7], 3), round_even(v[7], 3)] AS clean_pose, true AS is_observed, false AS is_reconstructed
  FROM l JOIN o USING (session_id, frame_idx)""")
def _(spark, sf):
    x = F.col("x")
    rows = _frames(
        spark, sf, F.array(x, x / 2, x / 3).alias("landmarks"), F.array(x / 100, x / 500).alias("channels"),
        F.array(x, x, x, x / 10, x / 10, x / 10).alias("pose"),
    )
    return folds.clean_layer(rows, CFG, FOLD_LINE)


@query("vad", f"""WITH RECURSIVE {EV}, a0 AS (SELECT session_id, frame_idx, t, x / 10000.0::DOUBLE AS rms, (level + 1) / 10.0::DOUBLE AS zcr FROM ev),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_idx) AS rn FROM a0),
  r AS (SELECT session_id, 0::BIGINT AS frame_idx, 0::BIGINT AS rn, 0.004::DOUBLE AS fl, -1::BIGINT AS sp, false AS speech, 0.0::DOUBLE AS conf FROM o WHERE rn = 1
  UNION ALL SELECT session_id, frame_idx, rn, f1, s1, s1 > 0 AND t - s1 <= {CFG.span(0.38)}, CASE WHEN s1 > 0 AND t - s1 <= {CFG.span(0.38)} THEN least(1.0::DOUBLE, rms / greatest(1e-4::DOUBLE, thr * 2.5::DOUBLE)) ELSE 0.0 END FROM (
    SELECT *, CASE WHEN rms >= thr AND zcr BETWEEN 0.01 AND 0.45 THEN t ELSE sp END AS s1 FROM (
    SELECT *, greatest(0.008::DOUBLE, f1 * 2.2::DOUBLE) AS thr FROM (
    SELECT o.session_id, o.frame_idx, o.rn, o.t, o.rms, o.zcr, r.sp, CASE WHEN o.rms < r.fl * 1.5::DOUBLE OR r.fl = 0.004::DOUBLE THEN 0.96::DOUBLE * r.fl + 0.04::DOUBLE * o.rms ELSE r.fl END AS f1 {STEP}))))
  SELECT session_id, frame_idx, speech AS is_speech, conf AS vad_confidence FROM r WHERE rn > 0""")
def _(spark, sf):
    rows = _frames(spark, sf, (F.col("x") / 10000.0).alias("rms"), ((F.col("level") + 1) / 10.0).alias("zcr"))
    return folds.vad(rows, CFG, FOLD_LINE).select("session_id", "frame_idx", "is_speech", "vad_confidence")


@query("attack_release", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, x AS e FROM o WHERE rn = 1
  UNION ALL SELECT o.session_id, o.frame_idx, o.rn, CASE WHEN o.x > r.e THEN 0.65::DOUBLE * o.x + (1 - 0.65::DOUBLE) * r.e ELSE 0.25::DOUBLE * o.x + (1 - 0.25::DOUBLE) * r.e END {STEP})
  SELECT session_id, frame_idx, e AS envelope FROM r""")
def _(spark, sf):
    return folds.attack_release(_frames(spark, sf, "x"), FOLD_LINE, "x").select("session_id", "frame_idx", "envelope")


@query("attack_release_live", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, CASE WHEN x > 0 THEN 0.7::DOUBLE * x + (1 - 0.7::DOUBLE) * 0.0::DOUBLE ELSE 0.0 END AS e FROM o WHERE rn = 1
  UNION ALL SELECT o.session_id, o.frame_idx, o.rn, CASE WHEN o.x > r.e THEN 0.7::DOUBLE * o.x + (1 - 0.7::DOUBLE) * r.e ELSE 0.25::DOUBLE * o.x + (1 - 0.25::DOUBLE) * r.e END {STEP})
  SELECT session_id, frame_idx, e AS envelope FROM r""")
def _(spark, sf):
    out = folds.attack_release(_frames(spark, sf, "x"), FOLD_LINE, "x", rise=0.70, start=0.0)
    return out.select("session_id", "frame_idx", "envelope")


PEAK = "CASE WHEN {v} > {p} THEN 0.92::DOUBLE * {p} + 0.08::DOUBLE * {v} ELSE greatest(0.02::DOUBLE, 0.998::DOUBLE * {p}) END"


@query("adaptive_peak", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, {PEAK.format(v='x', p='0.04::DOUBLE')} AS p FROM o WHERE rn = 1
  UNION ALL SELECT o.session_id, o.frame_idx, o.rn, {PEAK.format(v='o.x', p='r.p')} {STEP})
  SELECT session_id, frame_idx, p AS peak FROM r""")
def _(spark, sf):
    return folds.adaptive_peak(_frames(spark, sf, "x"), FOLD_LINE, "x").select("session_id", "frame_idx", "peak")


@query("ema", f"""WITH RECURSIVE {ROWS}, r AS (SELECT session_id, frame_idx, rn, (1.0::DOUBLE - 0.1::DOUBLE) * 30.0::DOUBLE + 0.1::DOUBLE * x AS e FROM o WHERE rn = 1
  UNION ALL SELECT o.session_id, o.frame_idx, o.rn, (1.0::DOUBLE - 0.1::DOUBLE) * r.e + 0.1::DOUBLE * o.x {STEP})
  SELECT session_id, frame_idx, e AS ema FROM r""")
def _(spark, sf):
    return folds.ema(_frames(spark, sf, "x"), FOLD_LINE, "x").select("session_id", "frame_idx", "ema")


@query("track")
def _(spark, sf):
    faces = ev_faces(spark, sf).select(
        "session_id", "frame_idx", "t", "det_idx", (F.col("x") / 500.0).alias("cx"), (F.col("level") / 5.0).alias("cy")
    )
    return folds.track(faces, CFG, FACE_FOLD_LINE)
