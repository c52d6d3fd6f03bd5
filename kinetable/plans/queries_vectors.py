"""Queries over vectors: statistics, medians, normalization, splits, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinetable.anatomy import channel_weights
from kinetable.operators import alignment, evaluation, features, vectors, windows
from kinetable.operators.filters import is_rest
from kinetable.operators.ordered import previous, row_index
from kinetable.plans.bindings import EV, EV_GLOBAL, VEC, VEC_GLOBAL, VEC_LINE, ev_frames, vectors as vec
from kinetable.plans.registry import query

LONG = f"{VEC}, lg AS (SELECT session_id, frame_idx, unnest(range(len(v))) AS pos, CAST(unnest(v) AS DOUBLE) AS x FROM vec)"


@query("vector_stats", f"""WITH {LONG} SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS min, max(x) AS max FROM lg GROUP BY pos""")
def _(spark, sf):
    out = vectors.vector_stats(vec(spark, sf), "v")
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query("wide_vector_stats", f"""WITH {LONG} SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS min, max(x) AS max FROM lg GROUP BY pos""")
def _(spark, sf):
    out = vectors.wide_vector_stats(vec(spark, sf), "v")
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query("top_components", f"""WITH {LONG}, a AS (SELECT CAST(pos AS INTEGER) AS pos, var_pop(x) AS variance, avg(x) AS mean, max(x) AS peak FROM lg GROUP BY pos)
  SELECT pos, round(variance, 9) AS variance, round(mean, 9) AS mean, peak FROM a ORDER BY a.variance DESC, pos DESC LIMIT 8""")
def _(spark, sf):
    out = vectors.top_components(vec(spark, sf), "v")
    return out.withColumns({"mean": F.round("mean", 9), "variance": F.round("variance", 9)})


MEDIAN = f"{LONG}, md AS (SELECT session_id, pos, quantile_cont(x, 0.5) AS m FROM lg GROUP BY ALL)"


@query("median_vector", f"WITH {MEDIAN} SELECT session_id, list(m ORDER BY pos) AS median FROM md GROUP BY session_id")
def _(spark, sf):
    return vectors.median_vector(vec(spark, sf), ["session_id"], "v")


@query("pose_delta", f"WITH {MEDIAN} SELECT lg.session_id, frame_idx, list(x - m ORDER BY pos) AS delta FROM lg JOIN md USING (session_id, pos) WHERE pos < 3 GROUP BY ALL")
def _(spark, sf):
    rows = vec(spark, sf).withColumn("pose", F.slice("v", 1, 3))
    return vectors.pose_delta(rows, ["session_id"]).select("session_id", "frame_idx", F.col("pose_delta").alias("delta"))


@query("mean_variance", f"""WITH {LONG}, a AS (SELECT session_id, pos, var_pop(x) AS v FROM lg WHERE pos BETWEEN 3 AND 8 GROUP BY ALL) SELECT session_id, round(avg(v), 9) AS variance FROM a GROUP BY session_id""")
def _(spark, sf):
    return vectors.mean_variance(vec(spark, sf), ["session_id"], "v", [1, 2]).withColumn("variance", F.round("variance", 9))


@query("exact_quantiles", f"""WITH {EV} SELECT event_type, round(quantile_cont(x, 0.05), 9) AS q0, round(quantile_cont(x, 0.5), 9) AS q1, round(quantile_cont(x, 0.95), 9) AS q2 FROM ev GROUP BY event_type""")
def _(spark, sf):
    from kinetable.operators.quantiles import exact_quantiles

    out = exact_quantiles(ev_frames(spark, sf), ["event_type"], "x", [0.05, 0.5, 0.95])
    return out.select("event_type", *[F.round(q, 9).alias(q) for q in ("q0", "q1", "q2")])


@query("speech_drive", f"""WITH {EV}, p AS (SELECT quantile_cont(level * 1.0::DOUBLE, 0.05) AS p5, quantile_cont(level * 1.0::DOUBLE, 0.95) AS p95, quantile_cont(x, 0.9) AS p90 FROM ev)
  SELECT frame_idx, least(1.0::DOUBLE, greatest(0.0::DOUBLE, x / (p90 + 1e-5::DOUBLE))) * 0.65::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (level - p5) / (p95 - p5 + 1e-5::DOUBLE))) * 0.35::DOUBLE AS drive FROM ev CROSS JOIN p""")
def _(spark, sf):
    rows = ev_frames(spark, sf).withColumn("jaw", F.col("level").cast("double"))
    return vectors.speech_drive(rows, "x", "jaw").select("frame_idx", "drive")


HASH = "CAST('0x' || substr(md5({key} || '|42'), 1, 15) AS BIGINT)"


@query("split_by_frame", f"""WITH {EV}, h AS (SELECT session_id, frame_idx, row_number() OVER (ORDER BY {HASH.format(key="session_id || '|' || frame_idx")}, session_id, frame_idx) AS r, count(*) OVER () AS n FROM ev)
  SELECT session_id, frame_idx, r > floor(n * 0.15::DOUBLE) AS is_train FROM h""")
def _(spark, sf):
    return evaluation.split(ev_frames(spark, sf), ["session_id", "frame_idx"]).select("session_id", "frame_idx", "is_train")


@query("split_by_session", f"""WITH {EV}, h AS (SELECT session_id, row_number() OVER (ORDER BY {HASH.format(key="session_id")}, session_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session_id FROM ev))
  SELECT session_id, frame_idx, r > floor(n * 0.15::DOUBLE) AS is_train FROM ev JOIN h USING (session_id)""")
def _(spark, sf):
    out = evaluation.split(ev_frames(spark, sf), ["session_id", "frame_idx"], by=["session_id"])
    return out.select("session_id", "frame_idx", "is_train")


@query("eval_segment", f"""WITH {EV}, i AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS i, event_type = 'view' AS val FROM ev),
  b AS (SELECT count(*) FILTER (WHERE val) AS n, min(i) FILTER (WHERE val) AS f FROM i) SELECT frame_idx FROM i CROSS JOIN b WHERE n >= 64 AND i >= f AND i < f + least(400, n - 64)""")
def _(spark, sf):
    return evaluation.eval_segment(ev_frames(spark, sf), EV_GLOBAL, F.col("event_type") == "view").select("frame_idx")


# Predictions: a vector predicts the one before it in its session.
PRED = """pr0 AS (SELECT label AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS p,
    lag(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) OVER (PARTITION BY label ORDER BY vec_id) AS g FROM embeddings),
  pr AS (SELECT s, t - 1 AS t, p, g FROM pr0 WHERE g IS NOT NULL)"""


def predictions(spark, sf):
    rows = vec(spark, sf).withColumn("p", F.transform("v", lambda x: F.abs(x.cast("double"))))
    rows = previous(row_index(rows, VEC_LINE, "t"), VEC_LINE, {"g": F.col("p")}).filter(F.col("g").isNotNull())
    parts = {"bs": (1, 52), "dental": (53, 4), "pose": (57, 3)}
    sliced = {f"{side}_{n}": F.slice(c, a, k) for side, c in (("pred", "p"), ("target", "g")) for n, (a, k) in parts.items()}
    return rows.select(F.col("session_id").alias("seq_id"), (F.col("t") - 1).alias("t"), *[c.alias(n) for n, c in sliced.items()])


@query("accuracy", f"""WITH {PRED}, c AS (SELECT unnest(p[:52]) AS p, unnest(g[:52]) AS g FROM pr) SELECT round((SELECT avg(abs(p - g)) FROM c), 9) AS mae, round(avg(abs(p[18] - g[18])), 9) AS mae_jaw, round(corr(p[18], g[18]), 9) AS corr_jaw,
  (SELECT min(p) FROM c) AS min, (SELECT max(p) FROM c) AS max FROM pr""")
def _(spark, sf):
    out = evaluation.accuracy(predictions(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("mae", "mae_jaw", "corr_jaw")})


def _l1(a, b, beta):
    return f"CASE WHEN abs({a} - {b}) < {beta} THEN abs({a} - {b}) * abs({a} - {b}) * 0.5::DOUBLE / {beta}::DOUBLE ELSE abs({a} - {b}) - {0.5 * beta}::DOUBLE END"


LOSS = f"""WITH {PRED}, c AS (SELECT s, t, unnest(range(52)) AS i, unnest(p[:52]) AS p, unnest(g[:52]) AS g FROM pr), w AS (SELECT unnest(range(52)) AS i, unnest({channel_weights()}) AS w),
  v AS (SELECT *, p - lag(p) OVER o AS vp, g - lag(g) OVER o AS vg FROM c WINDOW o AS (PARTITION BY s, i ORDER BY t)), a AS (SELECT *, vp - lag(vp) OVER o AS ap, vg - lag(vg) OVER o AS ag FROM v WINDOW o AS (PARTITION BY s, i ORDER BY t)),
  d AS (SELECT unnest(p[53:56]) AS p, unnest(g[53:56]) AS g FROM pr), q AS (SELECT s, t, unnest(range(3)) AS i, unnest(p[57:59]) AS p, unnest(g[57:59]) AS g FROM pr),
  qv AS (SELECT *, p - lag(p) OVER o AS vp, g - lag(g) OVER o AS vg FROM q WINDOW o AS (PARTITION BY s, i ORDER BY t)),
  m AS (SELECT s, t, sum((p + 1e-6) * (g + 1e-6)) / (sqrt(sum((p + 1e-6) * (p + 1e-6))) * sqrt(sum((g + 1e-6) * (g + 1e-6)))) AS k FROM c WHERE i BETWEEN 14 AND 40 GROUP BY s, t),
  terms AS (SELECT (SELECT avg(({_l1('p', 'g', 0.02)}) * w * (1 + 3 * g)) FROM c JOIN w USING (i)) AS recon_loss, (SELECT avg(1 - k) FROM m) AS cos_loss, (SELECT avg(abs(vp - vg)) FROM v) AS vel_loss, (SELECT avg(abs(ap - ag)) FROM a) AS acc_loss,
    (SELECT avg({_l1('p', 'g', 0.02)}) FROM d) AS dental_loss, (SELECT avg(CASE WHEN g[52] < 0.05 THEN greatest(p[52] - 0.05::DOUBLE, 0) * 2.5::DOUBLE ELSE abs(p[52] - g[52]) * 1.5::DOUBLE END) FROM pr) AS tongue_loss,
    (SELECT avg({_l1('p', 'g', 0.1)}) FROM q) AS pose_loss, (SELECT avg(abs(vp - vg)) FROM qv) AS pose_vel_loss)"""
TERMS = [f"{n}_loss" for n in evaluation.LOSS_WEIGHTS]


@query("animation_loss", LOSS + f" SELECT {', '.join(f'round({n}, 9) AS {n}' for n in TERMS)}, round({' + '.join(f'{n}_loss * {w}' for n, w in evaluation.LOSS_WEIGHTS.items())}, 9) AS total_loss FROM terms")
def _(spark, sf):
    out = evaluation.animation_loss(predictions(spark, sf), width=20)
    return out.select(*[F.round(c, 9).alias(c) for c in [*TERMS, "total_loss"]])


@query("channel_weights", f"WITH w AS (SELECT unnest(range(52)) AS pos, unnest({channel_weights()}) AS w), {LONG} SELECT pos, round(avg(abs(x)) * any_value(w), 9) AS weighted FROM lg JOIN w USING (pos) GROUP BY pos")
def _(spark, sf):
    weights = F.array(*[F.lit(w) for w in channel_weights()])
    rows = vectors.components(vec(spark, sf), "v").filter(F.col("pos") < 52).groupBy("pos").agg(F.avg(F.abs("x")).alias("m"))
    return rows.select(F.col("pos").cast("long").alias("pos"), F.round(F.col("m") * F.get(weights, F.col("pos")), 9).alias("weighted"))


# Normalization on 21 landmarks: the first 63 values of a vector.
POINTS = 21
MODEL = alignment.FaceModel(
    template=alignment.canonical_template()[[168, 6, 197, 133, 362, 33, 263, 10, 151, 9, 234, 454, 61, 291, 0, 17, 13, 14, 1, 2, 152]],
    anchors=tuple(range(12)), lips=tuple(range(12, 18)), eyes=(3, 4, 5, 6), nose=(0, 1, 2, 18, 19),
    mouth_span=(12, 13), pupil_span=(3, 4), nose_span=(0, 19),
)


def landmarks(spark, sf):
    return vec(spark, sf).withColumn("lm", F.slice("v", 1, 63))


@query("fit_alignment")
def _(spark, sf):
    return alignment.fit_alignment(landmarks(spark, sf), "lm", MODEL).select("frame_idx", "fit.*")


@query("neutral_faces")
def _(spark, sf):
    rest = is_rest(None, F.col("v")[17], None, None)
    return alignment.neutral_faces(landmarks(spark, sf), ["session_id"], "lm", rest, MODEL)


@query("normalize_frames")
def _(spark, sf):
    rows = landmarks(spark, sf)
    neutral = alignment.neutral_faces(rows, ["session_id"], "lm", is_rest(None, F.col("v")[17], None, None), MODEL)
    return alignment.normalize_frames(rows.select("session_id", "frame_idx", "lm"), neutral, ["session_id"], "lm", MODEL)


@query("variance_report")
def _(spark, sf):
    rows = landmarks(spark, sf)
    neutral = alignment.neutral_faces(rows, ["session_id"], "lm", is_rest(None, F.col("v")[17], None, None), MODEL)
    normal = alignment.normalize_frames(rows.select("session_id", "frame_idx", "lm"), neutral, ["session_id"], "lm", MODEL)
    return vectors.variance_report(normal, ["session_id"], "lm", "canonical", MODEL.anchors, MODEL.lips, "residual")


@query("log_mel")
def _(spark, sf):
    return features.log_mel(vec(spark, sf), "v").select("frame_idx", "spectral")


CLIP = f"""{VEC}, ci AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) - 1) AS i, frame_idx, v FROM vec), whole AS (SELECT session_id, flatten(list(v ORDER BY i)) AS s FROM ci GROUP BY session_id)"""


def _clips(spark, sf):
    rows = row_index(vec(spark, sf), VEC_LINE, "i")
    frames = rows.select("session_id", "frame_idx", (F.col("i") * 4.25).alias("t"))
    return frames, rows.select("session_id", (F.col("i") * 64).alias("offset"), F.col("v").cast("array<double>").alias("samples"))


@query("slice_audio", f"""WITH {CLIP} SELECT session_id, frame_idx, list_transform(range(8), lambda k: coalesce(CAST(s[CAST(i * 68 AS BIGINT) + k + 1] AS DOUBLE), 0.0::DOUBLE)) AS samples FROM ci JOIN whole USING (session_id)""")
def _(spark, sf):
    frames, clips = _clips(spark, sf)
    return features.slice_audio(frames, clips, rate=16, fps=2.0, block=100).select("session_id", "frame_idx", "samples")


@query("log_mel_sequence")
def _(spark, sf):
    frames, clips = _clips(spark, sf)
    # The same samples as a recording at 16 kHz: at 16 Hz no band lies below half the rate.
    return features.log_mel_sequence(frames.withColumn("t", F.col("t") / 1000), clips, rate=16_000).select("session_id", "frame_idx", "spectral")


def _sequences(spark, sf):
    return windows.sequence_windows(vec(spark, sf), VEC_GLOBAL, F.col("v").cast("array<double>"))


@query("augment")
def _(spark, sf):
    return evaluation.augment(_sequences(spark, sf), seed=42, epoch=1).select("seq", "rows")


@query("score", f"""WITH {VEC}, n AS (SELECT greatest(1, (count(*) - 64) // 16) AS n FROM vec), i AS (SELECT row_number() OVER (ORDER BY frame_idx) - 1 AS i, v FROM vec), s AS (SELECT unnest(range(n)) AS seq FROM n)
  SELECT seq, round(avg(list_avg(v::DOUBLE[])), 9) AS level FROM s JOIN i ON i.i BETWEEN seq * 16 AND seq * 16 + 63 GROUP BY seq""")
def _(spark, sf):
    def predict(batch):
        return batch[["seq"]].assign(level=[float(np.mean(np.stack(r))) for r in batch["rows"]])

    out = evaluation.score(_sequences(spark, sf).select("seq", "rows"), predict, "seq long, level double")
    return out.withColumn("level", F.round("level", 9))


def _pixel(dx: int, dy: int) -> str:
    """A neighbour's value in the 16 x 16 image, mirrored at its edges."""
    x, y = (f"(CASE WHEN {p} + {d} < 0 THEN 1 WHEN {p} + {d} > 15 THEN 14 ELSE {p} + {d} END)" for p, d in (("px", dx), ("py", dy)))
    return f"v[{y} // 2 * 8 + {x} // 2 + 1]::DOUBLE * 255"


@query("blur_score", f"""WITH {VEC}, p AS (SELECT frame_idx, v, k % 16 AS px, k // 16 AS py FROM (SELECT *, unnest(range(256)) AS k FROM vec)),
  e AS (SELECT frame_idx, {_pixel(-1, 0)} + {_pixel(1, 0)} + {_pixel(0, -1)} + {_pixel(0, 1)} - 4 * ({_pixel(0, 0)}) AS e FROM p)
  SELECT frame_idx, round(var_pop(e), 4) AS blur FROM e GROUP BY frame_idx""")
def _(spark, sf):
    # Sixty-four values as an 8 x 8 image, each pixel doubled: 16 x 16.
    def row(r):
        pixels = F.transform(F.slice("v", r * 8 + 1, F.lit(8)), lambda x: F.array(x * 255, x * 255))
        return F.flatten(pixels)

    image = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array(row(r), row(r))))
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(16).alias("w"), F.lit(16).alias("h"))
    rows = vec(spark, sf).select("frame_idx", image.alias("gray"), box.alias("bbox"))
    return evaluation.blur_score(rows).select("frame_idx", F.round("blur", 4).alias("blur"))
