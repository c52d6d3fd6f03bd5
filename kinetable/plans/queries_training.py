"""Queries for list parsing, export projections and the training build."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS
from kinetable.operators import evaluation
from kinetable.operators.filters import filter_frames
from kinetable.operators.ordered import Timeline
from kinetable.plans import training
from kinetable.plans.bindings import EV, VEC, ev_frames, table, vectors as vec
from kinetable.plans.queries_features import CH, DENTAL, EMOTION
from kinetable.plans.queries_vectors import MODEL, PRED, predictions
from kinetable.plans.registry import query
from kinetable.sources import exports, feeds


@query("url_lines", r"""WITH l AS (SELECT conv_id, turn, trim(CASE role WHEN 'system' THEN '# Title: ' || turn || ' of ' || conv_id WHEN 'user' THEN ' https://host.example/' || md5(text) ELSE '// ' || turn END) AS line FROM conversations),
  u AS (SELECT *, line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//') AS is_url, starts_with(line, '# Title:') AS is_title FROM l),
  p AS (SELECT *, max(CASE WHEN is_title THEN turn END) OVER w AS tt, max(CASE WHEN is_url THEN turn END) OVER w AS tu FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT conv_id, turn, line AS url, CASE WHEN tt IS NOT NULL AND (tu IS NULL OR tt > tu) THEN tt || ' of ' || conv_id END AS title FROM p WHERE is_url""")
def _(spark, sf):
    number, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    line = (
        F.when(F.col("role") == "system", F.concat(F.lit("# Title: "), turn, F.lit(" of "), number))
        .when(F.col("role") == "user", F.concat(F.lit(" https://host.example/"), F.md5("text")))
        .otherwise(F.concat(F.lit("// "), turn))
    )
    lines = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("value"))
    return feeds.url_lines(lines, Timeline(("conv_id",), ("turn",), 3))


@query("export_jsonl_rows", f"""WITH {EV} SELECT frame_idx, '{{"session_id":' || session_id || ',"level":' || level || '}}' AS line FROM ev WHERE level >= 3""")
def _(spark, sf):
    rows = filter_frames(ev_frames(spark, sf), min_level=3)
    return rows.select("frame_idx", F.to_json(F.struct("session_id", "level")).alias("line"))


@query("animation_table", f"""WITH {VEC} SELECT CAST(floor(frame_idx / 30.0::DOUBLE * 1000 + 0.5) AS BIGINT) AS millis, {", ".join(f"round_even(CAST(v[{i + 1}] AS DOUBLE), 5) AS {n}" for i, n in enumerate(CHANNELS))} FROM vec""")
def _(spark, sf):
    rows = exports.animation_rows(vec(spark, sf), values="v", index="frame_idx")
    return rows.select(F.floor(F.col("time_sec") * 1000 + 0.5).alias("millis"), *CHANNELS)


@query("animation_documents", f"""WITH {VEC} SELECT frame_idx AS frame, CAST(v[18] AS DOUBLE) AS jaw, CAST(v[52] AS DOUBLE) AS tongue, 52 AS channels FROM vec""")
def _(spark, sf):
    rows = exports.animation_documents(vec(spark, sf), values="v", index="frame_idx")
    shapes = F.col("blendshapes")
    return rows.select("frame", shapes["jawOpen"].alias("jaw"), shapes["tongueOut"].alias("tongue"), F.size(shapes).alias("channels"))


@query("animation_metadata", f"""WITH {PRED}, c AS (SELECT unnest(p[:52]) AS p, unnest(g[:52]) AS g FROM pr) SELECT 30 AS fps, (SELECT count(*) FROM pr) AS total_frames, (SELECT count(*) FROM pr) / 30.0::DOUBLE AS duration_sec, 52 AS blendshape_count,
  round((SELECT avg(abs(p - g)) FROM c), 9) AS mae, round(corr(p[18], g[18]), 9) AS jaw_correlation FROM pr""")
def _(spark, sf):
    rows = predictions(spark, sf)
    out = exports.animation_metadata(rows, evaluation.accuracy(rows))
    return out.withColumns({c: F.round(c, 9) for c in ("mae", "jaw_correlation")})


@query("split_reader", f"""WITH {EV} SELECT session_id, frame_idx FROM ev WHERE NOT is_primary""")
def _(spark, sf):
    rows = ev_frames(spark, sf).withColumn("is_train", F.col("is_primary"))
    return rows.filter(exports.split_filter("validation")).select("session_id", "frame_idx")


def _training_input(spark, sf):
    """Vectors as frames: channels, pose and landmarks are parts of the vector."""
    x = F.transform("v", lambda a: F.abs(a.cast("double")) * 3.0)
    return vec(spark, sf).select(
        "session_id", "frame_idx", (F.col("frame_idx") / 30.0).alias("t"),
        F.when(F.col("v")[63] > 0, "SPEAKER").when(F.col("v")[62] > 0, "SPEAKER_PAUSE").otherwise("LISTENER").alias("role"),
        F.slice(x, 1, 52).alias("channels"), F.slice("v", 53, 3).alias("pose"), F.slice("v", 1, 63).alias("landmarks"),
    )


KEPT = f"""{CH}, {DENTAL.split('),', 1)[1].lstrip()}, {EMOTION.split('),', 1)[1].lstrip()},
  acc AS (SELECT label AS session_id, vec_id AS frame_idx, embedding AS v, CASE WHEN embedding[64] > 0 THEN 'SPEAKER' ELSE 'SPEAKER_PAUSE' END AS role FROM embeddings WHERE embedding[64] > 0 OR embedding[63] > 0),
  ok AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS k, row_number() OVER (ORDER BY CAST('0x' || substr(md5(session_id || '|' || frame_idx || '|42'), 1, 15) AS BIGINT)) AS r, count(*) OVER () AS n FROM acc),
  md AS (SELECT session_id, [quantile_cont(CAST(v[53] AS DOUBLE), 0.5), quantile_cont(CAST(v[54] AS DOUBLE), 0.5), quantile_cont(CAST(v[55] AS DOUBLE), 0.5)] AS m FROM acc GROUP BY session_id)"""


@query("build_training_lean", f"""WITH {KEPT} SELECT session_id, frame_idx, role, [CAST(v[53] AS DOUBLE) - m[1], CAST(v[54] AS DOUBLE) - m[2], CAST(v[55] AS DOUBLE) - m[3]] AS pose_delta, dental, emotion_id,
  r > floor(n * 0.15::DOUBLE) AS is_train FROM ok JOIN md USING (session_id) JOIN dental ON dental.vec_id = frame_idx JOIN emotion ON emotion.vec_id = frame_idx WHERE k >= 10""")
def _(spark, sf):
    out = training.build_training(_training_input(spark, sf))
    return out.select("session_id", "frame_idx", "role", "pose_delta", "dental", "emotion_id", "is_train")


@query("build_training_full")
def _(spark, sf):
    return training.build_training(_training_input(spark, sf), lean=False, model=MODEL)


@query("feature_stats")
def _(spark, sf):
    return training.feature_stats(training.build_training(_training_input(spark, sf), lean=False, model=MODEL))


@query("training_totals", f"""WITH {KEPT} SELECT count(*) AS total_frames, count(*) - CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS train_frames, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS val_frames,
  {", ".join(f"count(*) FILTER (WHERE emotion_id = {e}) AS emotion_{e}" for e in range(5))} FROM ok JOIN emotion ON emotion.vec_id = frame_idx WHERE k >= 10""")
def _(spark, sf):
    return training.training_totals(training.build_training(_training_input(spark, sf)))
