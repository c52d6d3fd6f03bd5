"""Queries for the column functions: urls, faces, channels, audio, labels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS, EXCLUDED_WORDS, mirror_index
from kinetable.functions import audio, text, vision
from kinetable.operators import features
from kinetable.plans.bindings import CFG, DAY_US, EV, LINE, VEC, ev_frames, table, vectors
from kinetable.plans.registry import query

# Channels: absolute embedding values, three-fold, as the 52 named expression channels.
CH = "ch AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 3.0::DOUBLE) AS c FROM embeddings)"


def _channels(spark, sf):
    values = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 3.0)
    return table(spark, sf, "embeddings").select("vec_id", values.alias("c"))


def _c(name: str) -> str:
    return f"c[{CHANNELS.index(name) + 1}]"


def _pair(stem: str) -> str:
    return f"(({_c(stem + 'Left')} + {_c(stem + 'Right')}) * 0.5::DOUBLE)"


# Signal: embedding values as double samples.
SIG = "sig AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)"


def _signal(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))


def _sum(expr: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {expr}), lambda p, q: p + q)"


# Urls: every page is written in one of five spellings around an id made from its URL hash.
SPELL = """u AS (SELECT page_id, url, substr(md5(url), 1, 11) AS id FROM pages),
  urls AS (SELECT page_id, url, id, unnest(['https://www.youtube.com/watch?v=' || id || '&t=42s', 'https://youtu.be/' || id || '?si=x', id,
    'https://www.youtube.com/shorts/' || id, '  https://www.youtube.com/embed/' || id || '?a=1  ', url]) AS spelling FROM u)"""


def spellings(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.substring(F.md5("url"), 1, 11).alias("id"))
    forms = F.array(
        F.concat(F.lit("https://www.youtube.com/watch?v="), "id", F.lit("&t=42s")),
        F.concat(F.lit("https://youtu.be/"), "id", F.lit("?si=x")),
        F.col("id"),
        F.concat(F.lit("https://www.youtube.com/shorts/"), "id"),
        F.concat(F.lit("  https://www.youtube.com/embed/"), "id", F.lit("?a=1  ")),
        F.col("url"),
    )
    return pages.withColumn("spelling", F.explode(forms))


ID_SQL = f"""CASE WHEN regexp_full_match(trim(spelling), '[0-9A-Za-z_-]{{11}}') THEN trim(spelling)
  ELSE nullif(regexp_extract(trim(spelling), '{text.ID_PATTERN}', 1), '') END"""


@query("extract_video_id", f"WITH {SPELL} SELECT page_id, spelling, {ID_SQL} AS video_id FROM urls")
def _(spark, sf):
    return spellings(spark, sf).select("page_id", "spelling", text.extract_video_id(F.col("spelling")).alias("video_id"))


@query("normalize_url", f"""WITH {SPELL}, i AS (SELECT *, {ID_SQL} AS vid FROM urls)
  SELECT page_id, spelling, CASE WHEN vid IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || vid ELSE trim(spelling) END AS canonical,
  coalesce(vid, trim(spelling)) AS key FROM i""")
def _(spark, sf):
    s = F.col("spelling")
    return spellings(spark, sf).select("page_id", "spelling", text.canonical_url(s).alias("canonical"), text.url_key(s).alias("key"))


# The first twelve values of a vector as the upper rows of a 4x4 matrix.
@query("matrix_to_euler", f"""WITH {SIG}, m AS (SELECT vec_id, s, sqrt(s[1] * s[1] + s[5] * s[5]) AS sy FROM sig)
  SELECT vec_id, round_even(degrees(CASE WHEN sy < 1e-6 THEN atan2(-s[7], s[6]) ELSE atan2(s[10], s[11]) END), 2) AS pitch,
  round_even(degrees(atan2(-s[9], sy)), 2) AS yaw, round_even(degrees(CASE WHEN sy < 1e-6 THEN 0.0 ELSE atan2(s[5], s[1]) END), 2) AS roll,
  round_even(s[4], 3) AS tx, round_even(s[8], 3) AS ty, round_even(s[12], 3) AS tz FROM m""")
def _(spark, sf):
    return _signal(spark, sf).select("vec_id", vision.matrix_to_euler(F.col("s")).alias("e")).select("vec_id", "e.*")


@query("euler_to_matrix", f"""WITH {SIG}, a AS (SELECT vec_id, radians(s[1] * 90) AS p, radians(s[2] * 90) AS y, radians(s[3] * 90) AS r FROM sig),
  m AS (SELECT vec_id, [cos(r) * cos(y), cos(r) * sin(y) * sin(p) - sin(r) * cos(p), cos(r) * sin(y) * cos(p) + sin(r) * sin(p),
    sin(r) * cos(y), sin(r) * sin(y) * sin(p) + cos(r) * cos(p), sin(r) * sin(y) * cos(p) - cos(r) * sin(p), -sin(y), cos(y) * sin(p), cos(y) * cos(p)] AS m FROM a)
  SELECT vec_id, list_transform(m, lambda x: CAST(round(x * 1e9) AS BIGINT)) AS nano FROM m""")
def _(spark, sf):
    s = F.col("s")
    m = vision.euler_to_matrix(s[0] * 90, s[1] * 90, s[2] * 90)
    return _signal(spark, sf).select("vec_id", F.transform(m, lambda x: F.round(x * 1e9).cast("long")).alias("nano"))


POINTS = "pt AS (SELECT vec_id, list_transform(embedding[:63], lambda x: CAST(x AS DOUBLE) + 0.5::DOUBLE) AS p FROM embeddings)"


def _points(spark, sf):
    p = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") + 0.5)
    return table(spark, sf, "embeddings").select("vec_id", p.alias("p"))


@query("bbox", f"""WITH {POINTS}, xy AS (SELECT vec_id, list_transform(range(21), lambda i: p[i * 3 + 1] * 640) AS xs,
    list_transform(range(21), lambda i: p[i * 3 + 2] * 480) AS ys FROM pt),
  b AS (SELECT vec_id, greatest(0, CAST(trunc(list_min(xs)) AS INTEGER)) AS x, greatest(0, CAST(trunc(list_min(ys)) AS INTEGER)) AS y,
    least(640, CAST(trunc(list_max(xs)) AS INTEGER)) AS x1, least(480, CAST(trunc(list_max(ys)) AS INTEGER)) AS y1 FROM xy),
  w AS (SELECT vec_id, x, y, greatest(1, x1 - x) AS w, greatest(1, y1 - y) AS h FROM b)
  SELECT *, (x + w / 2.0::DOUBLE) / 640 AS cx, (y + h / 2.0::DOUBLE) / 480 AS cy, w * h / 307200::DOUBLE AS area FROM w""")
def _(spark, sf):
    return _points(spark, sf).select("vec_id", vision.bbox(F.col("p"), F.lit(640), F.lit(480)).alias("b")).select("vec_id", "b.*")


# Quality numbers from event columns.
QUAL = f"""{EV}, q0 AS (SELECT session_id, frame_idx, x * 0.6::DOUBLE - 40 AS yaw, x * 0.3::DOUBLE - 20 AS pitch, level * 5.0::DOUBLE AS roll,
    x / 707.0::DOUBLE AS area, x / 0.59::DOUBLE AS blur, level * 0.4::DOUBLE AS jit, (face_id + 1) / 4.0::DOUBLE AS conf, CAST(trunc(x) AS INTEGER) + 20 AS w, CAST(trunc(x) AS INTEGER) + 30 AS h FROM ev),
  q AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(yaw) / 50.0::DOUBLE) * 0.5::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(pitch) / 40.0::DOUBLE) * 0.3::DOUBLE
    + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(roll) / 35.0::DOUBLE) * 0.2::DOUBLE AS pose FROM q0)"""


def _quality(spark, sf):
    x = F.col("x")
    rows = ev_frames(spark, sf).select(
        "session_id", "frame_idx", (x * 0.6 - 40).alias("yaw"), (x * 0.3 - 20).alias("pitch"), (F.col("level") * 5.0).alias("roll"),
        (x / 707.0).alias("area"), (x / 0.59).alias("blur"), (F.col("level") * 0.4).alias("jit"), ((F.col("face_id") + 1) / 4.0).alias("conf"),
        (x.cast("int") + 20).alias("w"), (x.cast("int") + 30).alias("h"),
    )
    return rows.withColumn("pose", vision.pose_quality(F.col("pitch"), F.col("yaw"), F.col("roll"), CFG))


@query("pose_quality", f"WITH {QUAL} SELECT session_id, frame_idx, pose FROM q")
def _(spark, sf):
    return _quality(spark, sf).select("session_id", "frame_idx", "pose")


@query("composite_score", f"""WITH {QUAL} SELECT session_id, frame_idx, conf * 0.25::DOUBLE + least(1.0::DOUBLE, area / 0.15::DOUBLE) * 0.20::DOUBLE
  + least(1.0::DOUBLE, blur / 150.0::DOUBLE) * 0.20::DOUBLE + pose * 0.20::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - least(1.0::DOUBLE, jit / 1.5::DOUBLE)) * 0.15::DOUBLE AS score FROM q""")
def _(spark, sf):
    c = F.col
    score = vision.composite_score(c("conf"), c("area"), c("blur"), c("pose"), c("jit"))
    return _quality(spark, sf).select("session_id", "frame_idx", score.alias("score"))


@query("rejection_reason", f"""WITH {QUAL} SELECT session_id, frame_idx, CASE WHEN w < 70 OR h < 70 OR area < 0.025 THEN format('face_too_small ({{}}x{{}}px, area {{:.3f}})', w, h, area)
  WHEN blur < 35.0 THEN format('motion_blur (laplacian {{:.1f}} < 35.0)', blur) WHEN abs(yaw) > 50 OR abs(pitch) > 40 THEN 'extreme_pose'
  WHEN jit > 1.2 THEN format('tracking_jitter (velocity {{:.2f}})', jit) WHEN conf < 0.35 THEN format('low_confidence ({{:.2f}})', conf) END AS reason FROM q""")
def _(spark, sf):
    c = F.col
    reason = vision.rejection_reason(c("w"), c("h"), c("area"), c("blur"), c("pitch"), c("yaw"), c("jit"), c("conf"), CFG)
    # The angles are computed values whose last printed digit may sit on a tie.
    return _quality(spark, sf).select("session_id", "frame_idx", F.when(reason.startswith("extreme_pose"), "extreme_pose").otherwise(reason).alias("reason"))


@query("mouth_activation", f"""WITH {CH}
  SELECT vec_id, {_c('jawOpen')} * 0.60::DOUBLE + {_c('jawOpen')} * 1.40::DOUBLE + {_c('mouthPucker')} * 0.25::DOUBLE
  + ({_c('mouthStretchLeft')} + {_c('mouthStretchRight')}) * 0.15::DOUBLE AS mouth FROM ch""")
def _(spark, sf):
    return _channels(spark, sf).select("vec_id", vision.mouth_activation(vision.channels("c")).alias("mouth"))


DENTAL = f"""{CH}, d0 AS (SELECT vec_id, {_c('jawOpen')} AS jaw, {_c('mouthClose')} AS cl, {_pair('mouthUpperUp')} AS up, {_pair('mouthLowerDown')} AS low, {_pair('mouthSmile')} AS sm FROM ch),
  d1 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, up * 1.5::DOUBLE + sm * 0.4::DOUBLE)) AS u, least(1.0::DOUBLE, greatest(0.0::DOUBLE, low * 1.6::DOUBLE + jaw * 0.5::DOUBLE)) AS l,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, jaw * 1.2::DOUBLE - cl * 0.8::DOUBLE)) AS g FROM d0),
  dental AS (SELECT vec_id, [u, l, g, CASE WHEN cl > 0.35 OR (jaw < 0.06 AND up < 0.08) THEN 0.0::DOUBLE WHEN low > 0.25 AND u > 0.15 AND jaw < 0.25 THEN 1.0::DOUBLE
    WHEN (u > 0.20 OR l > 0.20) AND jaw < 0.35 THEN 2.0::DOUBLE WHEN jaw >= 0.35 THEN 3.0::DOUBLE WHEN sm > 0.30 THEN 4.0::DOUBLE ELSE 5.0::DOUBLE END] AS dental FROM d1)"""


@query("dental_features", f"WITH {DENTAL} SELECT * FROM dental")
def _(spark, sf):
    return _channels(spark, sf).select("vec_id", vision.dental_features(vision.channels("c")).alias("dental"))


@query("dental_class_live", f"""WITH {CH}, d0 AS (SELECT vec_id, {_c('jawOpen')} AS jaw,
    least(1.0::DOUBLE, greatest({_c('mouthUpperUpLeft')}, {_c('mouthUpperUpRight')}) * 1.5::DOUBLE + greatest({_c('mouthSmileLeft')}, {_c('mouthSmileRight')}) * 0.4::DOUBLE) AS u,
    least(1.0::DOUBLE, greatest({_c('mouthLowerDownLeft')}, {_c('mouthLowerDownRight')}) * 1.6::DOUBLE + {_c('jawOpen')} * 0.3::DOUBLE) AS l FROM ch)
  SELECT vec_id, CASE WHEN jaw < 0.04 AND greatest(u, l) < 0.12 THEN 'TEETH OCCLUDED /P,B,M/' WHEN u > 0.32 AND jaw < 0.20 AND l < 0.25 THEN 'LABIODENTAL /F,V/'
    WHEN jaw < 0.22 AND (u > 0.22 OR l > 0.22) THEN 'DENTAL /S,Z,TH/' WHEN jaw >= 0.22 THEN 'OPEN VOWEL /AA,AH/' ELSE 'SMILE TEETH SHOW' END AS dental_class FROM d0""")
def _(spark, sf):
    return _channels(spark, sf).select("vec_id", vision.dental_class(vision.channels("c")).alias("dental_class"))


EMOTION = f"""{CH}, e0 AS (SELECT vec_id, {_pair('mouthSmile')} AS sm, {_pair('cheekSquint')} AS ck, {_pair('browDown')} AS br, {_pair('noseSneer')} AS ns, {_pair('mouthPress')} AS mp,
    {_c('browInnerUp')} AS bi, {_pair('eyeWide')} AS ew, {_pair('mouthFrown')} AS mf, {_c('mouthShrugLower')} AS ms FROM ch),
  emotion AS (SELECT vec_id, CASE WHEN (br > 0.35 AND ns > 0.20) OR (br > 0.45 AND mp > 0.25) THEN 2 WHEN (bi > 0.45 AND ew > 0.30) OR ew > 0.50 THEN 3
    WHEN sm > 0.30 AND (ck > 0.15 OR sm > 0.45) THEN 1 WHEN mf > 0.30 OR (ms > 0.35 AND bi > 0.25) THEN 4 ELSE 0 END AS emotion_id FROM e0)"""


@query("emotion_id", f"WITH {EMOTION} SELECT * FROM emotion")
def _(spark, sf):
    return _channels(spark, sf).select("vec_id", vision.emotion_id(vision.channels("c")).alias("emotion_id"))


@query("emotion_distribution", f"WITH {EMOTION} SELECT emotion_id, count(*) AS n FROM emotion GROUP BY ALL")
def _(spark, sf):
    rows = _channels(spark, sf).select(vision.emotion_id(vision.channels("c")).alias("emotion_id"))
    return rows.groupBy("emotion_id").agg(F.count(F.lit(1)).alias("n"))


@query("gaze", f"""WITH {CH}, g AS (SELECT vec_id, (({_c('eyeLookOutLeft')} - {_c('eyeLookInLeft')}) + ({_c('eyeLookInRight')} - {_c('eyeLookOutRight')})) / 2.0::DOUBLE AS x,
    (({_c('eyeLookDownLeft')} - {_c('eyeLookUpLeft')}) + ({_c('eyeLookDownRight')} - {_c('eyeLookUpRight')})) / 2.0::DOUBLE AS y FROM ch)
  SELECT vec_id, x, y, CASE WHEN abs(x) < 0.10 AND abs(y) < 0.10 THEN 'FORWARD (CAMERA)' WHEN abs(x) >= abs(y) AND x < 0 THEN 'LOOKING LEFT'
    WHEN abs(x) >= abs(y) THEN 'LOOKING RIGHT' WHEN y < 0 THEN 'LOOKING UP' ELSE 'LOOKING DOWN' END AS gaze FROM g""")
def _(spark, sf):
    return _channels(spark, sf).select("vec_id", vision.gaze(vision.channels("c")).alias("g")).select("vec_id", "g.*")


MIRROR = mirror_index(21)
FLIP = f"fl AS (SELECT vec_id, s[:63] AS p, [{', '.join(f'{sign}s[{MIRROR[i] * 3 + axis + 1}]' for i in range(21) for axis, sign in ((0, '-'), (1, ''), (2, '')))}] AS f FROM sig)"


@query("flip_landmarks", f"WITH {SIG}, {FLIP} SELECT vec_id, f AS flipped FROM fl")
def _(spark, sf):
    return _signal(spark, sf).select("vec_id", vision.flip(F.slice("s", 1, 63), 21).alias("flipped"))


@query("symmetric_parts", f"""WITH {SIG}, {FLIP} SELECT vec_id, list_transform(range(63), lambda i: (p[i + 1] + f[i + 1]) * 0.5::DOUBLE) AS symmetric,
  list_transform(range(63), lambda i: (p[i + 1] - f[i + 1]) * 0.5::DOUBLE) AS residual FROM fl""")
def _(spark, sf):
    return _signal(spark, sf).select("vec_id", vision.decompose(F.slice("s", 1, 63), 21).alias("d")).select("vec_id", "d.*")


@query("mel_scale", f"""WITH {EV}, m AS (SELECT frame_idx, 2595.0::DOUBLE * log10(1.0::DOUBLE + x * 16 / 700.0::DOUBLE) AS mel FROM ev)
  SELECT frame_idx, CAST(round(mel * 1e6) AS BIGINT) AS micromel, CAST(round(700.0::DOUBLE * (pow(10.0::DOUBLE, mel / 2595.0::DOUBLE) - 1.0::DOUBLE) * 1e6) AS BIGINT) AS microhertz FROM m""")
def _(spark, sf):
    rows = ev_frames(spark, sf).select("frame_idx", audio.hz_to_mel(F.col("x") * 16).alias("mel"))
    return rows.select("frame_idx", F.round(F.col("mel") * 1e6).cast("long").alias("micromel"),
                       F.round(audio.mel_to_hz(F.col("mel")) * 1e6).cast("long").alias("microhertz"))


@query("rms_zcr", f"""WITH {SIG} SELECT vec_id, sqrt({_sum('list_transform(s, lambda x: x * x)')} / len(s)) AS rms,
  {_sum('list_transform(range(1, len(s)), lambda i: abs(sign(s[i + 1]) - sign(s[i])) * 1.0::DOUBLE)')} / (len(s) - 1) / 2.0::DOUBLE AS zcr FROM sig""")
def _(spark, sf):
    return _signal(spark, sf).select("vec_id", audio.rms(F.col("s")).alias("rms"), audio.zcr(F.col("s")).alias("zcr"))


@query("pcm_scaling", """WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 30000) AS INTEGER)) AS s FROM embeddings)
  SELECT vec_id, list_transform(s, lambda x: x / 32768.0::DOUBLE) AS s16, list_transform(s, lambda x: x / 2147483648.0::DOUBLE) AS s32,
  list_transform(s, lambda x: (x - 128.0::DOUBLE) / 128.0::DOUBLE) AS u8 FROM i""")
def _(spark, sf):
    s = F.col("s")
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * 30000).cast("int")).alias("s"))
    return rows.select("vec_id", audio.pcm_to_float(s, 2).alias("s16"), audio.pcm_to_float(s, 4).alias("s32"), audio.pcm_to_float(s, 1).alias("u8"))


@query("downmix_normalize", f"""WITH {SIG}, m AS (SELECT vec_id, list_transform(range(32), lambda i: (s[2 * i + 1] + s[2 * i + 2]) / 2) AS mono FROM sig),
  p AS (SELECT *, list_max(list_transform(mono, lambda x: abs(x))) AS peak FROM m)
  SELECT vec_id, CASE WHEN peak > 1e-4 THEN list_transform(mono, lambda x: x / peak) ELSE mono END AS mono FROM p""")
def _(spark, sf):
    rows = _signal(spark, sf).select("vec_id", audio.downmix(F.col("s"), 2).alias("m"))
    return rows.select("vec_id", audio.peak_normalize(F.col("m")).alias("mono"))


@query("fallback_spectrum", f"""WITH {EV}, e AS (SELECT session_id, frame_idx, CASE WHEN event_type = 'purchase' THEN x / 100 ELSE 0.0 END AS energy, level / 4.0::DOUBLE AS prob,
    CASE WHEN session_id < 50 THEN 0.0 ELSE x END AS band FROM ev),
  m AS (SELECT *, max(band) OVER (PARTITION BY session_id) AS mb, max(energy) OVER (PARTITION BY session_id) AS me FROM e)
  SELECT session_id, frame_idx, list_transform(range(64), lambda i: CASE WHEN mb < 1e-5 AND me > 1e-4 THEN CASE WHEN i < 8 THEN energy * 0.8::DOUBLE WHEN i < 24 THEN energy * 1.0::DOUBLE
    WHEN i < 48 THEN energy * 0.6::DOUBLE ELSE energy * 0.3::DOUBLE * prob END ELSE band END) AS spectral FROM m""")
def _(spark, sf):
    band = F.when(F.col("session_id") < 50, 0.0).otherwise(F.col("x"))
    rows = ev_frames(spark, sf).select(
        "session_id", "frame_idx", F.when(F.col("event_type") == "purchase", F.col("x") / 100).otherwise(0.0).alias("energy"),
        (F.col("level") / 4.0).alias("prob"), F.array_repeat(band, 64).alias("spectral"),
    )
    return features.fallback_spectrum(rows).select("session_id", "frame_idx", "spectral")


@query("text_labels", f"""WITH {EV}, k AS (SELECT frame_idx, x, CAST(floor(x) AS BIGINT) AS s FROM ev)
  SELECT frame_idx, format('{{}}m {{}}s', s // 60, s % 60) AS duration, format('{{:02d}}:{{:02d}}.{{:03d}}', s // 60, s % 60, CAST(floor(x * 1000) AS BIGINT) % 1000) AS clock,
  format('dataset_chunk_w{{}}_{{}}_{{:04d}}.tar.gz', s % 7, s, frame_idx) AS chunk, 'w' || (s % 7) AS worker FROM k""")
def _(spark, sf):
    s = F.floor("x").cast("long")
    worker = F.concat(F.lit("w"), (s % 7).cast("string"))
    name = text.chunk_name(worker, s.cast("string"), F.col("frame_idx"))
    return ev_frames(spark, sf).select(
        "frame_idx", text.fmt_duration(F.col("x")).alias("duration"), text.fmt_clock(F.col("x")).alias("clock"),
        name.alias("chunk"), text.chunk_worker(name).alias("worker"),
    )


@query("size_labels", """SELECT o_orderkey, round_even(o_totalprice * 1000 / 1048576.0::DOUBLE, 2) AS mb, round_even(o_totalprice * 1000 / 1073741824.0::DOUBLE, 2) AS gb FROM orders""")
def _(spark, sf):
    size = F.col("o_totalprice") * 1000
    return table(spark, sf, "orders").select("o_orderkey", text.megabytes(size).alias("mb"), text.gigabytes(size).alias("gb"))


@query("to_ns", f"WITH {EV} SELECT frame_idx, CAST(trunc(x * 1e9) AS BIGINT) AS t_ns FROM ev")
def _(spark, sf):
    return ev_frames(spark, sf).select("frame_idx", vision.to_ns(F.col("x")).alias("t_ns"))


@query("status_badge", f"""WITH {EV}, b AS (SELECT frame_idx, level >= 2 AS rec, CASE event_type WHEN 'purchase' THEN 'ACTIVE_SPEECH' WHEN 'click' THEN 'CONVERSATIONAL_PAUSE' ELSE 'SILENCE' END AS st, face_id AS f FROM ev)
  SELECT frame_idx, CASE WHEN rec AND st = 'ACTIVE_SPEECH' THEN '[*] RECORDING: ACTIVE SYLLABLE SPEECH' WHEN rec AND st = 'CONVERSATIONAL_PAUSE' THEN '[*] RECORDING: CONVERSATIONAL PAUSE / IDLE'
    WHEN f > 1 THEN '[!] PAUSED: MULTIPLE FACES DETECTED (Strict Single-Face Gate)' WHEN f = 1 THEN '[-] WAITING: SILENCE / LISTENER DETECTED (Audio Gate Closed)'
    ELSE '[-] SEARCHING: NO FACE DETECTED IN TARGET WINDOW' END AS badge FROM b""")
def _(spark, sf):
    state = F.when(F.col("event_type") == "purchase", "ACTIVE_SPEECH").when(F.col("event_type") == "click", "CONVERSATIONAL_PAUSE").otherwise("SILENCE")
    return ev_frames(spark, sf).select("frame_idx", text.status_badge(F.col("level") >= 2, state, F.col("face_id")).alias("badge"))


WORDS = "|".join(re.escape(w) for w in (*EXCLUDED_WORDS, "tion", "that"))


@query("valid_candidate", f"""SELECT doc_id FROM documents WHERE length(substr(md5(text), 1, 11)) = 11 AND NOT regexp_matches(lower(text), '{WORDS}')
  AND n_chars BETWEEN 70 AND 10800""")
def _(spark, sf):
    from kinetable.operators.filters import valid_candidate

    docs = table(spark, sf, "documents").withColumn("id", F.substring(F.md5("text"), 1, 11))
    return valid_candidate(docs, (*EXCLUDED_WORDS, "tion", "that"), title="text", duration="n_chars").select("doc_id")


@query("frame_rms", f"""WITH {SIG}, e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(s) AS x FROM sig),
  f AS (SELECT vec_id, i // 16 AS frame, list(x * x ORDER BY i) AS sq FROM e GROUP BY ALL),
  r AS (SELECT vec_id, frame, sqrt({_sum('sq')} / 16) AS rms FROM f), m AS (SELECT *, max(rms) OVER (PARTITION BY vec_id) AS top FROM r)
  SELECT vec_id, frame, CASE WHEN top > 0 THEN rms / top ELSE rms END AS rms FROM m""")
def _(spark, sf):
    return features.frame_rms(_signal(spark, sf).withColumnRenamed("s", "samples"), 16, key="vec_id")


@query("jitter", f"""WITH {VEC}, d AS (SELECT *, lag(v) OVER (PARTITION BY session_id ORDER BY frame_idx) AS p, frame_idx - lag(frame_idx) OVER (PARTITION BY session_id ORDER BY frame_idx) AS dt FROM vec)
  SELECT session_id, frame_idx, CASE WHEN p IS NULL THEN 0.0 ELSE ({" + ".join(
      f"sqrt((CAST(v[{3 * k + 1}] AS DOUBLE) - CAST(p[{3 * k + 1}] AS DOUBLE)) * (CAST(v[{3 * k + 1}] AS DOUBLE) - CAST(p[{3 * k + 1}] AS DOUBLE)) + (CAST(v[{3 * k + 2}] AS DOUBLE) - CAST(p[{3 * k + 2}] AS DOUBLE)) * (CAST(v[{3 * k + 2}] AS DOUBLE) - CAST(p[{3 * k + 2}] AS DOUBLE)))"
      for k in (1, 3, 6, 9, 12))}) / 5 / greatest(1e-4::DOUBLE, CAST(dt AS DOUBLE)) END AS jitter FROM d""")
def _(spark, sf):
    from kinetable.config import Config
    from kinetable.operators.windows import jitter
    from kinetable.plans.bindings import VEC_LINE

    rows = vectors(spark, sf).withColumn("v", F.col("v").cast("array<double>"))
    return jitter(rows, Config(), "v", (1, 3, 6, 9, 12), VEC_LINE).select("session_id", "frame_idx", "jitter")
