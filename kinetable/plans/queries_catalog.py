"""Queries over the catalogue: sessions, queue, registry, locks, archives, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS, LEVELS, ROLES
from kinetable.functions import text
from kinetable.operators import catalog, filters, joins, listing, windows
from kinetable.operators.ordered import Timeline
from kinetable.plans.bindings import CFG, DAY_US, EV, LINE, ev_frames, micros, table
from kinetable.plans.queries_features import ID_SQL, SPELL, spellings
from kinetable.plans.registry import query

YEAR_S = 86_400 * 365
NOW_S = 1_000_000_000

# A1 to A5, A20 and friends: sessions are users, frames their events.

SUMMARY = f"""{EV}, sm AS (SELECT session_id, (max(t) - min(t)) / {DAY_US}::DOUBLE AS s, count(*) AS total_video_frames,
    list_sort(list(DISTINCT face_id)) AS tracked_face_ids, arg_max(face_id, (t, frame_idx)) FILTER (WHERE is_primary) AS primary_face_id,
    count(*) FILTER (WHERE event_type = 'view') AS total_audio_frames FROM ev GROUP BY session_id)"""


@query("session_summary", f"""WITH {SUMMARY} SELECT session_id, round_even(greatest(0.0::DOUBLE, s), 3) AS duration_seconds, total_video_frames, total_audio_frames, tracked_face_ids,
  primary_face_id, round_even(CASE WHEN s > 0 THEN (total_video_frames - 1) / s ELSE 0.0 END, 1) AS average_capture_fps FROM sm""")
def _(spark, sf):
    frames = ev_frames(spark, sf)
    return catalog.session_summary(frames, frames.filter(F.col("event_type") == "view"), DAY_US)


def _domain(column, values):
    return ", ".join(f"count(*) FILTER (WHERE {column} = {v!r}) AS n_{str(v).lower()}" for v in values)


@query("level_histogram", f"WITH {EV} SELECT session_id, {_domain('level', LEVELS)} FROM ev GROUP BY session_id")
def _(spark, sf):
    return catalog.histogram(ev_frames(spark, sf), "level", LEVELS)


@query("role_histogram", f"WITH {EV} SELECT session_id, {_domain('role', ROLES)} FROM ev GROUP BY session_id")
def _(spark, sf):
    return catalog.histogram(ev_frames(spark, sf), "role", ROLES)


# Sessions of the report: an order is a session; open orders have no metadata.
SESS = """sess AS (SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(trunc(o_totalprice / 100) AS BIGINT) END AS total_video_frames,
    CAST(trunc(o_totalprice) AS BIGINT) AS duration_seconds, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS speaker_count, CAST(trunc(o_totalprice / 1000) AS BIGINT) AS pause_count,
    CAST(trunc(o_totalprice * 10) AS BIGINT) AS size_bytes FROM orders)"""


def _sessions(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.when(F.col("o_orderstatus") != "O", (price / 100).cast("long")).alias("total_video_frames"),
        price.cast("long").alias("duration_seconds"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("speaker_count"),
        (price / 1000).cast("long").alias("pause_count"),
        (price * 10).cast("long").alias("size_bytes"),
    )


REPORT = f"""{SESS}, g AS (SELECT *, greatest(1, size_bytes // 15500) AS guess, total_video_frames IS NOT NULL AS known, greatest(1, coalesce(speaker_count, total_video_frames) + pause_count) AS lab FROM sess),
  rep AS (SELECT count(*) FILTER (WHERE size_bytes > 0) + 1 AS total_sessions, CAST(sum(CASE WHEN known THEN total_video_frames ELSE guess END) AS BIGINT) + 900 AS total_frames,
    sum(CASE WHEN known THEN duration_seconds ELSE guess / 30.0::DOUBLE END) + 30.0 AS total_duration_seconds, CAST(sum(size_bytes) AS BIGINT) + 900 * 15500 AS total_size_bytes,
    sum(CASE WHEN known THEN duration_seconds * (coalesce(speaker_count, total_video_frames) / lab) END) + 20.0 AS speech_seconds,
    sum(CASE WHEN known THEN duration_seconds * (pause_count / lab) END) + 10.0 AS pause_seconds FROM g)"""


def _report(spark, sf):
    return catalog.readiness(_sessions(spark, sf), 900, 20.0, 10.0)


ROUND = ("total_duration_seconds", "speech_seconds", "pause_seconds")


@query("readiness", f"""WITH {REPORT} SELECT total_sessions, total_frames, total_size_bytes, {", ".join(f"round_even({c}, 2) AS {c}" for c in ROUND)} FROM rep""")
def _(spark, sf):
    return _report(spark, sf).select("total_sessions", "total_frames", "total_size_bytes", *[F.bround(c, 2).alias(c) for c in ROUND])


# The report at its size, an eighth and a 512th of it, so that every label is met.
SCALES = (1, 8, 512)


@query("milestones", f"""WITH {REPORT}, sized AS (SELECT s AS scale, total_duration_seconds / s::DOUBLE AS total_duration_seconds FROM rep, (VALUES {", ".join(f"({s})" for s in SCALES)}) v(s)) SELECT scale, {", ".join(f"round_even(least(100.0::DOUBLE, total_duration_seconds / {s}::DOUBLE * 100.0::DOUBLE), 6) AS {n}_pct, total_duration_seconds >= {s} AS is_{n}_ready" for n, s in catalog.TARGETS.items())},
  CASE WHEN total_duration_seconds >= 3600000 THEN format('READY: 1,000h SCALE DATASET COMPLETE ({{:.1f}}h)', round_even(total_duration_seconds / 3600, 1))
  WHEN total_duration_seconds >= 360000 THEN format('PHASE 1 COMPLETE ({{:.1f}}h / 100h) - ADVANCING TO 1,000h TARGET', round_even(total_duration_seconds / 3600, 1))
  ELSE format('PHASE 1 (100h TARGET): {{:.2f}}h / 100.0h ({{:.1f}}%) | {{:.1f}}h TO GO', round_even(total_duration_seconds / 3600, 2), round_even(least(100.0::DOUBLE, total_duration_seconds / 360000::DOUBLE * 100.0::DOUBLE), 1), round_even(greatest(0.0::DOUBLE, 100 - total_duration_seconds / 3600), 1)) END AS readiness_label FROM sized""")
def _(spark, sf):
    scaled = _report(spark, sf).withColumn("scale", F.explode(F.array(*[F.lit(s) for s in SCALES])))
    scaled = scaled.withColumn("total_duration_seconds", F.col("total_duration_seconds") / F.col("scale"))
    out = catalog.milestones(scaled)
    return out.select(
        "scale",
        *[F.bround(f"{n}_pct", 6).alias(f"{n}_pct") for n in catalog.TARGETS], *[f"is_{n}_ready" for n in catalog.TARGETS], "readiness_label"
    )


# Queue: orders; P in progress, O pending, F completed.
QUEUE = """q AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS pos, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'in_progress' END AS status,
    o_orderpriority AS title, CAST(NULL AS VARCHAR) AS session_id, o_custkey AS frame_count, o_totalprice / 1000 AS duration_seconds, CAST(NULL AS VARCHAR) AS error_message, epoch_us(o_orderdate) AS t FROM orders)"""


def queue_view(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("pos"), status.alias("status"), F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("session_id"), F.col("o_custkey").alias("frame_count"), (F.col("o_totalprice") / 1000).alias("duration_seconds"),
        F.lit(None).cast("string").alias("error_message"), micros("o_orderdate").alias("t"),
    )


@query("queue_summary", f"""WITH {QUEUE}, {REPORT} SELECT (SELECT count(*) FROM q) AS queue_total, (SELECT count(*) FROM q WHERE status IN ('completed', 'already_recorded')) AS queue_completed,
  (SELECT count(*) FROM q WHERE status = 'pending') AS queue_pending, (SELECT count(*) FROM q WHERE status = 'in_progress') AS queue_in_progress, (SELECT count(*) FROM q WHERE status = 'failed') AS queue_failed,
  total_sessions AS dataset_sessions, total_frames AS dataset_frames, round_even(total_duration_seconds / 3600.0::DOUBLE, 2) AS dataset_hours, round_even(speech_seconds / 3600.0::DOUBLE, 2) AS speech_hours,
  round_even(total_size_bytes / 1073741824.0::DOUBLE, 2) AS gb_used, round_even(least(100.0::DOUBLE, total_duration_seconds / 3600.0::DOUBLE), 2) AS phase1_pct,
  round_even(greatest(0.0::DOUBLE, 100.0::DOUBLE - total_duration_seconds / 3600.0::DOUBLE), 2) AS phase1_remaining_hours,
  round_even(least(100.0::DOUBLE, total_duration_seconds / 3600.0::DOUBLE / 1000.0::DOUBLE * 100.0::DOUBLE), 2) AS scale_pct, 47.9::DOUBLE AS estimated_gb_100h, 479.1::DOUBLE AS estimated_gb_1000h FROM rep""")
def _(spark, sf):
    return catalog.queue_summary(queue_view(spark, sf), _report(spark, sf))


@query("reset_status", f"WITH {QUEUE} SELECT key, CASE status WHEN 'in_progress' THEN 'pending' ELSE status END AS status, status = 'in_progress' AS was_reset FROM q")
def _(spark, sf):
    return filters.reset_status(queue_view(spark, sf), "in_progress").select("key", "status", "was_reset")


@query("reset_short", f"""WITH {QUEUE} SELECT key, CASE WHEN status = 'completed' AND duration_seconds < 100 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'completed' AND duration_seconds < 100 THEN 0.0 ELSE duration_seconds END AS duration_seconds FROM q""")
def _(spark, sf):
    return filters.reset_short(queue_view(spark, sf), 100.0).select("key", "status", "duration_seconds")


@query("purge_completed", f"WITH {QUEUE} SELECT key FROM q WHERE NOT (duration_seconds < 15 OR frame_count < 50)")
def _(spark, sf):
    return filters.purge_completed(queue_view(spark, sf)).select("key")


@query("classify_yield", f"""WITH {QUEUE} SELECT key, CASE WHEN frame_count < 30 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN frame_count < 30 THEN 'Zero or insufficient frames recorded (' || frame_count || ' frames)' END AS error_message FROM q""")
def _(spark, sf):
    return filters.classify_yield(queue_view(spark, sf)).select("key", "status", "error_message")


@query("next_pending", f"""WITH {QUEUE} SELECT key, pos FROM q WHERE status = 'pending' AND key NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem) ORDER BY pos LIMIT 1""")
def _(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"))
    return catalog.next_pending(queue_view(spark, sf), used).select("key", "pos")


@query("latest_completed", f"WITH {QUEUE} SELECT key, pos FROM q WHERE status = 'completed' ORDER BY t DESC, pos DESC LIMIT 3")
def _(spark, sf):
    done = queue_view(spark, sf).filter(F.col("status") == "completed")
    return catalog.latest_n(done, ["t", "pos"], 3).select("key", "pos")


@query("speed_factor", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / greatest(0.1::DOUBLE, l_quantity) AS speed FROM lineitem")
def _(spark, sf):
    speed = catalog.speed_factor(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", speed.alias("speed"))


# Registry: a line item is a recording, its part the source.
REC = """rec AS (SELECT 'https://youtu.be/' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 11) AS url, CASE l_returnflag WHEN 'R' THEN 'YouTube Video' WHEN 'A' THEN '' ELSE l_linestatus || ' | talk' END AS title,
    CASE l_linestatus WHEN 'F' THEN '720p' ELSE '' END AS quality, l_orderkey AS session_id, CAST(l_quantity AS BIGINT) AS frame_count, CAST(round(l_extendedprice) AS BIGINT) AS duration_seconds,
    epoch_us(l_shipdate) AS t, l_orderkey AS o1, l_linenumber AS o2, substr(md5(CAST(l_partkey AS VARCHAR)), 1, 11) AS key FROM lineitem)"""
ORDER = ["t", "o1", "o2"]


def recordings(spark, sf):
    video = F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 11)
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("https://youtu.be/"), video).alias("url"),
        F.when(F.col("l_returnflag") == "R", "YouTube Video").when(F.col("l_returnflag") == "A", "").otherwise(F.concat("l_linestatus", F.lit(" | talk"))).alias("title"),
        F.when(F.col("l_linestatus") == "F", "720p").otherwise("").alias("quality"),
        F.col("l_orderkey").alias("session_id"), F.col("l_quantity").cast("long").alias("frame_count"), F.round("l_extendedprice").cast("long").alias("duration_seconds"),
        micros("l_shipdate").alias("t"), F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"),
    )


REG = f"""{REC}, seen AS (SELECT key, session_id, min((t, o1, o2)) AS f FROM rec GROUP BY ALL), ls AS (SELECT key, count(*) AS session_count, arg_max(session_id, (f, session_id)) AS last_session FROM seen GROUP BY key),
  reg AS (SELECT key, key AS video_id, 'https://www.youtube.com/watch?v=' || key AS canonical_url, min(url) AS raw_url,
    coalesce(arg_max(title, (t, o1, o2)) FILTER (WHERE title NOT IN ('', 'YouTube Video')), nullif(arg_min(title, (t, o1, o2)), ''), 'Stream Video') AS title,
    coalesce(arg_max(quality, (t, o1, o2)) FILTER (WHERE quality <> ''), '480p') AS quality, min(t) AS first_recorded_at, max(t) AS last_recorded_at, count(*) AS recorded_count,
    CAST(sum(frame_count) AS BIGINT) AS total_frames, CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds FROM rec GROUP BY key),
  registry AS (SELECT * FROM reg JOIN ls USING (key))"""


def registry_view(spark, sf):
    return catalog.build_registry(recordings(spark, sf), ORDER)


@query("build_registry", f"WITH {REG} SELECT * FROM registry")
def _(spark, sf):
    return registry_view(spark, sf)


@query("registry_sessions", f"WITH {REG} SELECT key, session_id, row_number() OVER (PARTITION BY key ORDER BY f, session_id) - 1 AS ordinal FROM seen")
def _(spark, sf):
    return catalog.registry_sessions(recordings(spark, sf), ORDER)


@query("registry_totals", f"""WITH {REG} SELECT count(*) AS videos, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(total_frames) AS BIGINT) AS frames, round_even(sum(total_duration_seconds) / 60.0::DOUBLE, 1) AS minutes,
  round_even(sum(total_duration_seconds) / 3600.0::DOUBLE, 2) AS hours, round_even(least(100.0::DOUBLE, sum(total_duration_seconds) / 360000.0::DOUBLE * 100.0::DOUBLE), 2) AS phase1_pct FROM registry""")
def _(spark, sf):
    return catalog.registry_totals(registry_view(spark, sf))


@query("registry_rows", f"""WITH {REG} SELECT key, replace(title, '|', '-') AS title, '[' || video_id || '](' || canonical_url || ')' AS link, '`' || session_count || '` sess (`' || substr(CAST(last_session AS VARCHAR), 1, 18) || '..`)' AS sessions,
  format('{{:,}}', total_frames) AS frames, format('{{:.1f}}m ({{:.0f}}s)', round_even(total_duration_seconds::DOUBLE / 60, 1), round_even(total_duration_seconds::DOUBLE, 0)) AS duration FROM registry""")
def _(spark, sf):
    return catalog.registry_rows(registry_view(spark, sf))


# Session metadata from page text: the description may hold the URL.
META = """meta AS (SELECT page_id AS session_id, 'Recorded Stream: ' || url || ' (main)' AS source_description, CASE WHEN url LIKE '%#top' THEN url ELSE '' END AS u, CASE WHEN url LIKE 'https%' THEN 'T' || page_id END AS ti,
    length(html) AS total_video_frames, length(url) AS duration_seconds FROM pages)"""


@query("backfill_recordings", f"""WITH {META} SELECT CASE WHEN u <> '' THEN u ELSE regexp_extract(source_description, 'https?://[^\\s\\)''"]+') END AS url, coalesce(ti, 'Recorded Stream Video') AS title, '480p' AS quality,
  session_id, total_video_frames AS frame_count, duration_seconds FROM meta""")
def _(spark, sf):
    telemetry = F.create_map(
        F.lit("source_url"), F.when(F.col("url").endswith("#top"), F.col("url")).otherwise(""),
        F.lit("video_title"), F.when(F.col("url").startswith("https"), F.concat(F.lit("T"), F.col("page_id").cast("string"))),
    )
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("session_id"), F.concat(F.lit("Recorded Stream: "), "url", F.lit(" (main)")).alias("source_description"), telemetry.alias("telemetry"),
        F.length("html").cast("long").alias("total_video_frames"), F.length("url").cast("long").alias("duration_seconds"),
    )
    return catalog.backfill_recordings(rows)


# Registry of pages, stored in three different ways: under the id, under a key of its own, or inside a list URL.
STORE = """store AS (SELECT page_id AS pos, substr(md5(url), 1, 11) AS id, url FROM pages),
  regp AS (SELECT pos, CASE WHEN url LIKE 'http://%' THEN id ELSE 'k' || pos END AS key, CASE WHEN url LIKE 'https://m.%' THEN 'https://www.youtube.com/watch?v=' || id ELSE url END AS canonical_url,
    CASE WHEN url LIKE 'https://blog%' THEN 'https://host.example/list?items=' || id || '+x' ELSE url END AS raw_url FROM store)"""


def stored_pages(spark, sf):
    u, i = F.col("url"), F.substring(F.md5("url"), 1, 11)
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("pos"),
        F.when(u.startswith("http://"), i).otherwise(F.concat(F.lit("k"), F.col("page_id").cast("string"))).alias("key"),
        F.when(u.startswith("https://m."), F.concat(F.lit(text.CANONICAL), i)).otherwise(u).alias("canonical_url"),
        F.when(u.startswith("https://blog"), F.concat(F.lit("https://host.example/list?items="), i, F.lit("+x"))).otherwise(u).alias("raw_url"),
    )


LOOKUP = f"""{SPELL}, {STORE}, a AS (SELECT page_id, spelling, {ID_SQL} AS vid, trim(spelling) AS raw FROM urls), a2 AS (SELECT *, CASE WHEN vid IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || vid ELSE raw END AS canon FROM a),
  hits AS (SELECT a2.spelling, r.key AS rk, r.pos, CASE WHEN vid = r.key THEN 1 WHEN canon = r.canonical_url OR raw = r.raw_url THEN 2 ELSE 3 END AS tier FROM a2 JOIN regp r ON vid = r.key OR canon = r.canonical_url OR raw = r.raw_url
    OR contains(r.canonical_url, vid) OR contains(r.raw_url, vid)),
  best AS (SELECT spelling, arg_min(rk, (tier, pos, rk)) AS registry_key, min(tier) AS tier FROM hits GROUP BY spelling)"""


@query("lookup_registry", f"WITH {LOOKUP} SELECT page_id, a2.spelling, registry_key, tier FROM a2 LEFT JOIN best ON best.spelling = a2.spelling")
def _(spark, sf):
    urls = spellings(spark, sf).select("page_id", "spelling")
    return catalog.lookup_registry(urls, stored_pages(spark, sf), "spelling")


@query("sync_queue", f"""WITH {LOOKUP}, k AS (SELECT coalesce(vid, raw) AS key, min((page_id, raw)) AS f FROM a2 GROUP BY 1), old AS (SELECT substr(md5(url), 1, 11) AS key, page_id AS pos FROM pages WHERE url LIKE '%#top'),
  fresh AS (SELECT key, f[1] AS pos, f[2] AS raw_url FROM k WHERE key NOT IN (SELECT key FROM old)), top AS (SELECT max(pos) + 1 AS top FROM old),
  bestr AS (SELECT trim(spelling) AS raw, min(registry_key) AS registry_key FROM best GROUP BY 1)
  SELECT key, pos, 'pending' AS status FROM old UNION ALL SELECT key, pos + top, CASE WHEN registry_key IS NOT NULL THEN 'already_recorded' ELSE 'pending' END FROM fresh CROSS JOIN top LEFT JOIN bestr ON bestr.raw = raw_url""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    queue = pages.filter(F.col("url").endswith("#top")).select(F.substring(F.md5("url"), 1, 11).alias("key"), F.col("page_id").alias("pos"), F.lit("pending").alias("status"))
    urls = spellings(spark, sf).select(F.col("page_id").alias("pos"), F.col("spelling").alias("url"))
    registry = stored_pages(spark, sf).withColumns({
        "title": F.col("key"), "last_session": F.col("key"), "total_frames": F.col("pos"), "total_duration_seconds": F.col("pos").cast("double")})
    return catalog.sync_queue(queue, urls, registry).select("key", "pos", "status")


# Claims: line items of an order give its completion record, orders in progress hold locks.
CLAIM = f"""{QUEUE}, done AS (SELECT l_orderkey AS pos, CAST(l_orderkey AS VARCHAR) AS key, CAST(max(l_partkey) + 1000000 AS VARCHAR) AS video_id, CAST(min(l_suppkey) AS VARCHAR) AS canonical_url, min(l_quantity) AS duration_seconds FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
  locks AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS worker_id, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS last_heartbeat FROM orders WHERE o_orderstatus = 'P')"""


def _completed(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F").groupBy("l_orderkey").agg(
        (F.max("l_partkey") + 1000000).cast("string").alias("video_id"), F.min("l_suppkey").cast("string").alias("canonical_url"), F.min("l_quantity").alias("duration_seconds"),
    ).select(F.col("l_orderkey").alias("pos"), F.col("l_orderkey").cast("string").alias("key"), "video_id", "canonical_url", "duration_seconds")


def _locks(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("worker_id"), F.floor(micros("o_orderdate") / 1000000).cast("long").alias("last_heartbeat"))


@query("claimable", f"""WITH {CLAIM}, m AS (SELECT q.key, d.duration_seconds AS d, CASE WHEN d.key = q.key THEN 1 ELSE 2 END AS tier, d.pos FROM q JOIN done d ON d.key = q.key OR d.video_id = q.key OR d.canonical_url = q.key),
  f AS (SELECT key, arg_min(d, (tier, pos)) AS d FROM m GROUP BY key)
  SELECT q.key, CASE WHEN f.d >= 15 THEN 'already_completed' WHEN l.worker_id = '1-URGENT' THEN 'reclaimed_own_lock' WHEN {NOW_S} - l.last_heartbeat < {YEAR_S} THEN 'locked_by_other' ELSE 'claimed' END AS outcome
  FROM q LEFT JOIN f USING (key) LEFT JOIN locks l ON l.key = q.key""")
def _(spark, sf):
    out = catalog.claimable(queue_view(spark, sf), _completed(spark, sf), _locks(spark, sf), F.lit(NOW_S), "1-URGENT", YEAR_S)
    return out.select("key", "outcome")


@query("stale_locks", f"WITH {CLAIM} SELECT key, worker_id FROM locks WHERE {NOW_S} - last_heartbeat > {YEAR_S} OR starts_with(worker_id, '5')")
def _(spark, sf):
    return catalog.stale_locks(_locks(spark, sf), F.lit(NOW_S), "5", YEAR_S).select("key", "worker_id")


@query("completed_totals", f"WITH {CLAIM} SELECT count(*) AS total_completed, round_even(sum(duration_seconds) / 3600.0::DOUBLE, 3) AS total_hours FROM done")
def _(spark, sf):
    return catalog.completed_totals(_completed(spark, sf))


EVENTS = """e AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS seq, CASE l_returnflag WHEN 'A' THEN 'start' WHEN 'N' THEN 'complete' ELSE 'fail' END AS kind,
    CASE l_linestatus WHEN 'F' THEN 'title ' || l_suppkey ELSE 'Pending Resolution' END AS title, 's' || l_partkey AS session_id, CAST(l_quantity AS BIGINT) AS frame_count, l_extendedprice AS duration_seconds, 'err ' || l_partkey AS error_message FROM lineitem)"""


def _events(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_returnflag") == "A", "start").when(F.col("l_returnflag") == "N", "complete").otherwise("fail").alias("kind"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("title "), F.col("l_suppkey").cast("string"))).otherwise("Pending Resolution").alias("title"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("session_id"), F.col("l_quantity").cast("long").alias("frame_count"),
        F.col("l_extendedprice").alias("duration_seconds"), F.concat(F.lit("err "), F.col("l_partkey").cast("string")).alias("error_message"),
    )


@query("apply_events", f"""WITH {QUEUE}, {EVENTS}, n AS (SELECT key, arg_max(CASE kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'in_progress' END, seq) AS st,
    arg_max(title, seq) FILTER (WHERE kind <> 'fail' AND title <> 'Pending Resolution') AS ti, arg_max(session_id, seq) FILTER (WHERE kind = 'complete') AS se, arg_max(frame_count, seq) FILTER (WHERE kind = 'complete') AS fr,
    arg_max(duration_seconds, seq) FILTER (WHERE kind = 'complete') AS du, arg_max(error_message, seq) FILTER (WHERE kind = 'fail') AS er FROM e GROUP BY key)
  SELECT q.key, coalesce(st, status) AS status, coalesce(ti, title) AS title, coalesce(se, session_id) AS session_id, coalesce(fr, frame_count) AS frame_count, coalesce(du, duration_seconds) AS duration_seconds, coalesce(er, error_message) AS error_message
  FROM q LEFT JOIN n USING (key)""")
def _(spark, sf):
    return catalog.apply_events(queue_view(spark, sf), _events(spark, sf)).drop("pos", "t")


@query("queue_stats", f"""WITH {EVENTS} SELECT count(*) AS total_completed, CAST(sum(frame_count) AS BIGINT) AS total_frames, CAST(sum(CAST(round(duration_seconds * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total_duration_sec FROM e WHERE kind = 'complete'""")
def _(spark, sf):
    return catalog.queue_stats(_events(spark, sf))


# Vaults: documents in A; labelled documents (sized in bytes of text) and pages in B.
VAULTS = """va AS (SELECT 'dataset_chunk_' || source || '_' || doc_id || '.tar.gz' AS name, n_chars AS size_bytes FROM documents),
  vb AS (SELECT 'dataset_chunk_' || source || '_' || doc_id || '.tar.gz' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'dataset_chunk_web_' || page_id || '.tar.gz', length(html) FROM pages),
  au AS (SELECT name, va.size_bytes AS size_a, vb.size_bytes AS size_b, va.name IS NOT NULL AS ina, vb.name IS NOT NULL AS inb FROM va FULL JOIN vb USING (name)),
  audit AS (SELECT name, size_a, size_b, CASE WHEN ina AND inb AND NOT (size_a > 0 AND size_b > 0 AND abs(size_a - size_b) > 100) THEN 'both' WHEN ina THEN 'a_only' ELSE 'b_only' END AS place,
    ina AND inb AND size_a > 0 AND size_b > 0 AND abs(size_a - size_b) > 100 AS size_mismatch FROM au)"""


def _vaults(spark, sf):
    name = F.concat(F.lit("dataset_chunk_"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".tar.gz"))
    docs = table(spark, sf, "documents")
    a = docs.select(name.alias("name"), F.col("n_chars").alias("size_bytes"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(name.alias("name"), F.octet_length("text").cast("long").alias("size_bytes"))
    web = table(spark, sf, "pages").select(
        F.concat(F.lit("dataset_chunk_web_"), F.col("page_id").cast("string"), F.lit(".tar.gz")).alias("name"), F.length("html").cast("long").alias("size_bytes"))
    return a, labelled.unionByName(web)


def _audit(spark, sf):
    return listing.audit_vaults(*_vaults(spark, sf), tolerance=100)


@query("audit_vaults", f"WITH {VAULTS} SELECT * FROM audit")
def _(spark, sf):
    return _audit(spark, sf)


@query("audit_report", f"""WITH {VAULTS}, c AS (SELECT count(*) AS total_chunks, count(*) FILTER (WHERE place = 'both') AS "both", count(*) FILTER (WHERE place = 'a_only') AS a_only, count(*) FILTER (WHERE place = 'b_only') AS b_only,
    greatest(sum(size_a), sum(size_b)) / 1048576.0::DOUBLE AS v FROM audit)
  SELECT total_chunks, "both", a_only, b_only, "both" / total_chunks * 100.0::DOUBLE AS redundancy_pct, round_even(v, 2) AS total_size_mb, round_even(v / 550.0::DOUBLE, 2) AS estimated_hours, round_even(least(100.0::DOUBLE, v / 550.0::DOUBLE), 1) AS milestone_pct FROM c""")
def _(spark, sf):
    return listing.audit_report(_audit(spark, sf))


@query("worker_contribution", f"WITH {VAULTS} SELECT split_part(replace(name, 'dataset_chunk_', ''), '_', 1) AS worker, CAST(sum(coalesce(nullif(size_a, 0), size_b, 0)) AS BIGINT) AS size_bytes FROM audit GROUP BY 1")
def _(spark, sf):
    return listing.worker_contribution(_audit(spark, sf))


@query("set_compare", f"""WITH {VAULTS} SELECT name, CASE WHEN ina AND inb THEN 'both' WHEN ina THEN 'a_only' ELSE 'b_only' END AS place FROM au""")
def _(spark, sf):
    return listing.set_compare(*_vaults(spark, sf))


@query("listing_totals", f"WITH {VAULTS} SELECT count(*) AS chunks, round_even(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS total_mb, round_even(sum(size_bytes) / 1073741824.0::DOUBLE, 2) AS total_gb FROM vb")
def _(spark, sf):
    return listing.listing_totals(_vaults(spark, sf)[1])


# Listings with copies: the first line of an order is the clean file, later lines are copies.
FILES = """f0 AS (SELECT 'part_' || l_orderkey || CASE WHEN l_linenumber = 1 THEN '' ELSE ' (' || (l_linenumber - 1) || ')' END || '.tar.gz' AS name, l_returnflag, l_quantity FROM lineitem),
  remote AS (SELECT name, nullif(CAST(sum(l_quantity) AS BIGINT), 50) AS size_bytes FROM f0 GROUP BY name),
  canon AS (SELECT CASE WHEN contains(name, ' (') THEN split_part(name, ' (', 1) || '.tar.gz' ELSE name END AS clean_name, arg_min((name, size_bytes), (contains(name, ' ('), name)) AS r, count(*) - 1 AS duplicates, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS b FROM remote GROUP BY 1),
  here AS (SELECT name, CAST(sum(l_quantity) AS BIGINT) * 100 AS size_bytes FROM f0 WHERE l_returnflag <> 'R' GROUP BY name)"""


def _files(spark, sf):
    number = F.col("l_linenumber")
    mark = F.when(number == 1, "").otherwise(F.concat(F.lit(" ("), (number - 1).cast("string"), F.lit(")")))
    name = F.concat(F.lit("part_"), F.col("l_orderkey").cast("string"), mark, F.lit(".tar.gz"))
    return table(spark, sf, "lineitem").select(name.alias("name"), "l_returnflag", "l_quantity")


def _remote(spark, sf, factor=1):
    size = F.sum("l_quantity").cast("long")
    return _files(spark, sf).groupBy("name").agg(F.nullif(size, F.lit(50)).alias("size_bytes")).withColumn("size_bytes", F.col("size_bytes") * factor)


def _local(spark, sf):
    rows = _files(spark, sf).filter(F.col("l_returnflag") != "R")
    return rows.groupBy("name").agg((F.sum("l_quantity").cast("long") * 100).alias("size_bytes"))


@query("canonical_names", f"WITH {FILES} SELECT clean_name, r[1] AS name, r[2] AS size_bytes, duplicates, b - coalesce(r[2], 0) AS duplicate_bytes FROM canon")
def _(spark, sf):
    return listing.canonical_names(_remote(spark, sf))


@query("delta_sync", f"""WITH {FILES}, need AS (SELECT clean_name, r[2] * 100 AS size_bytes FROM canon) SELECT clean_name, size_bytes FROM need n WHERE NOT EXISTS (SELECT 1 FROM here h
  WHERE (h.name = n.clean_name OR h.name = replace(n.clean_name, '.tar.gz', ' (1).tar.gz')) AND CASE WHEN n.size_bytes IS NULL THEN h.size_bytes > 1024 ELSE h.size_bytes = n.size_bytes END)""")
def _(spark, sf):
    return listing.delta_sync(_remote(spark, sf, 100), _local(spark, sf))


@query("drop_copies", f"WITH {FILES} SELECT name FROM remote WHERE NOT contains(name, ' (1)')")
def _(spark, sf):
    return listing.drop_copies(_remote(spark, sf)).select("name")


@query("unpacked_sessions", "SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    chunks = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.collect_set("l_orderkey").alias("session_ids"))
    return listing.unpacked_sessions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id")), chunks)


@query("pending_uploads", "SELECT CAST(o_orderkey AS VARCHAR) AS chunk_name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    done = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("chunk_name"))
    return listing.pending_uploads(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_name")), done)


@query("exclude_ids", "SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    labels, items = table(spark, sf, "labels").select(F.col("doc_id").alias("id")), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return listing.exclude_ids(docs, labels, items)


# Archives: ten sessions (orders) each.
ASSIGN = f"""{SESS}, asg AS (SELECT 'session_' || session_id AS session_id, duration_seconds, size_bytes, coalesce(total_video_frames, 0) AS frames, (row_number() OVER (ORDER BY 'session_' || session_id) - 1) // 10 AS chunk_id FROM sess)"""


def _assigned(spark, sf):
    rows = _sessions(spark, sf).withColumn("frames", F.coalesce("total_video_frames", F.lit(0)))
    rows = rows.withColumn("session_id", F.concat(F.lit("session_"), F.col("session_id").cast("string")))
    return listing.chunk_assignment(rows, Timeline((), ("session_id",), 1))


@query("chunk_assignment", f"WITH {ASSIGN} SELECT session_id, chunk_id FROM asg")
def _(spark, sf):
    return _assigned(spark, sf).select("session_id", "chunk_id")


@query("manifest", f"""WITH {ASSIGN} SELECT chunk_id, count(*) AS session_count, list(session_id ORDER BY session_id) AS session_ids, CAST(sum(frames) AS BIGINT) AS frames, round_even(sum(duration_seconds) / 3600.0::DOUBLE, 3) AS duration_hours,
  round_even(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS size_mb FROM asg GROUP BY chunk_id""")
def _(spark, sf):
    return listing.manifest(_assigned(spark, sf))


@query("manifest_totals", f"""WITH {ASSIGN} SELECT count(DISTINCT chunk_id) AS total_chunks, count(*) AS total_sessions, CAST(sum(frames) AS BIGINT) AS total_frames, round_even(sum(duration_seconds) / 3600.0::DOUBLE, 3) AS total_duration_hours,
  round_even(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS total_size_mb FROM asg""")
def _(spark, sf):
    return listing.manifest_totals(_assigned(spark, sf))


@query("session_inventory", f"""WITH {ASSIGN} SELECT session_id, frames, round_even(size_bytes / 1048576.0::DOUBLE, 2) AS size_mb, (SELECT count(*) FROM asg) AS total_sessions, (SELECT CAST(sum(frames) AS BIGINT) FROM asg) AS total_frames FROM asg ORDER BY session_id LIMIT 8""")
def _(spark, sf):
    return catalog.session_inventory(_assigned(spark, sf).select("session_id", "frames", "size_bytes"))


@query("dedup_first", """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem)
  SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM r WHERE r = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return catalog.dedup_first(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).drop("l_shipdate")


@query("ranked", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC")
def _(spark, sf):
    return catalog.ranked(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ascending=False)


@query("overlap", "SELECT doc_id AS id, 2::BIGINT AS parts FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs, labels = (table(spark, sf, n).select(F.col("doc_id").alias("id")) for n in ("documents", "labels"))
    return listing.overlap([docs, labels], "id")


@query("concat_sessions", """SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS blendshapes FROM embeddings UNION ALL SELECT item_id, list_transform(range(52), lambda i: 0.0::DOUBLE) FROM benchmark""")
def _(spark, sf):
    full = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("blendshapes"))
    return listing.concat_sessions([full, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))])


# Audio alignment: purchases are frames, views audio slices.
AV = f"""{EV}, fr AS (SELECT session_id, frame_idx, t FROM ev WHERE event_type = 'purchase'), au AS (SELECT session_id, frame_idx AS slice_idx, t, x FROM ev WHERE event_type = 'view'),
  cnt AS (SELECT f.session_id, f.n = a.n AS same FROM (SELECT session_id, count(*) AS n FROM fr GROUP BY 1) f JOIN (SELECT session_id, count(*) AS n FROM au GROUP BY 1) a USING (session_id))"""


def _av(spark, sf):
    ev = ev_frames(spark, sf)
    frames = ev.filter(F.col("event_type") == "purchase").select("session_id", "frame_idx", "t")
    return frames, ev.filter(F.col("event_type") == "view").select("session_id", F.col("frame_idx").alias("slice_idx"), "t", "x")


@query("align_audio", f"""WITH {AV}, pos AS (SELECT f.session_id, f.frame_idx, a.slice_idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_idx) AS i FROM fr) f
    JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY slice_idx) AS i FROM au) a USING (session_id, i) JOIN cnt USING (session_id) WHERE same),
  near AS (SELECT f.session_id, f.frame_idx, arg_min(a.slice_idx, (abs(a.t - f.t), a.slice_idx)) AS slice_idx FROM fr f JOIN cnt USING (session_id) JOIN au a USING (session_id) WHERE NOT same GROUP BY ALL)
  SELECT * FROM pos UNION ALL SELECT * FROM near UNION ALL SELECT session_id, frame_idx, NULL FROM fr WHERE session_id NOT IN (SELECT session_id FROM cnt)""")
def _(spark, sf):
    frames, audio = _av(spark, sf)
    return joins.align_audio(frames, audio, LINE.width).select("session_id", "frame_idx", "slice_idx")


@query("carry_audio", f"""WITH {AV} SELECT f.session_id, f.frame_idx, a.x FROM fr f ASOF LEFT JOIN au a ON a.session_id = f.session_id AND a.t <= f.t""")
def _(spark, sf):
    frames, audio = _av(spark, sf)
    return joins.carry_audio(frames, audio, LINE.width, ["x"]).select("session_id", "frame_idx", "x")


@query("join_audio_positional", f"""WITH f AS (SELECT conv_id AS session_id, turn AS frame_idx FROM conversations), {EV},
  a AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS slice_idx, CASE WHEN event_type = 'error' THEN NULL ELSE x END AS e, CASE WHEN event_type = 'click' THEN NULL ELSE level / 4.0::DOUBLE END AS p,
    CASE WHEN event_type <> 'view' THEN list_transform(range(CASE WHEN level = 1 THEN 63 ELSE 64 END), lambda b: x) END AS s FROM ev)
  SELECT f.session_id, f.frame_idx, CASE WHEN a.slice_idx IS NULL THEN 0.0 ELSE coalesce(e, 0.02::DOUBLE) END AS energy, CASE WHEN a.slice_idx IS NULL THEN 1.0::DOUBLE ELSE coalesce(p, 0.8::DOUBLE) END AS prob,
    CASE WHEN len(s) = 64 THEN s ELSE list_transform(range(64), lambda b: 0.0::DOUBLE) END AS spectral
  FROM f LEFT JOIN a ON a.session_id = f.session_id AND a.slice_idx = f.frame_idx""")
def _(spark, sf):
    frames = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("frame_idx"))
    audio = windows.row_index(ev_frames(spark, sf), LINE, "slice_idx").select(
        "session_id", "slice_idx", F.when(F.col("event_type") != "error", F.col("x")).alias("energy_rms"),
        F.when(F.col("event_type") != "click", F.col("level") / 4.0).alias("vad_confidence"),
        F.when(F.col("event_type") != "view", F.array_repeat("x", F.when(F.col("level") == 1, 63).otherwise(64))).alias("spectral"))
    return joins.join_audio_positional(frames, audio).select("session_id", "frame_idx", "energy", "prob", "spectral")


@query("get_sample", """SELECT label AS session_id, vec_id AS frame_idx, CAST(embedding[18] AS DOUBLE) AS jaw, 52 AS channels FROM embeddings WHERE (label, vec_id) IN (SELECT (label, min(vec_id)) FROM embeddings GROUP BY label)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("session_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("bs"))
    wanted = rows.groupBy("session_id").agg(F.min("frame_idx").alias("frame_idx"))
    out = filters.get_sample(rows, wanted, CHANNELS, ["bs"])
    return out.select("session_id", "frame_idx", F.col("bs")["jawOpen"].cast("double").alias("jaw"), F.size("bs").alias("channels"))
