"""Catalogue work: queue, registry, completions, locks, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions import text
from kinetable.operators.ordered import key_positions

DONE = ("completed", "already_recorded")


def histogram(df: DataFrame, column: str, domain, key=("session_id",), prefix: str = "n_") -> DataFrame:
    """Counts per key for every value of ``domain``, zero where it never occurs."""
    counts = [F.count_if(F.col(column) == v).alias(f"{prefix}{v}".lower()) for v in domain]
    return df.groupBy(*key).agg(*counts)


def session_summary(frames: DataFrame, audio: DataFrame, unit: float = 1.0, key: str = "session_id", t: str = "t",
                    frame: str = "frame_idx") -> DataFrame:
    """One row per session: extent, counts, face ids, last primary face, capture rate."""
    per = frames.groupBy(key).agg(
        ((F.max(t) - F.min(t)) / F.lit(unit)).alias("_s"),
        F.count(F.lit(1)).alias("total_video_frames"),
        F.sort_array(F.collect_set("face_id")).alias("tracked_face_ids"),
        F.max_by(F.when(F.col("is_primary"), F.col("face_id")), F.when(F.col("is_primary"), F.struct(t, frame))).alias("primary_face_id"),
    )
    heard = audio.groupBy(key).agg(F.count(F.lit(1)).alias("total_audio_frames"))
    return per.join(heard, key, "left").select(
        key,
        F.bround(F.greatest(F.lit(0.0), F.col("_s")), 3).alias("duration_seconds"),
        "total_video_frames",
        F.coalesce("total_audio_frames", F.lit(0)).alias("total_audio_frames"),
        "tracked_face_ids",
        "primary_face_id",
        F.bround(F.when(F.col("_s") > 0, (F.col("total_video_frames") - 1) / F.col("_s")).otherwise(F.lit(0.0)), 1).alias("average_capture_fps"),
    )


BYTES_PER_FRAME = 15_500


def readiness(sessions: DataFrame, live_frames: int = 0, live_speech_s: float = 0.0, live_pause_s: float = 0.0) -> DataFrame:
    """Totals over all sessions plus a live increment, as one row.

    Reads ``size_bytes``, ``total_video_frames`` (null: no metadata, estimated from
    size), ``duration_seconds``, ``speaker_count`` (null: all frames), ``pause_count``.
    """
    known = F.col("total_video_frames").isNotNull()
    guessed = F.greatest(F.lit(1), F.floor(F.col("size_bytes") / BYTES_PER_FRAME))
    frames = F.when(known, F.col("total_video_frames")).otherwise(guessed)
    duration = F.when(known, F.coalesce("duration_seconds", F.lit(0.0))).otherwise(guessed / 30.0)
    speaker = F.coalesce("speaker_count", "total_video_frames")
    pause = F.coalesce("pause_count", F.lit(0))
    labelled = F.greatest(F.lit(1), speaker + pause)

    def total(value, live):
        return F.coalesce(F.sum(value), F.lit(0)) + F.lit(live)

    return sessions.agg(
        total(F.when(F.col("size_bytes") > 0, 1).otherwise(0), int(live_frames > 0)).alias("total_sessions"),
        total(frames, live_frames).alias("total_frames"),
        total(duration, live_speech_s + live_pause_s).alias("total_duration_seconds"),
        total(F.col("size_bytes"), live_frames * BYTES_PER_FRAME).alias("total_size_bytes"),
        total(F.when(known, duration * (speaker / labelled)), live_speech_s).alias("speech_seconds"),
        total(F.when(known, duration * (pause / labelled)), live_pause_s).alias("pause_seconds"),
    )


# Milestone targets in seconds and storage estimates in GB.
TARGETS = {"baseline": 1800.0, "hifi": 7200.0, "phase1": 360000.0, "scale": 3600000.0}
GB_100H, GB_1000H = 47.9, 479.1


def milestones(report: DataFrame) -> DataFrame:
    """Progress, ready flags and the label of a :func:`readiness` row."""
    seconds = F.col("total_duration_seconds")
    hours = seconds / 3600.0
    percent = {n: F.least(F.lit(100.0), seconds / s * 100.0) for n, s in TARGETS.items()}
    ready = {n: seconds >= s for n, s in TARGETS.items()}
    # Label texts.
    label = (
        F.when(ready["scale"], F.format_string("READY: 1,000h SCALE DATASET COMPLETE (%.1fh)", F.bround(hours, 1)))
        .when(ready["phase1"], F.format_string("PHASE 1 COMPLETE (%.1fh / 100h) - ADVANCING TO 1,000h TARGET", F.bround(hours, 1)))
        .otherwise(
            F.format_string(
                "PHASE 1 (100h TARGET): %.2fh / 100.0h (%.1f%%) | %.1fh TO GO",
                F.bround(hours, 2), F.bround(percent["phase1"], 1), F.bround(F.greatest(F.lit(0.0), 100.0 - hours), 1),
            )
        )
    )
    return report.select(
        "*",
        *[p.alias(f"{n}_pct") for n, p in percent.items()],
        *[r.alias(f"is_{n}_ready") for n, r in ready.items()],
        F.lit(GB_100H).alias("estimated_gb_100h"),
        F.lit(GB_1000H).alias("estimated_gb_1000h"),
        label.alias("readiness_label"),
    )


def queue_summary(queue: DataFrame, report: DataFrame, mb_per_hour: float = 490.6) -> DataFrame:
    """Queue counts by status next to the dataset totals (two one-row tables)."""
    status = F.col("status")
    counts = queue.agg(
        F.count(F.lit(1)).alias("queue_total"),
        F.count_if(status.isin(*DONE)).alias("queue_completed"),
        *[F.count_if(status == s).alias(f"queue_{s}") for s in ("pending", "in_progress", "failed")],
    )
    hours = F.col("total_duration_seconds") / 3600.0
    return counts.crossJoin(F.broadcast(report)).select(
        *counts.columns,
        F.col("total_sessions").alias("dataset_sessions"),
        F.col("total_frames").alias("dataset_frames"),
        F.bround(hours, 2).alias("dataset_hours"),
        F.bround(F.col("speech_seconds") / 3600.0, 2).alias("speech_hours"),
        F.bround(F.col("total_size_bytes") / float(1024**3), 2).alias("gb_used"),
        F.bround(F.least(F.lit(100.0), hours), 2).alias("phase1_pct"),
        F.bround(F.greatest(F.lit(0.0), 100.0 - hours), 2).alias("phase1_remaining_hours"),
        F.bround(F.least(F.lit(100.0), hours / 1000.0 * 100.0), 2).alias("scale_pct"),
        F.lit(round(mb_per_hour * 100.0 / 1024.0, 1)).alias("estimated_gb_100h"),
        F.lit(round(mb_per_hour * 1000.0 / 1024.0, 1)).alias("estimated_gb_1000h"),
    )


def build_registry(recordings: DataFrame, order: list[str]) -> DataFrame:
    """One row per source from its recordings, ordered by the columns ``order``.

    The sessions of a source are rows of :func:`registry_sessions`, not an array, so a
    source with very many recordings stays a plain partial aggregate.
    """
    rows = recordings.withColumn("key", text.url_key(F.col("url")))
    named = F.col("title").isNotNull() & (F.col("title") != "") & (F.col("title") != "YouTube Video")
    graded = F.col("quality").isNotNull() & (F.col("quality") != "")
    # First per (source, session), which spreads a hot source, then per source.
    per = rows.groupBy("key", "session_id").agg(
        F.min(F.struct(*order, "url", "title")).alias("_first"),
        F.max(F.when(graded, F.struct(*order, "quality"))).alias("_quality"),
        F.max(F.when(named, F.struct(*order, "title"))).alias("_title"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("frame_count").alias("_frames"),
        F.sum("duration_seconds").alias("_seconds"),
        F.max(order[0]).alias("_last"),
    )
    seen = F.struct(F.struct(*[F.col("_first")[c] for c in order]).alias("at"), "session_id")
    out = per.groupBy("key").agg(
        F.min("_first").alias("_first"),
        F.max("_quality").alias("_quality"),
        F.max("_title").alias("_title"),
        F.sum("_n").alias("recorded_count"),
        F.sum("_frames").alias("total_frames"),
        F.bround(F.sum("_seconds"), 2).alias("total_duration_seconds"),
        F.max("_last").alias("last_recorded_at"),
        F.count("session_id").alias("session_count"),
        F.max(F.when(F.col("session_id").isNotNull(), seen))["session_id"].alias("last_session"),
    )
    return out.select(
        "key",
        F.coalesce(text.extract_video_id(F.col("_first.url")), F.lit("N/A")).alias("video_id"),
        text.canonical_url(F.col("_first.url")).alias("canonical_url"),
        text.strip(F.col("_first.url")).alias("raw_url"),
        F.coalesce("_title.title", F.nullif(F.col("_first.title"), F.lit("")), F.lit("Stream Video")).alias("title"),
        F.coalesce("_quality.quality", F.lit("480p")).alias("quality"),
        F.col("_first")[order[0]].alias("first_recorded_at"), "last_recorded_at", "recorded_count", "session_count", "last_session",
        "total_frames", "total_duration_seconds",
    )


def registry_sessions(recordings: DataFrame, order: list[str]) -> DataFrame:
    """Distinct sessions of each source in first-seen order (``ordinal`` from 0)."""
    rows = recordings.filter(F.col("session_id").isNotNull()).withColumn("key", text.url_key(F.col("url")))
    seen = rows.groupBy("key", "session_id").agg(F.min(F.struct(*order)).alias("first_seen"))
    return key_positions(seen, ["key"], ["first_seen", "session_id"], "ordinal").select("key", "session_id", "ordinal")


def registry_totals(registry: DataFrame) -> DataFrame:
    seconds = F.coalesce(F.sum("total_duration_seconds"), F.lit(0.0))
    return registry.agg(
        F.count(F.lit(1)).alias("videos"),
        F.coalesce(F.sum("session_count"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("total_frames"), F.lit(0)).alias("frames"),
        F.bround(seconds / 60.0, 1).alias("minutes"),
        F.bround(seconds / 3600.0, 2).alias("hours"),
        F.bround(F.least(F.lit(100.0), seconds / 360000.0 * 100.0), 2).alias("phase1_pct"),
    )


def registry_rows(registry: DataFrame) -> DataFrame:
    """Text cells of the catalogue listing."""
    seconds = F.col("total_duration_seconds").cast("double")
    video = F.col("video_id") != "N/A"
    return registry.select(
        "key",
        F.replace("title", F.lit("|"), F.lit("-")).alias("title"),
        F.when(video, F.concat(F.lit("["), "video_id", F.lit("]("), "canonical_url", F.lit(")")))
        .otherwise(F.concat(F.lit("[Link]("), "canonical_url", F.lit(")"))).alias("link"),
        F.when(
            F.col("session_count") > 0,
            F.format_string("`%d` sess (`%s..`)", "session_count", F.substring(F.col("last_session").cast("string"), 1, 18)),
        ).otherwise(F.format_string("`%d` sess", "session_count")).alias("sessions"),
        F.format_number("total_frames", 0).alias("frames"),
        F.format_string("%.1fm (%.0fs)", F.bround(seconds / 60.0, 1), F.bround(seconds, 0)).alias("duration"),
    )


def backfill_recordings(sessions: DataFrame) -> DataFrame:
    """Recordings found in session metadata: the URL from telemetry, else from the description."""
    described = F.lower(F.coalesce("source_description", F.lit("")))
    mentions = described.contains("stream") | described.contains("youtube") | described.contains("youtu.be")
    given = F.nullif(F.col("telemetry")["source_url"], F.lit(""))
    url = F.coalesce(given, F.when(mentions, text.url_in_text(F.col("source_description"))))
    return sessions.select(
        url.alias("url"),
        F.coalesce(F.nullif(F.col("telemetry")["video_title"], F.lit("")), F.lit("Recorded Stream Video")).alias("title"),
        F.coalesce(F.nullif(F.col("telemetry")["quality"], F.lit("")), F.lit("480p")).alias("quality"),
        "session_id",
        F.coalesce("total_video_frames", F.lit(0)).alias("frame_count"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
    ).filter(F.col("url").isNotNull())


def lookup_registry(urls: DataFrame, registry: DataFrame, url: str = "url", order: str = "pos") -> DataFrame:
    """Best registry entry of each URL: by id, by equal URL, by id inside a stored URL.

    The "inside" tier cuts every stored URL into its 11-character id-like pieces, so
    all three tiers are equi-joins.  Adds ``registry_key`` and ``tier``.
    """
    asked = urls.select(url).distinct().select(
        F.col(url), text.extract_video_id(F.col(url)).alias("_id"), text.canonical_url(F.col(url)).alias("_canon"),
        text.strip(F.col(url)).alias("_raw"),
    )
    stored = registry.select(F.col("key").alias("_key"), F.col(order).alias("_pos"), "canonical_url", "raw_url")
    forms = F.array(F.col("canonical_url"), F.col("raw_url"))

    def pieces(s):
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - 10, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(s, i, F.lit(11)))

    parts = F.filter(F.array_distinct(F.flatten(F.transform(forms, pieces))), lambda p: p.rlike(text.BARE_ID))
    probe = asked.select(
        url,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("tier"), F.col("_id").alias("token")),
                F.struct(F.lit(2).alias("tier"), F.concat(F.lit("c:"), "_canon").alias("token")),
                F.struct(F.lit(2).alias("tier"), F.concat(F.lit("r:"), "_raw").alias("token")),
                F.struct(F.lit(3).alias("tier"), F.col("_id").alias("token")),
            )
        ).alias("p"),
    ).select(url, "p.*").filter(F.col("token").isNotNull())
    target = stored.select(
        "_key", "_pos",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit(1).alias("tier"), F.col("_key").alias("token")),
                    F.struct(F.lit(2).alias("tier"), F.concat(F.lit("c:"), "canonical_url").alias("token")),
                    F.struct(F.lit(2).alias("tier"), F.concat(F.lit("r:"), "raw_url").alias("token")),
                ),
                F.transform(parts, lambda p: F.struct(F.lit(3).alias("tier"), p.alias("token"))),
            )
        ).alias("p"),
    ).select("_key", "_pos", "p.*")
    # Only the first entry per token can win, so a popular token joins one row.
    target = target.groupBy("tier", "token").agg(F.min(F.struct("_pos", "_key")).alias("_e"))
    best = probe.join(target, ["tier", "token"]).groupBy(url).agg(F.min(F.struct("tier", "_e")).alias("_b"))
    return urls.join(best, url, "left").select(
        *urls.columns, F.col("_b._e._key").alias("registry_key"), F.col("_b.tier").alias("tier")
    )


def sync_queue(queue: DataFrame, urls: DataFrame, registry: DataFrame, order: str = "pos") -> DataFrame:
    """The queue with the new sources of a URL list appended in list order.

    ``urls`` has (pos, url); ``registry`` also the columns copied to found entries.
    """
    keyed = urls.withColumn("key", text.url_key(F.col("url"))).withColumn("raw", text.strip(F.col("url")))
    first = keyed.groupBy("key").agg(F.min(F.struct(order, "raw")).alias("_f"))
    fresh = first.select("key", F.col("_f")[order].alias("pos"), F.col("_f.raw").alias("raw_url")).join(
        queue.select("key"), "key", "left_anti"
    )
    found = lookup_registry(fresh, registry, "raw_url", order)
    # A key may stand in the registry more than once: its first entry counts.
    entry = registry.groupBy(F.col("key").alias("registry_key")).agg(
        F.min(F.struct(order, "title", "last_session", "total_frames", "total_duration_seconds")).alias("_e")
    ).select(
        "registry_key", F.col("_e.title").alias("_title"), F.col("_e.last_session").alias("_session"),
        F.col("_e.total_frames").alias("_frames"), F.col("_e.total_duration_seconds").alias("_seconds"),
    )
    hit = F.col("registry_key").isNotNull()
    added = found.join(entry, "registry_key", "left").select(
        "key",
        "pos",
        "raw_url",
        text.canonical_url(F.col("raw_url")).alias("canonical_url"),
        F.coalesce(text.extract_video_id(F.col("raw_url")), F.lit("N/A")).alias("video_id"),
        F.when(hit, F.coalesce("_title", F.lit("Pending Resolution"))).otherwise("Pending Resolution").alias("title"),
        F.when(hit, "already_recorded").otherwise("pending").alias("status"),
        F.when(hit, F.col("_session")).alias("session_id"),
        F.coalesce("_frames", F.lit(0)).cast("long").alias("frame_count"),
        F.coalesce("_seconds", F.lit(0.0)).alias("duration_seconds"),
    )
    # New items follow the existing ones.
    top = queue.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_top"))
    added = added.crossJoin(F.broadcast(top)).withColumn("pos", F.col("pos") + F.col("_top")).drop("_top")
    return queue.unionByName(added, allowMissingColumns=True)


def claimable(queue: DataFrame, completed: DataFrame, locks: DataFrame, now: Column, worker: str,
              stale_s: float = 1200.0, min_s: float = 15.0) -> DataFrame:
    """Outcome of claiming each queue key: completed elsewhere, own lock, locked, or claimed."""
    rows = completed.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("tier"), F.col("key").alias("key")),
                F.struct(F.lit(2).alias("tier"), F.col("video_id").alias("key")),
                F.struct(F.lit(2).alias("tier"), F.col("canonical_url").alias("key")),
            )
        ).alias("m"),
        F.struct("pos", F.coalesce("duration_seconds", F.lit(0.0)).alias("d")).alias("c"),
    )
    # The first matching row decides, a match on the key before any other.
    decided = rows.groupBy(F.col("m.key").alias("key")).agg(F.min(F.struct("m.tier", "c")).alias("_done"))
    held = locks.groupBy("key").agg(F.max_by(F.struct("worker_id", "last_heartbeat"), "last_heartbeat").alias("_lock"))
    age = now - F.col("_lock.last_heartbeat")
    outcome = (
        F.when(F.col("_done.c.d") >= min_s, "already_completed")
        .when(F.col("_lock.worker_id") == worker, "reclaimed_own_lock")
        .when(age < stale_s, "locked_by_other")
        .otherwise("claimed")
    )
    return queue.join(decided, "key", "left").join(held, "key", "left").select(
        *queue.columns, outcome.alias("outcome"),
        F.when(outcome == "locked_by_other", F.col("_lock.worker_id")).alias("locked_by"),
    )


def apply_events(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Apply start/complete/fail events; of each field the last event that sets it wins.

    ``events``: key, seq, kind, title, session_id, frame_count, duration_seconds, error_message.
    """
    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, F.col("seq")))

    done, failed = F.col("kind") == "complete", F.col("kind") == "fail"
    titled = (F.col("kind") != "fail") & F.col("title").isNotNull() & ~F.col("title").isin("", "Pending Resolution")
    status = F.when(done, "completed").when(failed, "failed").otherwise("in_progress")
    news = events.groupBy("key").agg(
        F.max_by(status, "seq").alias("_status"),
        last(F.struct("session_id", "frame_count", F.bround("duration_seconds", 2).alias("duration_seconds")), done).alias("_done"),
        last(F.col("error_message"), failed).alias("_error"),
        last(F.col("title"), titled).alias("_title"),
    )
    out = queue.join(news, "key", "left")
    took = F.col("_done").isNotNull()
    changed = {
        "status": F.coalesce("_status", "status"),
        "title": F.coalesce("_title", "title"),
        "session_id": F.when(took, F.col("_done.session_id")).otherwise(F.col("session_id")),
        "frame_count": F.when(took, F.col("_done.frame_count")).otherwise(F.col("frame_count")),
        "duration_seconds": F.when(took, F.col("_done.duration_seconds")).otherwise(F.col("duration_seconds")),
        "error_message": F.coalesce("_error", "error_message"),
    }
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def queue_stats(events: DataFrame) -> DataFrame:
    """Totals of the complete events."""
    return events.filter(F.col("kind") == "complete").agg(
        F.count(F.lit(1)).alias("total_completed"),
        F.coalesce(F.sum("frame_count"), F.lit(0)).alias("total_frames"),
        F.bround(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 2).alias("total_duration_sec"),
    )


def stale_locks(locks: DataFrame, now: Column, worker: str, stale_s: float = 1200.0) -> DataFrame:
    """Locks that are too old, or left by this worker; one without a heartbeat counts as beating at 0."""
    old = now - F.coalesce("last_heartbeat", F.lit(0.0)) > stale_s
    return locks.filter(old | F.coalesce(F.col("worker_id").startswith(worker), F.lit(False)))


def completed_totals(completed: DataFrame) -> DataFrame:
    return completed.agg(
        F.count(F.lit(1)).alias("total_completed"),
        F.bround(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600.0, 3).alias("total_hours"),
    )


def next_pending(queue: DataFrame, exclude: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """The pending item that comes first, outside a set of keys."""
    rows = queue.filter(F.col("status") == "pending")
    if exclude is not None:
        rows = rows.join(exclude.select("key"), "key", "left_anti")
    return rows.orderBy(order).limit(1)


def latest_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` last rows by ``order`` (a distributed top-n)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def speed_factor(content_s: Column, wall_s: Column) -> Column:
    return content_s / F.greatest(F.lit(0.1), wall_s)


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``: a min aggregate, so copies of one key never meet in a sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*[F.col(k).alias("_k_" + k) for k in key]).agg(F.min_by(row, F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.asc(by) if ascending else F.desc(by))


def session_inventory(sessions: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` sessions by name with the totals over all of them."""
    totals = sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.sum("frames").alias("total_frames"))
    shown = sessions.orderBy("session_id").limit(n)
    return shown.crossJoin(F.broadcast(totals)).withColumn("size_mb", text.megabytes(F.col("size_bytes"))).drop("size_bytes")


def top_by_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= n).drop("_r")
