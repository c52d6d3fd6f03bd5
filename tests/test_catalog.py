"""Catalogue scenarios: feeds, claims, registry, milestones, archives, labelling."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.functions import text
from kinetable.operators import catalog, filters, listing, speech, windows
from kinetable.operators.ordered import Timeline

CFG = Config()
ID = "Abc_123-xyZ"
REGISTRY = "pos long, key string, canonical_url string, raw_url string, title string, last_session string, total_frames long, total_duration_seconds double"


def registry(spark):
    return spark.createDataFrame([(0, ID, text.CANONICAL + ID, f"https://youtu.be/{ID}", "Known", "s9", 1800, 60.0)], REGISTRY)


def test_five_spellings_hit_and_one_misses(spark):
    urls = [f"https://www.youtube.com/watch?v={ID}", f"https://youtu.be/{ID}", ID, f"https://www.youtube.com/shorts/{ID}", f"https://www.youtube.com/watch?v={ID}&t=9s", "https://youtu.be/unknown_id1"]
    data = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, url string")
    out = {r.pos: r.registry_key for r in catalog.lookup_registry(data, registry(spark)).collect()}
    assert [out[i] for i in range(6)] == [ID] * 5 + [None]


def test_feed_then_more(spark):
    queue = spark.createDataFrame([], "key string, pos long, raw_url string, canonical_url string, video_id string, title string, status string, session_id string, frame_count long, duration_seconds double")
    urls = spark.createDataFrame([(0, f"  https://youtu.be/{ID} "), (1, "https://youtu.be/newvideo_01"), (2, "https://youtu.be/newvideo_01?t=1")], "pos long, url string")
    first = catalog.sync_queue(queue, urls, registry(spark))
    rows = {r.key: r for r in first.collect()}
    assert rows[ID].status == "already_recorded" and rows[ID].session_id == "s9" and rows[ID].frame_count == 1800
    assert rows["newvideo_01"].status == "pending" and len(rows) == 2
    more = catalog.sync_queue(first, spark.createDataFrame([(0, "newvideo_02"), (1, "newvideo_01")], "pos long, url string"), registry(spark))
    assert more.count() == 3 and catalog.next_pending(more).first().key == "newvideo_01"
    taken = spark.createDataFrame([("newvideo_01",)], "key string")
    assert catalog.next_pending(more, taken).first().key == "newvideo_02"


def test_claims(spark):
    queue = spark.createDataFrame([(k,) for k in ("free", "mine", "theirs", "stale", "done", "short")], "key string")
    done = spark.createDataFrame([(0, "done", "done", "u", 60.0), (1, "short", "short", "u", 5.0)], "pos long, key string, video_id string, canonical_url string, duration_seconds double")
    locks = spark.createDataFrame([("mine", "w1", 1000.0), ("theirs", "w2", 999.0), ("stale", "w2", 900.0)], "key string, worker_id string, last_heartbeat double")
    out = {r.key: r.outcome for r in catalog.claimable(queue, done, locks, F.lit(1000.0), "w1", stale_s=2.0).collect()}
    assert out == {"free": "claimed", "mine": "reclaimed_own_lock", "theirs": "locked_by_other", "stale": "claimed", "done": "already_completed", "short": "claimed"}
    assert {r.key for r in catalog.stale_locks(locks, F.lit(1000.0), "w1", 2.0).collect()} == {"mine", "stale"}


def test_registry_upsert(spark):
    rows = [(f"https://youtu.be/{ID}", "YouTube Video", "", "a", 10, 1.0, 1), (ID, "Talk | one", "720p", "b", 20, 2.0, 2), (ID, "", "", "a", 30, 3.5, 3)]
    rec = spark.createDataFrame(rows, "url string, title string, quality string, session_id string, frame_count long, duration_seconds double, t long")
    row = catalog.build_registry(rec, ["t"]).first()
    assert (row.key, row.title, row.quality, row.recorded_count, row.session_count, row.last_session) == (ID, "Talk | one", "720p", 3, 2, "b")
    assert (row.total_frames, row.total_duration_seconds, row.first_recorded_at, row.last_recorded_at) == (60, 6.5, 1, 3)
    assert [(r.session_id, r.ordinal) for r in catalog.registry_sessions(rec, ["t"]).orderBy("ordinal").collect()] == [("a", 0), ("b", 1)]
    cells = catalog.registry_rows(catalog.build_registry(rec, ["t"])).first()
    assert cells.title == "Talk - one" and cells.duration == "0.1m (6s)"


def test_milestones(spark):
    schema = "size_bytes long, total_video_frames long, duration_seconds double, speaker_count long, pause_count long"
    data = spark.createDataFrame([(31_000, None, None, None, None), (100, 900, 30.0, None, 100), (0, 10, 1.0, 6, 4)], schema)
    row = catalog.milestones(catalog.readiness(data, live_frames=30, live_speech_s=1.0)).first()
    assert (row.total_sessions, row.total_frames) == (3, 2 + 900 + 10 + 30)
    assert row.total_duration_seconds == pytest.approx(2 / 30 + 30 + 1 + 1) and row.speech_seconds == pytest.approx(27.0 + 0.6 + 1.0)
    assert 40 < row.estimated_gb_100h < 55 and 400 < row.estimated_gb_1000h < 550
    assert row.readiness_label.startswith("PHASE 1 (100h TARGET): 0.01h") and not row.is_baseline_ready


def test_empty_audit_is_fully_redundant(spark):
    none = spark.createDataFrame([], "name string, size_bytes long")
    assert listing.audit_report(listing.audit_vaults(none, none)).first().redundancy_pct == 100.0


def test_canonical_names(spark):
    data = spark.createDataFrame([("a.tar.gz", 5), ("a (1).tar.gz", 7), ("b (1).tar.gz", 3), ("b (2).tar.gz", 4)], "name string, size_bytes long")
    out = {r.clean_name: (r.name, r.duplicates, r.duplicate_bytes) for r in listing.canonical_names(data).collect()}
    assert out == {"a.tar.gz": ("a.tar.gz", 1, 7), "b.tar.gz": ("b (1).tar.gz", 1, 4)}


def test_status_events(spark):
    queue = spark.createDataFrame([("k", "pending", "Pending Resolution", None, 0, 0.0, None), ("z", "pending", "T", None, 0, 0.0, None)], "key string, status string, title string, session_id string, frame_count long, duration_seconds double, error_message string")
    events = spark.createDataFrame([("k", 1, "start", "Title", None, None, None, None), ("k", 2, "complete", "Pending Resolution", "s1", 100, 12.345, None), ("k", 3, "fail", None, None, None, None, "boom")], "key string, seq int, kind string, title string, session_id string, frame_count long, duration_seconds double, error_message string")
    out = {r.key: r for r in catalog.apply_events(queue, events).collect()}
    assert (out["k"].status, out["k"].title, out["k"].session_id, out["k"].error_message) == ("failed", "Title", "s1", "boom")
    assert out["z"].status == "pending"


def face_rows(spark, rows):
    return spark.createDataFrame(rows, "session_id int, t double, frame_idx long, n_faces int, articulating boolean, motion_score double, is_valid boolean, hits int, rejected boolean")


def test_between_words(spark):
    rows = [(1, t, i, 1, t <= 0.2, 0.9, True, 9, False) for i, t in enumerate([0.0, 0.1, 0.2, 0.55, 1.2, 3.0])]
    out = speech.speaker_gate(face_rows(spark, rows), CFG).orderBy("frame_idx").collect()
    assert [r.conversational_state for r in out][2:] == ["ACTIVE_SPEECH", "BETWEEN_WORDS", "CONVERSATIONAL_PAUSE", "SILENCE"]
    assert (out[3].role, out[3].level, out[3].gate_active) == ("SPEAKER", 4, True)
    assert (out[5].role, out[5].level, out[5].gate_active) == ("LISTENER", 3, False)


def test_gate_survives_a_frame_with_two_faces(spark):
    rows = [(1, 0.0, 0, 1, True, 0.9, True, 9, False), (1, 0.3, 1, 2, True, 0.8, True, 9, False), (1, 0.3, 2, 2, False, 0.2, True, 3, False), (1, 0.5, 3, 1, False, 0.1, True, 9, False)]
    out = speech.speaker_gate(face_rows(spark, rows), CFG).orderBy("frame_idx").collect()
    assert [(r.role, r.level) for r in out[1:3]] == [("LISTENER", 2), ("LISTENER", 0)]
    assert out[3].conversational_state == "BETWEEN_WORDS" and out[1].conversational_state is None
    kept = speech.speaker_gate(face_rows(spark, rows), CFG, compat=True).orderBy("frame_idx").collect()
    assert kept[1].conversational_state == "ACTIVE_SPEECH"


def test_one_speaker_among_two_faces_when_not_strict(spark):
    rows = [(1, 0.0, 0, 2, True, 0.9, True, 9, False), (1, 0.0, 1, 2, False, 0.1, True, 9, False)]
    out = speech.speaker_gate(face_rows(spark, rows), replace(CFG, strict_single_face=False)).orderBy("frame_idx").collect()
    assert [(r.role, r.level) for r in out] == [("SPEAKER", 4), ("LISTENER", 3)]


def test_primary_face_is_the_large_central_one(spark):
    data = spark.createDataFrame([(1, 0, 0, 0.09, 0.5, 0.5, 2), (1, 0, 1, 0.006, 0.85, 0.5, 2)], "session_id int, frame_idx int, det_idx int, area double, cx double, cy double, hits int")
    assert [r.is_primary for r in windows.primary_face(data).orderBy("det_idx").collect()] == [True, False]


def test_accept_frames_falls_back_to_all(spark):
    data = spark.createDataFrame([(1, "LISTENER"), (1, None), (2, "SPEAKER"), (2, "LISTENER"), (3, "FaceRole.SPEAKER_PAUSE")], "session_id int, role string")
    out = sorted((r.session_id, str(r.role)) for r in filters.accept_frames(data).collect())
    assert out == [(1, "LISTENER"), (1, "None"), (2, "SPEAKER"), (3, "FaceRole.SPEAKER_PAUSE")]
    assert sorted(r.session_id for r in filters.training_frames(data, 2).collect()) == [1, 1]


def test_filter_skips_absent_columns(spark):
    data = spark.createDataFrame([(1,), (5,)], "level int")
    assert filters.filter_frames(data, min_level=3, role="SPEAKER", primary_only=True).count() == 1


def test_round_robin_parts_are_disjoint(spark):
    data = spark.range(50).withColumnRenamed("id", "pos")
    parts = windows.round_robin(data, 7, Timeline((), ("pos",), 4))
    lists = [parts.filter(F.col("part") == i).select("pos") for i in range(7)]
    assert listing.overlap(lists, "pos").count() == 0 and sum(p.count() for p in lists) == 50


def test_a_registry_key_stored_twice_gives_one_queue_row(spark):
    rows = [(4, "kept_vid_01", "Late"), (2, "kept_vid_01", "Early")]
    twice = spark.createDataFrame([(p, k, text.CANONICAL + k, f"https://youtu.be/{k}", title, f"s{p}", p, 1.0) for p, k, title in rows], REGISTRY)
    empty = spark.createDataFrame([], "key string, pos long")
    out = catalog.sync_queue(empty, spark.createDataFrame([(0, "kept_vid_01")], "pos long, url string"), twice).collect()
    assert [(r.key, r.status, r.title, r.frame_count) for r in out] == [("kept_vid_01", "already_recorded", "Early", 2)]
