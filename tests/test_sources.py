"""Readers and writers: round trips, archives, damaged files, feeds, exports."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS
from kinetable.functions import tables
from kinetable.plans import training
from kinetable.sources import exports, feeds, sessions


def arrays(n, seed=0, roles="SPEAKER"):
    rng = np.random.default_rng(seed)
    return {
        "timestamps": (np.arange(n) / 30.0).astype(np.float32), "face_ids": np.zeros(n, np.int32), "is_primary": np.ones(n, bool), "bboxes": np.tile([1, 2, 3, 4], (n, 1)).astype(np.int32),
        "clean_landmarks": rng.normal(size=(n, 478, 3)).astype(np.float32), "blendshape_names": np.array(sorted(CHANNELS)), "clean_blendshapes": rng.random((n, 52)).astype(np.float32),
        "clean_pose_euler": rng.normal(size=(n, 3)).astype(np.float32), "eligibility_levels": np.full(n, 4, np.int32), "roles": np.array([roles] * n),
    }


def packed(values):
    data = io.BytesIO()
    np.savez_compressed(data, **values)
    return data.getvalue()


@pytest.fixture
def folder(tmp_path):
    for i, n in enumerate([1, 40, 30]):
        place = tmp_path / f"session_{i}"
        place.mkdir()
        (place / "face_motion.npz").write_bytes(packed(arrays(n, i)))
        (place / "metadata.json").write_text(json.dumps({"session_id": f"session_{i}", "created_at": "2026-01-02 03:04:05", "total_video_frames": n, "duration_seconds": n / 30, "role_counts": {"SPEAKER": n}, "hardware_telemetry": {"source_url": "u", "fps": 29.5}}, indent=2))
        (place / "audio_features.json").write_text(json.dumps([{"timestamp": j / 30, "energy_rms": 0.1, "vad_confidence": 0.5} for j in range(n - 1)], indent=1))
    bad = tmp_path / "session_bad"
    bad.mkdir()
    (bad / "face_motion.npz").write_bytes(b"not an archive")
    return tmp_path


def test_round_trip_and_damage(spark, folder):
    rows = sessions.read_sessions(spark, str(folder)).cache()
    good = sessions.good_rows(rows)
    assert good.groupBy("session_id").count().orderBy("session_id").collect() == [("session_0", 1), ("session_1", 40), ("session_2", 30)]
    assert [r.session_id for r in sessions.corrupt_files(rows).collect()] == ["session_bad"]
    first = good.filter("session_id = 'session_1' and frame_idx = 7").first()
    want = arrays(40, 1)
    assert first.t == pytest.approx(7 / 30) and list(first.bbox) == [1, 2, 3, 4] and first.role == "SPEAKER"
    np.testing.assert_array_equal(np.float32(first.clean_landmarks), want["clean_landmarks"][7].reshape(-1))
    assert first.channel_names == sorted(CHANNELS) and first.raw_landmarks is None
    lean = sessions.read_sessions(spark, str(folder), ["t", "role"])
    assert lean.columns == ["session_id", "frame_idx", "t", "role", "corrupt"]


def test_metadata_audio_and_sizes(spark, folder):
    meta = sessions.read_metadata(spark, str(folder)).orderBy("session_id").collect()
    assert [m.total_video_frames for m in meta] == [1, 40, 30] and meta[0].telemetry["fps"] == "29.5" and meta[0].created_at.year == 2026
    audio = sessions.read_audio(spark, str(folder))
    assert audio.filter("session_id = 'session_1'").agg(F.max("slice_idx")).first()[0] == 38
    assert sessions.session_sizes(spark, str(folder)).filter("session_id = 'session_bad'").first().size_bytes == 14


def test_archives(spark, folder, tmp_path_factory):
    place = tmp_path_factory.mktemp("chunks")
    with tarfile.open(place / "dataset_chunk_w_1.tar.gz", "w:gz") as tar:
        for i in (1, 2):
            tar.add(folder / f"session_{i}", arcname=f"session_{i}")
        tar.add(folder / "session_0" / "face_motion.npz", arcname="face_motion.npz")
    (place / "tiny.tar.gz").write_bytes(b"x" * 50)
    (place / "broken.tar.gz").write_bytes(b"x" * 500)
    rows = sessions.read_chunks(spark, str(place)).cache()
    counts = {r.session_id: r["count"] for r in sessions.good_rows(rows).groupBy("session_id").count().collect()}
    assert counts == {"session_1": 40, "session_2": 30, "default_session": 1}
    damaged = ["broken.tar.gz", "tiny.tar.gz"]
    assert sorted(r.session_id.rsplit("/", 1)[1] for r in sessions.corrupt_files(rows).collect()) == damaged
    audio = sessions.read_chunk_audio(spark, str(place)).cache()
    assert sessions.good_rows(audio).count() == 39 + 29
    assert sorted(r.session_id.rsplit("/", 1)[1] for r in sessions.corrupt_files(audio).collect()) == damaged
    rows.unpersist(), audio.unpersist()  # a cached plan of the same path would be used again
    with tarfile.open(place / "half.tar.gz", "w:gz") as tar:
        for i in (1, 2):
            tar.add(folder / f"session_{i}", arcname=f"session_{i}")
    data = (place / "half.tar.gz").read_bytes()
    (place / "half.tar.gz").write_bytes(data[: len(data) * 3 // 4])
    for reader in (sessions.read_chunks, sessions.read_chunk_audio):
        assert "half.tar.gz" in {r.session_id.rsplit("/", 1)[1] for r in sessions.corrupt_files(reader(spark, str(place))).collect()}


def test_archives_from_sql(spark, folder, tmp_path_factory):
    place = tmp_path_factory.mktemp("sql")
    with tarfile.open(place / "one.tar.gz", "w:gz") as tar:
        for i in (1, 2):
            tar.add(folder / f"session_{i}", arcname=f"session_{i}")
    (place / "broken.tar.gz").write_bytes(b"x" * 500)
    tables.register(spark)
    archives = spark.read.format("binaryFile").load(str(place))
    rows = spark.sql("SELECT c.* FROM {archives} a, LATERAL read_chunks(a.path, a.content) c", archives=archives)
    columns = ["session_id", "frame_idx", *tables.CHUNK_COLUMNS, "corrupt"]
    want = sessions.read_chunks(spark, str(place), list(tables.CHUNK_COLUMNS))
    assert rows.count() == 71 and sorted(map(str, rows.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    got = spark.sql("SELECT * FROM sequence_windows(100, 64, 16)").collect()
    assert [tuple(r) for r in got] == [(0, 0, 63), (1, 16, 79)]
    assert spark.sql("SELECT * FROM sequence_windows(3, 64, 16)").collect() == [(0, 0, 2)] and not spark.sql("SELECT * FROM sequence_windows(0, 64, 16)").collect()


def test_unused_arrays_and_bad_audio_are_reported(spark, folder):
    (folder / "session_1" / "face_motion.npz").write_bytes(packed({**arrays(40), "roles": np.array(["SPEAKER"] * 5)}))
    for name, text in (("session_1", "{broken"), ("session_2", "{}"), ("session_bad", "[]")):
        (folder / name / "audio_features.json").write_text(text)
    rows = sessions.read_sessions(spark, str(folder), ["t", "role"]).filter("session_id = 'session_1'").cache()
    assert [r.corrupt for r in sessions.corrupt_files(rows).collect()] == ["role: 5 values for 40 frames"]
    assert sessions.good_rows(rows).count() == 40 and sessions.good_rows(rows).filter("role is not null").count() == 0
    audio = sessions.read_audio(spark, str(folder))
    assert sorted(r.session_id for r in sessions.corrupt_files(audio).collect()) == ["session_1", "session_2"]
    assert sessions.good_rows(audio).count() == 0


def test_audio_is_chosen_session_by_session(spark):
    """One session has stored spectra, one only separate audio, one none."""
    schema = "session_id string, frame_idx long, t double, role string, channels array<double>, pose array<double>, spectral array<float>, energy double, prob double"
    rows = [(s, i, i / 30, "SPEAKER", [0.1] * 52, [0.0] * 3, [0.5] * 64 if s == "a" else None, 0.3 if s == "a" else None, 0.4 if s == "a" else None) for s in "abc" for i in range(12)]
    audio = spark.createDataFrame([("b", i, i / 30, 0.2, None, 0.6, [0.25] * 64) for i in range(12)], "session_id string, slice_idx long, t double, energy_rms double, is_speech boolean, vad_confidence double, spectral array<float>")
    built = training.build_training(spark.createDataFrame(rows, schema), audio, names=sorted(CHANNELS))
    assert built.count() == 36
    got = {r.session_id: r for r in built.filter("frame_idx = 4").collect()}
    assert got["a"].spectral[0] == 0.5 and got["a"].energy == 0.3 and got["b"].spectral[0] == 0.25 and got["b"].energy == pytest.approx(0.2)
    assert got["c"].energy == 0.0 and set(got["c"].spectral) == {0.0}


def test_training_from_folders(spark, folder, tmp_path_factory):
    rows = sessions.good_rows(sessions.read_sessions(spark, str(folder)))
    frames = rows.select("session_id", "frame_idx", "t", "role", F.col("clean_channels").alias("channels"), F.col("clean_euler").alias("pose"), F.col("clean_landmarks").alias("landmarks"))
    audio = sessions.read_audio(spark, str(folder))
    built = training.build_training(frames, audio, lean=False, names=sorted(CHANNELS))
    place = str(tmp_path_factory.mktemp("out") / "training")
    exports.write_training(built, place)
    assert exports.read_training(spark, place).count() == 70
    assert exports.read_training(spark, place, "val").count() == 10 and exports.read_training(spark, place, "train").count() == 60
    plan = exports.read_training(spark, place, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "is_train" in plan.split("PartitionFilters: [")[1].split("]")[0]
    row = exports.read_training(spark, place).filter("session_id = 'session_1' and frame_idx = 39").first()
    assert row.energy == 0.0 and row.prob == 1.0  # one audio row is missing
    other = exports.read_training(spark, place).filter("session_id = 'session_1' and frame_idx = 3").first()
    assert other.energy == pytest.approx(0.1) and other.spectral[:9] == pytest.approx([0.08] * 8 + [0.1])
    stats = training.feature_stats(exports.read_training(spark, place))
    assert {r.feature: r["count"] for r in stats.groupBy("feature").count().collect()} == {"dental": 4, "pose_delta": 3, "channels": 52, "canonical": 1434, "deltas": 1434}
    exports.write_stats(stats, place + "-stats")
    assert spark.read.json(place + "-stats").count() == 2927


def test_frame_writer_and_jsonl(spark, tmp_path):
    data = spark.range(250).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") % 5).cast("int").alias("level"))
    assert exports.export_jsonl(data, str(tmp_path / "lines")) == 100
    assert spark.read.json(str(tmp_path / "lines")).filter("level < 3").count() == 0
    exports.write_frames(data, str(tmp_path / "by"), slice_rows=50)
    exports.write_frames(data, str(tmp_path / "clustered"), by_session=False)
    assert spark.read.parquet(str(tmp_path / "by")).filter("session_id = 1").count() == 83
    assert spark.read.parquet(str(tmp_path / "clustered")).count() == 250


def test_animation_files(spark, tmp_path):
    data = spark.createDataFrame([(i, [0.123456] * 52, [0.1] * 52) for i in range(3)], "frame long, pred_bs array<double>, target_bs array<double>")
    exports.export_animation_csv(data, str(tmp_path / "csv"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "csv")).orderBy("time_sec").collect()
    assert [r.time_sec for r in rows] == ["0.0", "0.0333", "0.0667"] and rows[0].jawOpen == "0.12346"
    accuracy = spark.createDataFrame([(0.02, 0.9)], "mae double, corr_jaw double")
    exports.export_animation_json(data, accuracy, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/frames")).filter("blendshapes.jawOpen > 0.12").count() == 3
    assert spark.read.json(str(tmp_path / "json/metadata")).first().total_frames == 3


def test_url_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# Title: One\n\n  https://a.example/1\n// note\nhttps://a.example/2\n# comment\n# title: Old\n# Title: Three\nhttps://a.example/3\n")
    out = feeds.read_url_list(spark, str(tmp_path)).orderBy("block", "line").collect()
    assert [(r.url, r.title) for r in out] == [("https://a.example/1", "One"), ("https://a.example/2", None), ("https://a.example/3", "Three")]
