"""A stream in several micro-batches, continued from its progress, equals the batch run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.functions import vision
from kinetable.operators import folds, speech, windows
from kinetable.operators.ordered import Timeline
from kinetable.streaming import feeds, live

CFG = Config()


def faces(n=90):
    rng = np.random.default_rng(0)
    rows, number = [], 0
    for frame in range(n):
        for session in ("a", "b"):
            count = 2 if session == "b" and 30 <= frame < 45 else 1
            for i in range(count):
                x = 0.3 + 0.4 * i + rng.normal(0, 0.01)
                talking = frame < 25 or frame > 70
                mouth = float(rng.random()) if talking else 0.2
                rows.append((session, frame, frame / 30.0, number, x, 0.5, mouth, [x, 0.5, x + 0.1, 0.4]))
                number += 1
    return pd.DataFrame(rows, columns=["session_id", "frame_idx", "t", "det_idx", "cx", "cy", "mouth", "points"])


def judged(df):
    score = vision.composite_score(F.lit(1.0), F.lit(0.2), F.lit(150.0), F.lit(1.0), F.col("jitter"))
    return df.withColumns({"score": score, "rejected": F.col("jitter") > 1.2})


def parts(spark, data, path, cuts):
    """Write the rows in time order as one file per cut."""
    bounds = [-1.0, *cuts, 1e9]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows = data[(data["t"] > low) & (data["t"] <= high)]
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(f"{path}/{i}")


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    data = faces()
    schema = spark.createDataFrame(data).schema
    source = str(tmp_path / "in")

    def stream():
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)

    early, late = data[data["t"] <= 1.5], data[data["t"] > 1.5]
    parts(spark, early, source + "/x", [0.4, 0.9])
    live.to_table(live.stream_faces(stream(), CFG), str(tmp_path / "run"))
    parts(spark, late, source + "/y", [2.2])
    got = live.to_table(live.stream_faces(stream(), CFG), str(tmp_path / "run"))

    line = Timeline(("session_id",), ("t", "det_idx"), 0.7)
    face_line = Timeline(("session_id", "face_id"), ("t", "det_idx"), 0.7)
    batch = folds.track(spark.createDataFrame(data.drop(columns=["mouth", "points"])), CFG, line).join(spark.createDataFrame(data[["det_idx", "mouth", "points"]]), "det_idx")
    batch = speech.with_face_count(batch)
    flat = F.array(F.col("points")[0], F.col("points")[1], F.lit(0.0), F.col("points")[2], F.col("points")[3], F.lit(0.0))
    batch = windows.jitter(batch.withColumn("lm", flat), CFG, "lm", (0, 1), face_line)
    batch = windows.mouth_window(windows.velocity(batch, CFG, line=face_line), CFG, line=face_line)
    columns = ["det_idx", "face_id", "hits", "n_faces", "jitter", "velocity", "mean_velocity", "mouth_range", "mouth_peak"]
    a = got.select(columns).orderBy("det_idx").toPandas()
    b = batch.select(columns).orderBy("det_idx").toPandas()
    assert len(a) == len(data)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)

    # Second stage: quality, gate, smoothing.
    rows = windows.articulation(judged(got), CFG).select("session_id", "frame_idx", "t", "det_idx", "face_id", "n_faces", "hits", "score", "rejected", "articulating", "motion_score", "points")
    plain = rows.toPandas()
    parts(spark, plain, str(tmp_path / "judged"), [0.8, 1.9])
    second = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "judged"))
    out = live.to_table(live.stream_frames(second, CFG, "points")).orderBy("det_idx").toPandas()

    key = spark.createDataFrame(plain)
    valid = folds.quality_state(key.select("session_id", "face_id", "t", "det_idx", "score", "rejected"), CFG, face_line).select("det_idx", "is_valid")
    smooth = folds.one_euro(key.select("session_id", "face_id", "t", "det_idx", "points"), CFG, ["points"], face_line).select("det_idx", "smooth_points")
    want = speech.speaker_gate(key.join(valid, "det_idx"), CFG, line).join(smooth, "det_idx").orderBy("det_idx").toPandas()
    for c in ("is_valid", "role", "conversational_state", "level", "speaker_probability", "gate_active"):
        assert out[c].tolist() == want[c].tolist(), c
    assert {"SPEAKER", "LISTENER", "SPEAKER_PAUSE"} <= set(out["role"])
    np.testing.assert_allclose(np.stack(out["smooth_points"]), np.stack(want["smooth_points"]), rtol=1e-12)


def test_watch_stream_matches_batch(spark, tmp_path):
    rows = pd.DataFrame({"session_id": "s", "t": np.arange(200) / 30.0, "frame_idx": np.arange(200)})
    rows["usable"] = rows["frame_idx"].between(10, 59)
    rows["keep"] = rows["usable"]
    parts(spark, rows, str(tmp_path), [0.5, 3.0])
    schema = spark.createDataFrame(rows).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = live.to_table(live.stream_watch(stream, CFG)).toPandas()
    batch = windows.watch_sessions(spark.createDataFrame(rows), CFG, F.col("usable"), F.col("keep")).first()
    assert out[out.event == "start"]["t"].tolist() == [batch.start] and out[out.event == "stop"]["t"].tolist() == [batch.stop]
    assert (out.event == "pre_roll").sum() == 20


def test_queue_feed_takes_up_new_files(spark, tmp_path):
    registry = spark.createDataFrame([], "pos long, key string, canonical_url string, raw_url string, title string, last_session string, total_frames long, total_duration_seconds double")
    source, place, progress = tmp_path / "urls", str(tmp_path / "queue"), str(tmp_path / "progress")
    source.mkdir()
    (source / "a.txt").write_text("# list\nhttps://youtu.be/newvideo_01\nnewvideo_02\n")
    for text in (None, "newvideo_02\n// x\nnewvideo_03\n"):
        if text:
            (source / "b.txt").write_text(text)
        feeds.stream_queue(feeds.stream_urls(spark, str(source)), registry, place, progress).awaitTermination()
    keys = sorted(r.key for r in feeds.queue_table(spark, place, feeds.QUEUE_SCHEMA).collect())
    assert keys == ["newvideo_01", "newvideo_02", "newvideo_03"]


@pytest.mark.parametrize("limit", [(None, 5), (2.0, None)])
def test_cap(spark, tmp_path, limit):
    rows = pd.DataFrame({"session_id": "s", "t": np.arange(20) * 1.0, "frame_idx": np.arange(20), "dt": 0.5})
    parts(spark, rows, str(tmp_path), [2.5, 9.0])
    stream = spark.readStream.schema(spark.createDataFrame(rows).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = live.to_table(live.stream_cap(stream, "dt", *limit))
    batch = windows.cap_session(spark.createDataFrame(rows), CFG, F.col("dt"), *limit)
    assert sorted(r.frame_idx for r in out.collect()) == sorted(r.frame_idx for r in batch.collect())


def test_status_adds_up_over_batches(spark, tmp_path):
    rows = pd.DataFrame({"session_id": ["s"] * 6 + ["u"], "t": np.arange(7) * 1.0, "frame_idx": np.arange(7), "dt": 0.5, "conversational_state": ["ACTIVE_SPEECH"] * 4 + ["CONVERSATIONAL_PAUSE"] * 3, "gate_active": True, "n_faces": 1})
    parts(spark, rows, str(tmp_path / "in"), [2.5, 5.5])
    stream = spark.readStream.schema(spark.createDataFrame(rows).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.stream_status(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {r.session_id: r for r in feeds.status_table(spark, str(tmp_path / "out")).collect()}
    assert (got["s"].session_frames, got["s"].speech_seconds, got["s"].pause_seconds, got["s"].conversational_state) == (6, 2.0, 1.0, "CONVERSATIONAL_PAUSE")
    assert got["u"].session_frames == 1 and got["s"].fps == 2.0


def test_a_table_in_many_files_streams_like_one_file(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"session_id": "s", "t": np.arange(20) * 1.0, "frame_idx": np.arange(20), "dt": 0.5}))
    rows.repartition(5).write.parquet(str(tmp_path / "many" / "seen.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "seen.parquet")
    rows.limit(3).write.parquet(str(tmp_path / "many" / "unseen.parquet"))
    kept = [sorted(r.frame_idx for r in live.to_table(live.stream_cap(live.table_stream(spark, str(tmp_path / d), "seen"), "dt", None, 7)).collect()) for d in ("many", "one")]
    assert kept == [list(range(7))] * 2


def step_of(monkeypatch, operator, *given, **named):
    """The step function and the start state that an operator hands to ``keyed``."""
    class Caught(Exception):
        pass

    def keyed(stream, step, order, start, added, **more):
        raise Caught(step, start)

    with monkeypatch.context() as patch, pytest.raises(Caught) as caught:
        patch.setattr(live, "keyed", keyed)
        operator(None, *given, **named)
    return caught.value.args


def test_faces_of_a_frame_that_comes_in_two_parts_keep_their_rows(monkeypatch):
    step, start = step_of(monkeypatch, live.stream_faces, CFG)
    rows = pd.DataFrame({"frame_idx": [1, 2, 1], "t": [0.0, 0.1, 0.2], "cx": [0.1, 0.1, 0.9], "cy": 0.5, "mouth": [0.1, 0.2, 0.9], "points": [[0.1, 0.5], [0.1, 0.5], [0.9, 0.5]]})
    _, out = step(start, rows)
    assert out["mouth_peak"].tolist() == [0.1, 0.2, 0.9] and out["n_faces"].tolist() == [2, 1, 2]
    assert out["face_id"].tolist() == [0, 0, 1]


def test_faces_are_not_cut_out_frame_by_frame(monkeypatch):
    step, start = step_of(monkeypatch, live.stream_faces, CFG)
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *_, **__: pytest.fail("a frame of its own for every frame"))
    rows = faces(5)
    _, out = step(start, rows[rows["session_id"] == "a"].reset_index(drop=True))
    assert out["hits"].tolist() == [1, 2, 3, 4, 5]


def test_rows_of_a_face_are_smoothed_in_one_go(monkeypatch):
    step, start = step_of(monkeypatch, live.stream_frames, CFG, smooth="points")
    calls, plain = [], live.steps.one_euro
    monkeypatch.setattr(live.steps, "one_euro", lambda *given: calls.append(1) or plain(*given))
    rows = pd.DataFrame({"face_id": [0, 1] * 10, "t": np.arange(20) / 30.0, "score": 90.0, "rejected": False, "articulating": True, "n_faces": 2})
    rows["points"] = [np.array([i / 20.0, 0.5]) for i in range(20)]
    memory, out = step(start, rows)
    assert len(calls) == 2 and set(memory["faces"]) == {"0", "1"}
    alone, _ = plain([], rows["t"].to_numpy()[::2], np.stack(rows["points"])[::2], CFG)
    assert memory["faces"]["0"]["euro"] == alone and len(out["smooth_points"].iloc[19]) == 2
