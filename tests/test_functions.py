"""Column functions on hand-made cases and against plain formulas."""

import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetable.anatomy import ANCHORS, CHANNELS, channel_weights, mirror_index
from kinetable.config import Config
from kinetable.functions import audio, text, vision
from kinetable.operators import alignment, catalog, evaluation, features, filters

CFG = Config()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("url, video", [
    ("https://www.youtube.com/watch?v=Abc_123-xyZ", "Abc_123-xyZ"), ("https://youtu.be/Abc_123-xyZ?si=9", "Abc_123-xyZ"), (" Abc_123-xyZ ", "Abc_123-xyZ"),
    ("https://www.youtube.com/shorts/Abc_123-xyZ", "Abc_123-xyZ"), ("https://www.youtube.com/watch?list=x&v=Abc_123-xyZ&t=4s", "Abc_123-xyZ"),
    ("https://www.youtube.com/live/Abc_123-xyZ", "Abc_123-xyZ"), ("https://example.org/clip", None), ("", None),
])
def test_video_id(spark, url, video):
    row = one(spark, id=text.extract_video_id(F.lit(url)), key=text.url_key(F.lit(url)), canonical=text.canonical_url(F.lit(url)))
    assert row.id == video and row.key == (video or url.strip())
    assert row.canonical == (text.CANONICAL + video if video else url.strip())


def test_labels(spark):
    row = one(spark, d=text.fmt_duration(F.lit(125.9)), c=text.fmt_clock(F.lit(61.25)), n=text.chunk_name(F.lit("w1"), F.lit("20260101_000000"), F.lit(7)),
              w=text.chunk_worker(F.lit("dataset_chunk_w1_20260101_000000_0007.tar.gz")))
    assert tuple(row) == ("2m 5s", "01:01.250", "dataset_chunk_w1_20260101_000000_0007.tar.gz", "w1")


def test_no_rejection_for_a_sharp_frontal_face(spark):
    def reason(w=150, h=150, area=150 * 150 / (640 * 480), blur=80.0, pitch=5.0, yaw=5.0, jitter=0.1, conf=1.0):
        return vision.rejection_reason(*[F.lit(v) for v in (w, h, area, blur, pitch, yaw, jitter, conf)], CFG)

    row = one(spark, ok=reason(), small=reason(w=60), blur=reason(blur=30.0), pose=reason(yaw=-51.0), jit=reason(jitter=1.3), conf=reason(conf=0.3), first=reason(w=60, blur=1.0))
    assert row.ok is None
    assert row.small == "face_too_small (60x150px, area 0.073)" and row.first.startswith("face_too_small")
    assert row.blur == "motion_blur (laplacian 30.0 < 35.0)" and row.pose == "extreme_pose (yaw=-51.0, pitch=5.0)"
    assert row.jit == "tracking_jitter (velocity 1.30)" and row.conf == "low_confidence (0.30)"


def test_euler_round_trip(spark):
    m = vision.euler_to_matrix(F.lit(10.0), F.lit(25.0), F.lit(-18.0))
    r = one(spark, m=m).m
    flat = [r[0], r[1], r[2], 1.0, r[3], r[4], r[5], 2.0, r[6], r[7], r[8], 3.0, 0.0, 0.0, 0.0, 1.0]
    e = one(spark, e=vision.matrix_to_euler(F.array(*[F.lit(float(v)) for v in flat]))).e
    assert tuple(e) == (10.0, 25.0, -18.0, 1.0, 2.0, 3.0)


def test_mouth_activation_uses_lip_points(spark):
    lm = [0.0] * (478 * 3)
    lm[152 * 3 + 1], lm[14 * 3 + 1] = 0.5, 0.05  # face height .5, lips .05 apart
    get = vision.channels(F.array(*[F.lit(0.2 if n == "jawOpen" else 0.0) for n in CHANNELS]))
    row = one(spark, a=vision.mouth_activation(get, F.lit(lm)), b=vision.mouth_activation(get))
    assert row.a == pytest.approx(0.2 * 0.6 + 0.1 * 1.4) and row.b == pytest.approx(0.2 * 2.0)


def test_flip_twice_is_identity_and_parts_add_up(spark):
    x = np.random.default_rng(0).normal(size=478 * 3).tolist()
    row = one(spark, twice=vision.flip(vision.flip(F.lit(x), 478), 478), parts=vision.decompose(F.lit(x), 478))
    assert row.twice == x
    np.testing.assert_allclose(np.add(row.parts.symmetric, row.parts.residual), x, atol=1e-15)
    assert mirror_index()[mirror_index()[33]] == 33


def test_channel_weights():
    w = channel_weights()
    assert len(w) == 52 and w[0] == 1.2 and w[1] == 0.5 and w[17] == 4.0 and w[45] == 2.0 and w[51] == 4.0


def test_audio_columns(spark):
    row = one(spark, r=audio.rms(F.lit([0.3, -0.4])), z=audio.zcr(F.lit([1.0, -1.0, 1.0])), e=audio.rms(F.array().cast("array<double>")), m=audio.mel_to_hz(audio.hz_to_mel(F.lit(440.0))),
              d=audio.downmix(F.lit([1.0, 3.0, 5.0, 7.0]), 2), p=audio.peak_normalize(F.lit([0.1, -0.2])))
    assert row.r == pytest.approx(math.sqrt(0.125)) and row.z == 1.0 and row.e == 0.0 and row.m == pytest.approx(440.0)
    assert row.d == [2.0, 6.0] and row.p == [0.5, -1.0]


def plain_log_mel(x):
    """Direct sums, one band and one frequency at a time."""
    n, rate = 512, 16000
    bins = [sum(v * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, v in enumerate(x)) for k in range(0)]
    del bins
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    k, i = np.arange(257)[:, None], np.arange(n)[None, :]
    power = np.abs((np.exp(-2j * math.pi * k * i / n) * (np.asarray(x) * w)).sum(axis=1)) ** 2 / n
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [int((n + 1) * 700 * (10 ** ((mel(60) + (mel(8000) - mel(60)) * j / 65) / 2595) - 1) / rate) for j in range(66)]
    out = []
    for a, b, c in zip(edges, edges[1:], edges[2:]):
        e = sum(power[f] * (f - a) / (b - a) for f in range(a, b)) + sum(power[f] * (c - f) / (c - b) for f in range(b, c) if f < 257)
        out.append(min(1.0, max(0.0, math.log1p(1e4 * e) / 10)))
    return out


def test_log_mel(spark):
    rng = np.random.default_rng(1)
    clips = [rng.normal(0, 0.1, 512), rng.normal(0, 0.1, 700), rng.normal(0, 0.1, 101), np.zeros(0)]
    data = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(clips)], "i int, samples array<double>")
    out = [r.spectral for r in features.log_mel(data).orderBy("i").collect()]
    np.testing.assert_allclose(out[0], plain_log_mel(clips[0]), atol=1e-4)
    np.testing.assert_allclose(out[1], plain_log_mel(clips[1][94:606]), atol=1e-4)
    np.testing.assert_allclose(out[2], plain_log_mel(np.pad(clips[2], (205, 206))), atol=1e-4)
    assert out[3] == [0.0] * 64


def test_log_mel_sequence_windows_are_centred(spark):
    x = np.random.default_rng(2).normal(0, 0.1, 5000)
    clips = spark.createDataFrame([(1, o, x[o : o + 1000].tolist()) for o in range(0, 5000, 1000)], "session_id int, offset long, samples array<double>")
    times = [0.0, 0.1, 0.2, 0.31]
    frames = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "session_id int, frame_idx int, t double")
    out = {r.frame_idx: r.spectral for r in features.log_mel_sequence(frames, clips).collect()}
    padded = np.pad(x / np.abs(x).max(), (256, 512))
    for i, t in enumerate(times):
        np.testing.assert_allclose(out[i], plain_log_mel(padded[round(t * 16000) :][:512]), atol=1e-4)


def face(seed=0):
    rng = np.random.default_rng(seed)
    return alignment.canonical_template() + rng.normal(0, 0.05, (478, 3))


def rotation(p, y, r):
    a, b, c = np.radians([p, y, r])
    rx = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rz = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return rz @ ry @ rx


def test_similarity_fit_recovers_the_motion():
    target = face()[list(ANCHORS)]
    r, s, t = rotation(10, 25, -18), 1.8, np.array([0.3, -0.2, 0.5])
    source = ((target - t) @ r) / s  # target = s * R * source + t
    scale, rot, shift = alignment.fit_similarity(np.stack([source, np.zeros_like(source)]), target)
    assert scale[0] == pytest.approx(s) and scale[1] == 1.0
    np.testing.assert_allclose(rot[0], r, atol=1e-9)
    np.testing.assert_allclose(shift[0], t, atol=1e-9)
    np.testing.assert_array_equal(rot[1], np.eye(3))


def test_normalization_ignores_pose_size_and_place(spark):
    model, base, talk = alignment.FaceModel(), face(1), face(1)
    talk[[13, 14]] += [[0, -0.05, 0], [0, 0.08, 0]]
    rows = []
    for session, (scale, r, shift) in enumerate([(1.0, np.eye(3), 0.0), (0.45, rotation(0, 0, 0), 0.2), (1.8, rotation(10, 25, -18), -0.4)]):
        for i in range(6):
            points = scale * (talk if i == 5 else base) @ r.T + shift
            rows.append((session, i, "SPEAKER" if i == 5 else "LISTENER", points.reshape(-1).tolist()))
    data = spark.createDataFrame(rows, "session_id int, frame_idx int, role string, landmarks array<double>")
    rest = F.col("role") == "LISTENER"
    neutral = alignment.neutral_faces(data, ["session_id"], "landmarks", rest, model)
    out = alignment.normalize_frames(data, neutral, ["session_id"], "landmarks", model).filter("frame_idx = 5").orderBy("session_id").collect()
    first = np.array(out[0].canonical)
    for row in out:
        np.testing.assert_allclose(row.canonical, first, atol=1e-4)
        points = np.array(row.canonical).reshape(-1, 3)
        np.testing.assert_allclose(points[list(ANCHORS)], model.template[list(ANCHORS)], atol=1e-6)
        np.testing.assert_allclose(np.add(row.symmetric, row.asymmetric), row.canonical, atol=1e-6)
    assert np.abs(first.reshape(-1, 3)[14] - model.template[14]).max() > 0.01


def test_split_is_exact_and_stable(spark):
    data = spark.range(1000).select(F.lit("s").alias("session_id"), F.col("id").alias("frame_idx"))
    a = evaluation.split(data, ["session_id", "frame_idx"]).toPandas()
    b = evaluation.split(data.repartition(7), ["session_id", "frame_idx"]).toPandas()
    assert (~a["is_train"]).sum() == 150
    assert set(a[~a.is_train].frame_idx) == set(b[~b.is_train].frame_idx)
    few = evaluation.split(data.limit(3), ["session_id", "frame_idx"])
    assert few.filter("is_train").count() == 3


def test_augment_repeats_itself(spark):
    data = spark.createDataFrame([(i, [[0.5] * 64] * 64) for i in range(6)], "seq long, rows array<array<double>>")
    a, b = (evaluation.augment(data.repartition(k, "seq"), 42, 1).orderBy("seq").toPandas() for k in (1, 3))
    assert a["rows"].map(lambda r: [list(v) for v in r]).tolist() == b["rows"].map(lambda r: [list(v) for v in r]).tolist()
    other = evaluation.augment(data, 42, 2).orderBy("seq").toPandas()
    assert a["rows"].map(lambda r: [list(v) for v in r]).tolist() != other["rows"].map(lambda r: [list(v) for v in r]).tolist()


def test_augment_draws_what_it_should():
    x, ids = np.full((1000, 16, 24), 0.5), np.arange(1000, dtype=np.uint64)
    out = evaluation.perturbed(x, ids, 42, 1)
    assert (evaluation.perturbed(x[5:7], ids[5:7], 42, 1) == out[5:7]).all()  # whatever else is in the batch
    gain = np.median(out, axis=(1, 2)) / 0.5
    assert 0.83 < gain.min() < 0.87 and 1.13 < gain.max() < 1.17
    bands, frames = (out == 0).all(axis=1).sum(axis=1), (out == 0).all(axis=2).sum(axis=1)
    assert set(bands) == {0, 1, 2, 3} and set(frames) == {0, 2}
    assert abs((bands > 0).mean() - 0.4) < 0.05 and abs((frames > 0).mean() - 0.3) < 0.05
    spread = np.array([a[a != 0].std() for a in out])
    assert abs((spread > 0.005).mean() - 0.5) < 0.05 and abs(spread[spread > 0.005].mean() - 0.02) < 0.001


def test_loss_of_a_perfect_prediction_is_zero(spark):
    rows = [(1, t, [0.1] * 52, [0.2] * 4, [1.0] * 3) for t in range(5)]
    data = spark.createDataFrame(rows, "seq_id int, t int, pred_bs array<double>, pred_dental array<double>, pred_pose array<double>")
    data = data.withColumns({f"target_{n}": F.col(f"pred_{n}") for n in ("bs", "dental", "pose")})
    out = evaluation.animation_loss(data).first()
    assert out.total_loss == pytest.approx(0.0, abs=1e-12)


def test_blur_score(spark):
    image = np.random.default_rng(3).integers(0, 255, (20, 30)).astype(float)
    rows = [(image.tolist(), (2, 3, 15, 12)), (image.tolist(), (0, 0, 9, 20)), (np.full((20, 30), 7.0).tolist(), (0, 0, 30, 20))]
    data = spark.createDataFrame(rows, "gray array<array<double>>, bbox struct<x:int,y:int,w:int,h:int>")
    out = [r.blur for r in evaluation.blur_score(data).collect()]
    crop = image[3:15, 2:17]
    at = lambda y, x: crop[abs(y) if y < 12 else 22 - y, abs(x) if x < 15 else 28 - x]
    edges = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(12) for x in range(15)]
    assert out[0] == pytest.approx(np.var(edges)) and out[1] == 0.0 and out[2] == 0.0


def test_slices_keep_their_offsets_over_gaps_and_repeated_frames(spark):
    clips = spark.createDataFrame([("s", 0, [1.0] * 4), ("s", 8, [2.0] * 4), ("s", 2, [9.0] * 3), ("other", 0, [])], "session_id string, offset long, samples array<double>")
    frames = spark.createDataFrame([("s", 1, 0.0), ("s", 1, 0.0), ("s", 2, 0.5), ("none", 3, 0.0)], "session_id string, frame_idx long, t double")
    for block in (3, 100):
        got = features.slice_audio(frames, clips, rate=12, fps=1.0, block=block).collect()
        rows = sorted((r.session_id, r.frame_idx, list(r.samples)) for r in got)
        first = [1.0] * 4 + [9.0] + [0.0] * 3 + [2.0] * 4
        assert rows == [("none", 3, [0.0] * 12), ("s", 1, first), ("s", 1, first), ("s", 2, first[6:] + [0.0] * 6)]


def test_frames_without_a_recording_are_silent(spark):
    frames = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.1)], "session_id string, frame_idx long, t double")
    clips = spark.createDataFrame([("a", 0, [0.5, -0.5] * 4000)], "session_id string, offset long, samples array<double>")
    out = {r.session_id: r.spectral for r in features.log_mel_sequence(frames, clips).collect()}
    assert set(out["b"]) == {0.0} and max(out["a"]) > 0 and len(out["b"]) == 64


def test_samples_with_fewer_values_than_names(spark):
    rows = spark.createDataFrame([("s", 1, [0.1, 0.2]), ("s", 2, [0.1, 0.2, 0.3, 0.4]), ("s", 3, None)], "session_id string, frame_idx long, v array<double>")
    got = {r.frame_idx: r.v for r in filters.get_sample(rows, rows, ["a", "b", "c"], ["v"]).collect()}
    assert got == {1: {"a": 0.1, "b": 0.2}, 2: {"a": 0.1, "b": 0.2, "c": 0.3}, 3: None}


def test_locks_without_heartbeat_are_stale(spark):
    locks = spark.createDataFrame([("k", "w1", None), ("l", "w2", 990.0), ("m", "me-1", 999.0), ("n", None, 999.0)], "key string, worker_id string, last_heartbeat double")
    assert {r.key for r in catalog.stale_locks(locks, F.lit(1000.0), "me", 100.0).collect()} == {"k", "m"}


def test_split_counts_are_exact(spark):
    rows = spark.range(3_000).select((F.col("id") % 7).alias("s"), "id")
    for ratio in (0.0, 0.15, 1.0):
        out = evaluation.split(rows, ["s", "id"], ratio)
        assert out.filter(~F.col("is_train")).count() == int(3_000 * ratio) and out.count() == 3_000
    assert evaluation.split(rows.limit(0), ["s", "id"]).count() == 0


def test_frame_rms_of_pieces_equals_that_of_the_whole(spark):
    x = np.random.default_rng(3).normal(0, 0.2, 103).tolist()
    whole = spark.createDataFrame([("s", x)], "session_id string, samples array<double>")
    pieces = spark.createDataFrame([("s", o, x[o : o + 23]) for o in range(0, 103, 23)], "session_id string, offset long, samples array<double>")
    a, b = ({r.frame: r.rms for r in features.frame_rms(d, 10).collect()} for d in (whole, pieces))
    assert set(a) == set(b) == set(range(10)) and max(a.values()) == 1.0
    assert all(a[i] == pytest.approx(b[i], rel=1e-12) for i in a)


def test_pieces_that_overlap_give_the_same_samples_for_any_block(spark):
    clips = spark.createDataFrame([("s", 0, [9.0] * 10), ("s", 5, [2.0] * 10)], "session_id string, offset long, samples array<double>")
    frames = spark.createDataFrame([("s", 1, 0.0)], "session_id string, frame_idx long, t double")
    for block in ({}, {"block": 4}, {"block": 100}):
        got = features.slice_audio(frames, clips, rate=16, fps=1.0, **block).first()
        assert list(got.samples) == [9.0] * 10 + [2.0] * 5 + [0.0]

def test_augment_perturbs_few_sequences_at_once(monkeypatch):
    sizes, whole = [], evaluation.perturbed
    monkeypatch.setattr(evaluation, "perturbed", lambda x, *rest: sizes.append(len(x)) or whole(x, *rest))
    x = np.random.default_rng(4).random((1000, 4, 8))
    batch = pa.RecordBatch.from_pydict({"seq": list(range(1000)), "rows": x.tolist()})
    out = [r for b in evaluation.perturbed_batches(iter([batch]), 42, 1, "rows", "seq") for r in b.column("rows").to_pylist()]
    assert (np.array(out) == whole(x, np.arange(1000, dtype=np.uint64), 42, 1)).all() and max(sizes) <= 64


def test_a_rate_without_bands_is_an_error():
    assert features.mel_filterbank(16000).any(axis=1).sum() > 50
    for rate in (16, 120):
        with pytest.raises(ValueError):
            features.mel_filterbank(rate)


def test_log_mel_sequence_query_hears_its_samples(spark):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = {r.frame_idx: r.spectral for r in entry.queries()["log_mel_sequence"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values(["label", "vec_id"])
    assert len(got) == len(rows)
    for _, mine in list(rows.groupby("label"))[:2]:
        x = np.concatenate(mine["embedding"].tolist()).astype(float)
        padded = np.pad(x / np.abs(x).max(), (256, 5 * len(mine) + 512))
        for i in (0, 1, 7, len(mine) // 2, len(mine) - 1):
            want = plain_log_mel(padded[68 * i :][:512])
            assert max(want) > 0
            np.testing.assert_allclose(got[mine["vec_id"].iloc[i]], want, atol=1e-4)
