"""Recursions: many slices, one slice and a plain loop give the same bits."""

import math

import numpy as np
import pandas as pd
import pytest

from kinetable.config import Config
from kinetable.operators import composed, folds, steps
from kinetable.operators.ordered import Timeline

CFG = Config()


def signal(n=400, seed=0):
    rng = np.random.default_rng(seed)
    session = np.where(rng.random(n) < 0.6, "hot", "cold")
    return pd.DataFrame({"session_id": session, "frame_idx": np.arange(n), "t": np.arange(n) / 30.0, "x": rng.random(n)})


def by_session(data, function):
    parts = []
    for _, g in data.sort_values(["t", "frame_idx"]).groupby("session_id"):
        parts.append(pd.Series(function(g), index=g["frame_idx"]))
    return pd.concat(parts).sort_index()


@pytest.mark.parametrize("width", [2.0, 1e9])
def test_one_euro(spark, width):
    def plain(g):
        out, tau = [], lambda fc: 1.0 / (2.0 * math.pi * fc)
        for t, x in zip(g["t"], g["x"]):
            if not out:
                out.append(x)
            else:
                rate = 1.0 / max(1e-4, t - t0)
                te = 1.0 / rate
                dx = (x - out[-1]) * rate
                a = 1.0 / (1.0 + tau(1.0) / te)
                slope = dx if len(out) == 1 else a * dx + (1.0 - a) * slope
                b = 1.0 / (1.0 + tau(1.0 + 0.007 * abs(slope)) / te)
                out.append(b * x + (1.0 - b) * out[-1])
            t0 = t
        return out

    data = signal()
    line = Timeline(("session_id",), ("t", "frame_idx"), width)
    out = folds.one_euro(spark.createDataFrame(data.sample(frac=1, random_state=1)), CFG, ["x"], line).toPandas()
    assert out.set_index("frame_idx")["smooth_x"].sort_index().tolist() == by_session(data, plain).tolist()


def test_smoothing_reduces_noise(spark):
    data = pd.DataFrame({"session_id": 1, "face_id": 0, "frame_idx": range(50), "t": np.arange(50) / 30.0, "v": [[0.5 + 0.05 * (-1) ** i] * 2 for i in range(50)]})
    out = folds.one_euro(spark.createDataFrame(data), CFG, ["v"]).orderBy("frame_idx").toPandas()
    smooth = np.stack(out["smooth_v"])[10:]
    assert (smooth.var(axis=0) < np.stack(out["v"])[10:].var(axis=0)).all()


def test_clean_layer_leaves_raw_alone(spark):
    data = pd.DataFrame({"session_id": 1, "face_id": 0, "frame_idx": range(5), "t": np.arange(5) / 30.0, "landmarks": [[0.1, 0.2, 0.3]] * 5, "channels": [[1.4, -0.2]] * 5, "pose": [[1.234567] * 6] * 5})
    out = folds.clean_layer(spark.createDataFrame(data), CFG).toPandas()
    assert out["channels"].map(list).tolist() == [[1.4, -0.2]] * 5
    assert list(out["clean_channels"].iloc[0]) == [1.0, 0.0]
    assert list(out["clean_pose"].iloc[0]) == [1.23, 1.23, 1.23, 1.235, 1.235, 1.235]
    assert out["is_observed"].all() and not out["is_reconstructed"].any()


@pytest.mark.parametrize("width", [1.0, 1e9])
def test_vad(spark, width):
    tone = 0.1 * np.sin(np.linspace(0, 100 * np.pi, 1600))
    data = pd.DataFrame({"session_id": 1, "slice_idx": [0, 1, 2, 3, 4], "t": [0.0, 0.1, 0.3, 0.5, 2.0], "rms": [0.0, float(np.sqrt(np.mean(tone**2))), 0.0, np.nan, 0.0], "zcr": [0.0, 100 / 1600, 0.0, 0.0, 0.0]})
    out = folds.vad(spark.createDataFrame(data), Config(vad_energy=0.01), Timeline(("session_id",), ("t", "slice_idx"), width)).orderBy("slice_idx").toPandas()
    assert out["is_speech"].tolist() == [False, True, True, False, False]
    assert out["vad_confidence"].iloc[1] == 1.0


def test_vad_veto_keeps_the_hangover_clock():
    rows = {"t": np.array([1.0, 1.2]), "rms": np.array([0.1, 0.001]), "zcr": np.array([0.1, 0.0]), "core": np.array([0.0, 0.5]), "extreme": np.array([0.9, 0.0])}
    state, out = steps.vad([0.004, -1.0], rows, CFG)
    assert out["is_speech"].tolist() == [False, True] and state[1] == 1.0


def test_quality_hysteresis():
    t = np.array([0.0, 0.1, 0.2, 0.4, 0.5])
    _, out = steps.quality_state([0.0, 0.0], {"t": t, "score": np.array([0.7, 0.4, 0.4, 0.6, 0.66]), "rejected": np.zeros(5, bool)}, CFG)
    assert out["is_valid"].tolist() == [True, True, False, False, True]


def faces(seed=0, n=120):
    """Two to three wandering faces, one leaving for a long time and coming back."""
    rng = np.random.default_rng(seed)
    spots, rows, number = np.array([[0.2, 0.3], [0.8, 0.7], [0.5, 0.1]]), [], 0
    for frame in range(n):
        spots = np.clip(spots + rng.normal(0, 0.03, spots.shape), 0, 1)
        seen = [i for i in range(3) if not (i == 2 and 30 <= frame < 60) and rng.random() < 0.9]
        for i in seen:
            rows.append(("s", frame, frame / 30.0, number, *spots[i]))
            number += 1
    return pd.DataFrame(rows, columns=["session_id", "frame_idx", "t", "det_idx", "cx", "cy"])


@pytest.mark.parametrize("width", [0.25, 1.0, 1e9])
def test_track_in_slices_equals_one_pass(spark, width):
    data = faces()
    _, labels = steps.track([0.0], [list(zip(g["cx"], g["cy"])) for _, g in data.groupby("frame_idx")], CFG)
    line = Timeline(("session_id",), ("t", "det_idx"), width)
    out = folds.track(spark.createDataFrame(data), CFG, line).orderBy("det_idx").toPandas()
    flat = [p for frame in labels for p in frame]
    assert list(zip(out["face_id"], out["hits"])) == flat


def test_two_faces_keep_their_ids():
    _, labels = steps.track([0.0], [[(0.5, 0.5), (0.85, 0.5)], [(0.51, 0.51), (0.86, 0.51)]], CFG)
    assert labels == [[(0, 1), (1, 1)], [(0, 2), (1, 2)]]


def test_far_face_is_new_and_lost_track_retires():
    _, labels = steps.track([0.0], [[(0.1, 0.1)], [(0.9, 0.9)]] + [[(0.9, 0.9)]] * 16 + [[(0.1, 0.1)]], CFG)
    assert labels[1][0][0] == 1 and labels[-1][0][0] == 2


def test_envelopes(spark):
    assert steps.attack_release([], np.array([0.0, 1.0, 0.0]))[1].tolist() == [0.0, 0.65, 0.65 * 0.75]
    assert steps.adaptive_peak([0.04], np.array([1.0, 0.0]))[1].tolist() == [0.92 * 0.04 + 0.08, 0.998 * (0.92 * 0.04 + 0.08)]
    assert steps.ema([30.0], np.array([20.0]))[1].tolist() == [0.9 * 30.0 + 0.1 * 20.0]


def many_slices(n=300, seed=3):
    """Rows in a hundred slices of a few rows each, half of them in one session."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.3, 0.0, rng.random(n) * rng.choice([0.01, 1.0, 50.0], n))
    return pd.DataFrame({"session_id": np.where(np.arange(n) % 2 == 0, "hot", "cold"), "frame_idx": np.arange(n), "t": np.arange(n) / 3.0, "x": x, "rejected": rng.random(n) < 0.05})


SHORT = Timeline(("session_id",), ("t", "frame_idx"), 1.0)


@pytest.mark.parametrize(("name", "start", "step"), [("envelope", [], steps.attack_release), ("ema", [30.0], steps.ema)])
def test_levels_take_one_pass_over_a_hundred_slices(spark, monkeypatch, name, start, step):
    writes = []
    monkeypatch.setattr(composed, "staged", lambda df, staged=composed.staged: writes.append(1) or staged(df))
    monkeypatch.setattr(folds, "cut", lambda df: pytest.fail("a round"))
    operator = {"envelope": folds.attack_release, "ema": folds.ema}[name]
    data = many_slices()
    out = operator(spark.createDataFrame(data), SHORT, "x").toPandas().set_index("frame_idx")[name].sort_index()
    assert out.tolist() == by_session(data, lambda g: step(start, g["x"].to_numpy())[1]).tolist()
    assert len(writes) == 1


def test_peak_in_slices_equals_one_pass(spark):
    data = many_slices(60)
    out = folds.adaptive_peak(spark.createDataFrame(data), SHORT, "x").toPandas().set_index("frame_idx")["peak"].sort_index()
    assert out.tolist() == by_session(data, lambda g: steps.adaptive_peak([0.04], g["x"].to_numpy())[1]).tolist()


@pytest.mark.parametrize("width", [0.05, 1.0, 1e9])
def test_quality_in_slices_equals_one_pass(spark, monkeypatch, width):
    monkeypatch.setattr(folds, "cut", lambda df: pytest.fail("a round"))
    data = many_slices(400, 8).assign(t=lambda d: np.round(d["t"] / 10, 3))
    data["score"] = np.random.default_rng(1).choice([0.3, 0.55, 0.7], len(data))
    line = Timeline(("session_id",), ("t", "frame_idx"), width)
    out = folds.quality_state(spark.createDataFrame(data.drop(columns="x")), CFG, line).toPandas().set_index("frame_idx")["is_valid"].sort_index()
    want = by_session(data, lambda g: steps.quality_state([0.0, 0.0], {"t": g["t"].to_numpy(), "score": g["score"].to_numpy(), "rejected": g["rejected"].to_numpy()}, CFG)[1]["is_valid"])
    assert out.tolist() == want.tolist() and 50 < out.sum() < 350


@pytest.mark.parametrize("n", [1, 2, 60, 600])
def test_summaries_equal_the_steps(n):
    rng = np.random.default_rng(n)
    x = rng.random(n) * rng.choice([0.01, 1.0, 100.0])
    parts = x[: n // 2], x[n // 2 :]
    for step in (steps.attack_release, steps.ema):
        level = composed.Contraction(step, 0.0, 1000.0)
        whole, halves = level.of_rows(x, block=16), level.compose(*(level.of_rows(part, block=16) for part in parts))
        for entry in [0.0, 0.02, *(rng.random(20) * rng.choice([1e-3, 1.0, 1e3], 20))]:
            assert level.apply(whole, [entry]) == level.apply(halves, [entry]) == step([entry], x)[0]
        assert level.apply(halves, [5.0]) if step is steps.ema else level.apply(whole, []) == step([], x)[0]


def test_renamings_compose():
    first, second, third = [2.0, -1.0, 3.0, 0.0, 1.0, 1.0, 5.0], [1.0, -2.0, 2.0, 0.0, 4.0], [0.0, -1.0, 7.0]
    both = folds.renamed_twice(folds.renamed_twice(first, second), third)
    assert both == folds.renamed_twice(first, folds.renamed_twice(second, third)) == [3.0, 0.0, 10.0]


@pytest.mark.parametrize("name", ["adaptive_peak", "ema", "vad", "attack_release"])
def test_a_join_broadcast_at_run_time_splits_no_slice(spark, name):
    data = signal(4000).assign(rms=lambda d: d["x"] / 10.0, zcr=0.1)
    line = Timeline(("session_id",), ("t", "frame_idx"), 20.0)
    run = {
        "adaptive_peak": lambda df: folds.adaptive_peak(df, line, "x", "out"), "ema": lambda df: folds.ema(df, line, "x", "out"),
        "vad": lambda df: folds.vad(df, CFG, line).withColumnRenamed("vad_confidence", "out"), "attack_release": lambda df: folds.attack_release(df, line, "x", "out"),
    }[name]
    plain = {
        "adaptive_peak": lambda g: steps.adaptive_peak([0.04], g["x"].to_numpy())[1], "ema": lambda g: steps.ema([30.0], g["x"].to_numpy())[1],
        "vad": lambda g: steps.vad([CFG.vad_floor_start, -1.0], {c: g[c].to_numpy() for c in ("t", "rms", "zcr")}, CFG)[1]["vad_confidence"],
        "attack_release": lambda g: steps.attack_release([], g["x"].to_numpy())[1],
    }[name]
    # Nothing is known to be small when planning; the joins turn out small when running.  Few rows would come as one partition.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = run(spark.createDataFrame(data.sample(frac=1, random_state=1)).repartition(8)).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert out.set_index("frame_idx")["out"].sort_index().tolist() == by_session(data, plain).tolist()
