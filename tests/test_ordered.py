"""Sliced operators against plain Python, for every way a session can be cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.operators import joins, listing, quantiles, windows
from kinetable.operators.ordered import Timeline, positions, row_index, scan
from kinetable.operators.quantiles import exact_quantiles
from kinetable.operators.vectors import median_vector, wide_vector_stats

CFG = Config()


def frames(n=300, seed=0, hot=0.5):
    """Random frames; one session holds about half of all rows."""
    rng = np.random.default_rng(seed)
    session = np.where(rng.random(n) < hot, 0, rng.integers(1, 6, n))
    return pd.DataFrame({
        "session_id": session, "t": np.round(rng.random(n) * 40, 1), "frame_idx": np.arange(n),
        "x": np.round(rng.random(n) * 10, 3), "flag": rng.random(n) < 0.3,
    }).sample(frac=1, random_state=seed)


def line(width):
    return Timeline(("session_id",), ("t", "frame_idx"), width)


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_scan_equals_plain_cumulation(spark, width):
    data = frames()
    run = {"total": ("sum", F.col("x")), "last": ("max", F.when("flag" and F.col("flag"), F.col("t")))}
    out = scan(spark.createDataFrame(data), line(width), run=run, prev={"x0": F.col("x")}).toPandas()
    out = out.sort_values(["session_id", "t", "frame_idx"], ignore_index=True)
    want = data.sort_values(["session_id", "t", "frame_idx"], ignore_index=True)
    group = want.groupby("session_id")
    np.testing.assert_allclose(out["total"], group["x"].cumsum(), atol=1e-9)
    last = want["t"].where(want["flag"]).groupby(want["session_id"]).cummax().groupby(want["session_id"]).ffill()
    pd.testing.assert_series_equal(out["last"], last, check_names=False)
    pd.testing.assert_series_equal(out["x0"], group["x"].shift(), check_names=False)


def test_backward_scan(spark):
    data = frames(seed=3)
    out = scan(spark.createDataFrame(data), line(4.0), run={"ahead": ("min", F.col("x"))}, backward=True).toPandas()
    out = out.sort_values(["session_id", "t", "frame_idx"], ignore_index=True)
    want = data.sort_values(["session_id", "t", "frame_idx"], ignore_index=True)
    ahead = want[::-1].groupby("session_id")["x"].cummin()[::-1]
    np.testing.assert_allclose(out["ahead"], ahead)


def test_global_index_is_dense(spark):
    data = frames()
    out = row_index(spark.createDataFrame(data), Timeline((), ("t", "frame_idx"), 0.001), "i").toPandas()
    out = out.sort_values(["t", "frame_idx"], ignore_index=True)
    assert out["i"].tolist() == list(range(len(data)))


@pytest.mark.parametrize("width", [0.3, 5.0, 1000.0])
def test_mouth_window_is_time_and_row_bounded(spark, width):
    rng = np.random.default_rng(1)
    # 100 rows per second: the 30-row cap bites before 0.4 s do.
    data = pd.DataFrame({"session_id": 1, "t": np.arange(200) / 100.0, "frame_idx": np.arange(200), "mouth": rng.random(200), "velocity": rng.random(200)})
    out = windows.mouth_window(spark.createDataFrame(data), CFG, line=line(max(width, 0.4))).toPandas().sort_values("frame_idx")
    for i, row in enumerate(out.itertuples()):
        recent = data.iloc[max(0, i - 29) : i + 1]
        recent = recent[row.t - recent["t"] <= 0.40]
        assert row.mean_velocity == pytest.approx(recent["velocity"].mean())
        assert row.mouth_peak == recent["mouth"].max()
        assert row.mouth_range == pytest.approx(recent["mouth"].max() - recent["mouth"].min() if len(recent) > 1 else 0.0)


@pytest.mark.parametrize("n", [10, 63, 64, 79, 80, 96, 200])
def test_sequence_windows(spark, n):
    data = spark.range(n).withColumnRenamed("id", "frame_idx")
    out = windows.sequence_windows(data, Timeline((), ("frame_idx",), 17), F.col("frame_idx")).toPandas().sort_values("seq")
    count = max(1, (n - 64) // 16)
    assert len(out) == count
    for s, rows in zip(out["seq"], out["rows"]):
        assert list(rows) == list(range(16 * s, min(n, 16 * s + 64)))


def test_align_audio_matches_argmin(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"session_id": rng.integers(0, 3, 150), "t": rng.integers(0, 60, 150) / 2.0, "frame_idx": np.arange(150)})
    a = pd.DataFrame({"session_id": rng.integers(0, 3, 40), "t": rng.integers(0, 60, 40) / 2.0})
    a["slice_idx"] = a.groupby("session_id").cumcount()
    f.loc[len(f)] = [9, 1.0, 900]  # no audio at all
    frame, sound = spark.createDataFrame(f.astype({"session_id": int, "frame_idx": int})), spark.createDataFrame(a)
    plan = joins.align_audio(frame, sound, 5.0)
    out = plan.toPandas()
    assert len(out) == len(f)
    for row in out.itertuples():
        mine = a[a["session_id"] == row.session_id].sort_values("slice_idx")
        if mine.empty:
            assert pd.isna(row.slice_idx)
        else:
            assert row.slice_idx == mine["slice_idx"].iloc[int(np.argmin(np.abs(mine["t"].to_numpy() - row.t)))]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_align_audio_by_position_when_counts_match(spark):
    f = spark.createDataFrame([(1, 0.0, 5), (1, 1.0, 6), (1, 2.0, 7)], "session_id int, t double, frame_idx long")
    a = spark.createDataFrame([(1, 50.0, 0), (1, 60.0, 1), (1, 70.0, 2)], "session_id int, t double, slice_idx long")
    assert sorted((r.frame_idx, r.slice_idx) for r in joins.align_audio(f, a, 1.0).collect()) == [(5, 0), (6, 1), (7, 2)]


@pytest.mark.parametrize("accuracy", [10_000, 2])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    # A useless sketch must not change the answer.
    from kinetable.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SLACK", 1e-9)
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"k": np.where(rng.random(2000) < 0.4, 0, rng.integers(1, 5, 2000)), "x": np.where(rng.random(2000) < 0.3, 0.0, rng.normal(size=2000))})
    out = exact_quantiles(spark.createDataFrame(data), ["k"], "x", [0.05, 0.5, 0.9]).toPandas().set_index("k")
    for k, g in data.groupby("k"):
        np.testing.assert_allclose(out.loc[k].to_numpy(), np.percentile(g["x"], [5, 50, 90]), rtol=1e-12)


def test_positions_of_names(spark):
    rng = np.random.default_rng(9)
    names = sorted({f"session_{i}" for i in rng.integers(0, 10**6, 500)})
    data = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    assert {r.name: r.idx for r in positions(data, ["name"], rows=70).collect()} == {n: i for i, n in enumerate(names)}
    assert positions(data.limit(0), ["name"]).collect() == []
    chunks = listing.chunk_assignment(data, Timeline((), ("name",), 1), size=10)
    assert {r.name: r.chunk_id for r in chunks.collect()} == {n: i // 10 for i, n in enumerate(names)}


def test_median_vector_of_ragged_vectors_with_nulls(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, None]), (1, [5.0, 6.0]), (2, [None, None]), (2, [4.0]), (3, None), (4, [])]
    out = {r.k: r["median"] for r in median_vector(spark.createDataFrame(rows, "k int, v array<double>"), ["k"], "v").collect()}
    assert out == {1: [3.0, 4.0], 2: [4.0, None], 4: []}


def test_median_vector(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"k": rng.integers(0, 3, 40), "v": list(rng.normal(size=(40, 200)))})
    frame = spark.createDataFrame(data.assign(v=[r.tolist() for r in data["v"]]))
    out = median_vector(frame, ["k"], "v").toPandas().set_index("k")
    for k, g in data.groupby("k"):
        np.testing.assert_allclose(out.loc[k, "median"], np.median(np.stack(g["v"]), axis=0), rtol=1e-12)


def test_wide_stats_merge(spark):
    x = np.random.default_rng(6).normal(1e6, 1e-3, (500, 40))
    frame = spark.createDataFrame(pd.DataFrame({"v": x.tolist()})).repartition(7)
    out = wide_vector_stats(frame, "v").orderBy("pos").toPandas()
    np.testing.assert_allclose(out["mean"], x.mean(0), rtol=1e-14)
    np.testing.assert_allclose(out["std"], x.std(0), rtol=1e-4)
    assert out["n"].eq(500).all()


def test_best_segment_keeps_first_of_equals(spark):
    data = spark.createDataFrame([(i, 1) for i in range(200)], "frame_idx long, e int")
    out = windows.best_segment(data, Timeline((), ("frame_idx",), 50), "e", 60).first()
    assert (out.start, out.segment_sum) == (0, 60)


def test_watch_sessions_and_pre_roll(spark):
    rows = [(1, i / 30.0, i, 10 <= i < 60, 10 <= i < 60) for i in range(200)]
    data = spark.createDataFrame(rows, "session_id int, t double, frame_idx long, usable boolean, keep boolean")
    out = windows.watch_sessions(data, CFG, F.col("usable"), F.col("keep"), line(0.5))
    first = out.first()
    assert first.start == pytest.approx(19 / 30.0) and first.stop == pytest.approx(59 / 30.0 + 1.8, abs=1 / 30.0)
    assert windows.pre_roll(data, out, CFG, line(0.5)).count() == 20


def test_counts_and_brackets_come_from_one_sketch(spark, monkeypatch):
    plans, staged = [], quantiles.staged
    monkeypatch.setattr(quantiles, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df))
    out = exact_quantiles(spark.createDataFrame(frames()), ["session_id"], "x", [0.5]).toPandas()
    want = frames().groupby("session_id")["x"].median()
    assert out.set_index("session_id")["q0"].to_dict() == pytest.approx(want.to_dict())
    assert plans[0].count("percentile_approx(") == 1
