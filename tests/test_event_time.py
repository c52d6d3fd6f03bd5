"""Event time: shuffled files give the batch result, late rows are counted, state stays bounded."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.config import Config
from kinetable.operators import windows
from kinetable.operators.ordered import Timeline
from kinetable.streaming import event_time, live
from kinetable.streaming.event_time import Lateness

CFG = Config()
TIME = "timestamp_millis(CAST(t * 1000 AS BIGINT))"


def files(spark, path, parts):
    """One file per part, taken up in this order; the last one closes the stream."""
    first = spark.createDataFrame(parts[0])
    closing = parts[0].iloc[:2].assign(session_id="~", t=1e6)
    if "sound" in closing:  # both sides of a join have to move on
        closing["sound"] = [True, False]
    for i, part in enumerate([*parts, closing]):
        spark.createDataFrame(part, first.schema).coalesce(1).write.parquet(f"{path}/{i:02d}")
    source = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return source.parquet(str(path))


def dealt(data, seed, n=5):
    """The rows at random over ``n`` files."""
    where = np.random.default_rng(seed).integers(0, n, len(data))
    return [data[where == k].sample(frac=1, random_state=k) for k in range(n)]


def frames(n=300):
    rng = np.random.default_rng(2)
    out = pd.DataFrame({"session_id": np.where(rng.random(n) < 0.7, "hot", "cold"), "t": np.round(np.cumsum(rng.random(n) * 0.4), 3), "frame_idx": np.arange(n)})
    kind = rng.choice(["on", "on", "on", "keep", "off", "off"], n)
    return out.assign(usable=kind == "on", keep=kind != "off", level=rng.random(n))


def watched(data):
    """Recordings of one session, row by row."""
    out, phase, run, seen = [], "armed", None, None
    for t, usable, keep in data.sort_values(["t", "frame_idx"])[["t", "usable", "keep"]].itertuples(index=False):
        if phase == "armed":
            if not (usable and keep):
                run = None
            elif run is None:
                run = t
            elif t - run >= CFG.watch_trigger_s:
                out.append([t, None])
                phase, seen = "recording", t
        elif keep:
            seen = t
        elif t - seen >= CFG.watch_loss_s:
            out[-1][1] = t
            phase, run = "armed", None
    return out


def session(seed, n=400):
    """Long stretches with and without a face, so that a session has several recordings."""
    rng = np.random.default_rng(seed)
    there = np.repeat(rng.random(40) < 0.5, 10)[:n]
    return pd.DataFrame({"session_id": "s", "t": np.arange(n) * 0.25, "frame_idx": np.arange(n), "usable": there & (rng.random(n) < 0.9), "keep": there})


@pytest.mark.parametrize("width", [3.0, 1e9])
def test_watch_again_finds_every_recording(spark, width):
    data = pd.concat([session(k).assign(session_id=f"s{k}") for k in range(4)])
    line = Timeline(("session_id",), ("t", "frame_idx"), width)
    got = windows.watch_sessions(spark.createDataFrame(data), CFG, F.col("usable"), F.col("keep"), line, rearm=True).toPandas()
    for name, rows in data.groupby("session_id"):
        mine = got[got["session_id"] == name].sort_values("recording")
        want = watched(rows)
        assert len(want) > 2 and mine["recording"].tolist() == list(range(1, len(want) + 1))
        assert [[a, None if pd.isna(b) else b] for a, b in zip(mine["start"], mine["stop"])] == want


def test_watch_stream_begins_again(spark, tmp_path):
    data = session(9)
    stream = files(spark, tmp_path, dealt(data, 1))
    out = live.to_table(live.stream_watch(stream, CFG, rearm=True, lateness=Lateness(TIME, "2 minutes"))).toPandas()
    want = watched(data)
    assert sorted(out[out.event == "start"]["t"]) == [a for a, _ in want] and sorted(out[out.event == "stop"]["t"]) == [b for _, b in want if b is not None]
    assert not out["is_late"].any()
    # The ring starts empty after each stop and holds at most two seconds.
    for start, before in zip([a for a, _ in want], [-1.0, *[b for _, b in want]]):
        ring = out[(out.event == "pre_roll") & (out.t <= start) & (out.t > start - 3)]
        assert sorted(ring["t"]) == data[(data.t <= start) & (data.t >= start - 2) & (data.t > before)]["t"].tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_shuffled_files_give_the_batch_result(spark, tmp_path, seed):
    data = frames()
    stream = files(spark, tmp_path, dealt(data, seed)).withColumn("state", F.when(F.col("usable"), "ACTIVE_SPEECH"))
    got = live.to_table(live.stream_gaps(stream, CFG, lateness=Lateness(TIME, "10 minutes"))).toPandas()
    assert len(got) == len(data) and not got["is_late"].any()
    want = windows.frame_gaps(spark.createDataFrame(data), CFG).toPandas()
    both = got.merge(want, on="frame_idx", suffixes=("", "_batch"))
    assert both["is_gap"].tolist() == both["is_gap_batch"].tolist()
    assert np.allclose(both["dt"].astype(float), both["dt_batch"].astype(float), equal_nan=True, rtol=1e-12)
    # Rows of a session come out in the order of their times, whatever the files held.
    taken = live.to_table(live.stream_cap(files(spark, tmp_path / "again", dealt(data, seed + 7)), "level", None, 50, lateness=Lateness(TIME, "10 minutes"))).toPandas()
    assert sorted(taken["frame_idx"]) == sorted(data.groupby("session_id").head(50)["frame_idx"])


def test_late_rows_are_marked_and_counted(spark, tmp_path):
    early = frames(200)
    stray = early.iloc[[5, 50, 120]].assign(frame_idx=[1000, 1001, 1002])
    near = early.iloc[[199]].assign(frame_idx=1003)
    stream = files(spark, tmp_path, [early.iloc[:100], early.iloc[100:], pd.concat([stray, near])])
    rows = event_time.in_order(stream, event_time.passed, ["t", "frame_idx"], {}, [], Lateness(TIME, "3 seconds"))
    out = live.to_table(rows)
    got = out.toPandas()
    assert sorted(got[got["is_late"]]["frame_idx"]) == [1000, 1001, 1002]
    assert len(got) == 204
    counts = {r.session_id: (r.on_time, r.late) for r in event_time.late_counts(out).collect()}
    assert sum(late for _, late in counts.values()) == 3 and sum(n for n, _ in counts.values()) == 201


def progress(spark, stream, folder, mode="append"):
    """Run a stream and return the rows of state after each batch."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return [sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]


@pytest.mark.parametrize("kind", [{"width": "4 seconds", "slide": "2 seconds"}, {"gap": "1 second"}])
def test_windows_equal_batch_and_forget(spark, tmp_path, kind):
    data = frames(600)
    parts = [data.iloc[k : k + 60].sample(frac=1, random_state=k) for k in range(0, 600, 60)]
    stream = files(spark, tmp_path / "in", parts)
    out = event_time.windowed_counts(stream, Lateness(TIME, "2 seconds"), values=[F.sum("level").alias("total")], **kind)
    held = progress(spark, out, tmp_path / "run")
    got = spark.read.parquet(str(tmp_path / "run/data")).filter("session_id <> '~'")
    window = F.session_window("_event_time", kind["gap"]) if "gap" in kind else F.window("_event_time", kind["width"], kind["slide"])
    batch = spark.createDataFrame(data).withColumn("_event_time", F.expr(TIME)).groupBy("session_id", window.alias("w")).agg(F.count("*").alias("n_rows"), F.sum("level").alias("total"))
    key = lambda rows: sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in rows)
    assert key(got.collect()) == key(batch.select("session_id", "w.start", "w.end", "n_rows", "total").collect())
    assert max(held) < got.count() / 3  # closed windows leave the state


def test_windows_need_one_kind(spark):
    with pytest.raises(ValueError):
        event_time.windowed_counts(spark.range(1), Lateness(TIME, "1 second"))


@pytest.mark.parametrize("lag", [0, 1, 2])
def test_audio_of_later_batches_still_meets_its_frames(spark, tmp_path, lag):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"session_id": rng.choice(["a", "b"], 240), "t": np.sort(np.round(rng.random(240) * 60 + 1, 3)), "id": np.arange(240), "x": rng.random(240)})
    sound = rng.random(240) < 0.4
    wave = np.where(sound, rows["t"] // 10 + lag, rows["t"] // 10).astype(int)  # audio comes so many batches late
    parts = [rows[wave == k].assign(sound=sound[wave == k]) for k in range(wave.max() + 1)]
    stream = files(spark, tmp_path, parts)
    late = Lateness(TIME, "40 seconds")
    joined = event_time.latest_within(stream.filter("not sound"), stream.filter("sound"), ["x"], late, "5 seconds")
    carried = live.stream_carry(stream.filter("not sound"), stream.filter("sound"), ["x"], lateness=late)
    want = {}
    for r in rows[~sound].itertuples():
        heard = rows[sound & (rows["session_id"] == r.session_id) & (rows["t"] <= r.t)]
        want[r.id] = (heard["x"].iloc[-1], r.t - heard["t"].iloc[-1]) if len(heard) else (None, None)
    two = {r.id: r.x for r in live.to_table(carried).collect()}
    assert two == {i: x for i, (x, _) in want.items()}
    one = {r.id: r.x for r in live.to_table(joined).filter("session_id <> '~'").collect()}
    assert one == {i: x if gap is not None and gap <= 5 else None for i, (x, gap) in want.items()}


def test_state_is_read_and_written_once_a_call():
    calls, cells = [], {}

    class Cell:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def run(*given):
                calls.append((self.name, call))
                if call == "exists":
                    return self.name in cells
                if call == "get":
                    return cells.get(self.name)
                cells[self.name] = {"update": lambda: given[0], "appendValue": lambda: [*(cells.get(self.name) or []), given[0]], "clear": lambda: None}[call]()
            return run

    class Handle:
        getValueState = getListState = lambda self, name, kind: Cell(name)
        registerTimer = deleteTimer = lambda self, millis: calls.append(("timer", millis))

    class Clock:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    rows = pd.DataFrame({"t": [3.0, 1.0, 2.0], event_time.MILLIS: [3000, 1000, 2000]})
    one = event_time.OrderedSession(event_time.passed, ["t"], {}, list(rows.columns))
    one.init(Handle())
    assert list(one.handleInputRows("k", iter([rows.iloc[:2], rows.iloc[2:]]), Clock(0))) == []
    assert [c for n, c in calls if n == "session"] == ["get", "update"]
    calls.clear()
    (out,) = one.handleExpiredTimer("k", Clock(2500), None)
    assert out["t"].tolist() == [1.0, 2.0] and [c for n, c in calls if n == "session"] == ["get", "update"] and ("timer", 3000) in calls


def test_a_stream_join_keeps_one_store_a_task(spark, tmp_path):
    rows = pd.DataFrame({"session_id": "a", "t": np.arange(40) * 1.0, "id": np.arange(40), "x": 0.5, "sound": np.arange(40) % 2 == 0})
    stream = files(spark, tmp_path / "in", [rows.iloc[:20], rows.iloc[20:]])
    joined = event_time.latest_within(stream.filter("not sound"), stream.filter("sound"), ["x"], Lateness(TIME, "5 seconds"), "3 seconds")
    settings = {name: spark.conf.get(name, None) for name in live.STATE}
    with live.keyed_store(spark):
        query = joined.writeStream.format("parquet").option("path", f"{tmp_path}/data").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert settings == {name: spark.conf.get(name, None) for name in live.STATE}
    stores = {op["operatorName"]: op["numStateStoreInstances"] for op in json.loads(query.recentProgress[-1].json)["stateOperators"]}
    assert stores["symmetricHashJoin"] == stores["stateStoreSave"]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_sessions_share_keys_of_state(spark, tmp_path, kind):
    """Far fewer keys of state than sessions, and each session's rows as if it were alone, those without an id too."""
    rng = np.random.default_rng(4)
    n, ids = 1200, [None, *range(2**60 + 1, 2**60 + 300)]  # numbers that a float can't hold
    data = pd.DataFrame({"session_id": pd.array([ids[k] for k in rng.integers(0, 300, n)], dtype="Int64"), "t": np.round(np.sort(rng.random(n)) * 90 + 1, 3), "frame_idx": np.arange(n)})
    rows = spark.createDataFrame([(None if pd.isna(s) else int(s), float(t), int(i)) for s, t, i in data.itertuples(index=False)], "session_id long, t double, frame_idx long")
    rows = rows.withColumn("session_id", F.col("session_id").cast(kind))
    for k in range(4):
        rows.filter((F.col("frame_idx") * 7919) % 4 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows.limit(1).select(F.lit("7").cast(kind).alias("session_id"), F.lit(1e6).alias("t"), F.lit(-1).cast("long").alias("frame_idx")).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = live.stream_gaps(stream.withColumn("state", F.lit("ACTIVE_SPEECH")), CFG, lateness=Lateness(TIME, "10 minutes", shares=3))
    held = progress(spark, out, tmp_path / "run")
    assert 0 < max(held) <= 40  # three shares and the one without an id; some 300 sessions
    got = spark.read.parquet(str(tmp_path / "run/data")).collect()
    assert not any(r.is_late for r in got) and {(r.session_id, r.frame_idx) for r in got} == {(r.session_id, r.frame_idx) for r in rows.collect()}
    seen = {}
    for r in sorted(got, key=lambda r: (r.t, r.frame_idx)):
        last, total = seen.get(r.session_id, (None, 0.0))
        assert (r.dt is None) == (last is None) and (last is None or r.dt == max(r.t - last, 1e-4))
        total += r.dt or 0.0
        assert r.speech_seconds == pytest.approx(total)
        seen[r.session_id] = (r.t, total)


def test_late_rows_of_shared_keys_are_counted_by_session(spark, tmp_path):
    early = pd.DataFrame({"session_id": [f"s{k % 50}" for k in range(400)], "t": np.arange(400) * 0.5 + 1, "frame_idx": np.arange(400)})
    stray = early.iloc[[7, 57, 8]].assign(frame_idx=[1000, 1001, 1002])
    stream = files(spark, tmp_path / "in", [early.iloc[:200], early.iloc[200:], stray])
    rows = event_time.in_order(stream, event_time.passed, ["t", "frame_idx"], {}, [], Lateness(TIME, "3 seconds", shares=2))
    held = progress(spark, rows, tmp_path / "run")
    assert max(held) <= 20  # 50 sessions
    counts = {r.session_id: (r.on_time, r.late) for r in event_time.late_counts(spark.read.parquet(str(tmp_path / "run/data"))).collect()}
    assert {s: late for s, (_, late) in counts.items() if late} == {"s7": 2, "s8": 1} and sum(n for n, _ in counts.values()) == 400


@pytest.mark.parametrize("name", ["gaps", "watch", "carry", "cap"])
def test_a_step_takes_many_sessions_like_one(spark, monkeypatch, name):
    data = pd.concat([session(k).assign(session_id=f"s{k}") for k in range(4)], ignore_index=True)
    data = data.assign(state=np.where(data["usable"], "ACTIVE_SPEECH", None), kind=data["usable"].astype(int), id=data["frame_idx"], level=0.25, x=np.where(data["frame_idx"] % 3 == 0, None, data["t"]).astype(float))
    rows, caught = spark.createDataFrame(data), []
    monkeypatch.setattr(live, "keyed", lambda stream, step, order, start, *more, **named: caught.extend((step, json.dumps(start))))
    {"gaps": lambda: live.stream_gaps(rows, CFG), "watch": lambda: live.stream_watch(rows, CFG, rearm=True),
     "carry": lambda: live.stream_carry(rows, rows, ["x"]), "cap": lambda: live.stream_cap(rows, "level", 4.0, 9)}[name]()
    step, start = caught
    together, alone, states, one = [], [], [json.loads(start) for _ in range(4)], [json.loads(start) for _ in range(4)]
    for part in (data[data["t"] < 50].reset_index(drop=True), data[data["t"] >= 50].reset_index(drop=True)):
        edges = [*np.flatnonzero(part["session_id"] != part["session_id"].shift()).tolist(), len(part)]
        states, out = step.many(states, part, edges)
        together.append(out)
        for k, (i, j) in enumerate(zip(edges, edges[1:])):
            one[k], out = step(one[k], part.iloc[i:j].reset_index(drop=True))
            alone.append(out)
    assert json.dumps(states) == json.dumps(one) and sum(map(len, together)) > 4
    plain = lambda parts: sorted(tuple(str(v) for v in r) for p in parts if len(p) for r in p.astype(object).itertuples(index=False))
    assert plain(together) == plain(alone)
