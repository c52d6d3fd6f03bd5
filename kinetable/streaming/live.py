"""Live operators: keyed state per session, fed by micro-batches.

Each processor keeps one small JSON state per session and calls the step functions
of ``operators.steps``, so a stream gives the rows a batch run gives.  Rows of a
micro-batch are put in order first.  Order across micro-batches is the source's, unless an
operator is given a ``Lateness``: then rows wait for the watermark (``streaming.event_time``), the
output has ``is_late``, and rows may arrive in any order within the delay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinetable.config import Config
from kinetable.operators import steps
from kinetable.operators.speech import gate_labels
from kinetable.session import checkpoint_folder
from kinetable.streaming.event_time import Lateness, Together, in_order

# Fixed value: the state store that keyed processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of streams: STORE, commits that write what changed, one store per task of a stream join (four else).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


class SessionState(StatefulProcessor):
    """Runs ``step(state, rows) -> (state, output)`` on the ordered rows of a session."""

    def __init__(self, step: Callable, order: Sequence[str], start: dict, names: Sequence[str], idle_s: float | None = None):
        self.step, self.order, self.start, self.names, self.idle_s = step, list(order), start, list(names), idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("json", T.StringType())])
        idle = () if self.idle_s is None else (int(self.idle_s * 1000),)
        self.value = handle.getValueState("session", kind, *idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        batch.columns = self.names  # columns made on the way may come without their names
        batch = batch.sort_values(self.order, kind="mergesort", ignore_index=True)
        known = self.value.get()  # each call of the state is a message
        state = json.loads(known[0]) if known else json.loads(json.dumps(self.start))
        state, output = self.step(state, batch)
        self.value.update((json.dumps(state),))
        if len(output):
            yield output

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, step: Callable, order: Sequence[str], start: dict, added: Sequence[tuple[str, T.DataType]],
          key: str = "session_id", keep: Sequence[str] | None = None, idle_s: float | None = None, lateness: Lateness | None = None) -> DataFrame:
    """Apply a step to a stream: its rows (or ``keep``) plus the ``added`` columns.

    With ``idle_s``, for streams that run on and on, the state of a session without rows for so
    many seconds of processing time is dropped; a later row starts anew.

    Start the stream with :func:`to_table`, or under a session whose state store is STORE.
    """
    if lateness:
        return in_order(stream, step, order, start, added, lateness, key, keep)
    names = stream.columns if keep is None else list(keep)
    schema = T.StructType([f for f in stream.schema if f.name in names] + [T.StructField(n, t) for n, t in added])

    def run(state, rows):
        state, output = step(state, rows)
        return state, output[schema.names]

    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SessionState(run, order, start, stream.columns, idle_s), outputStructType=schema, outputMode="Append",
        timeMode="None" if idle_s is None else "ProcessingTime",
    )


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state as STATE says."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    ``folder`` keeps data and progress between calls, so that a later call continues.
    """
    spark = stream.sparkSession
    base = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/progress")
    with keyed_store(spark):
        query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder, one file or many, as a stream with its stored schema.

    All of its files are one micro-batch, so that a table in many files gives what the same rows in one file give.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, as a stream's path may be that of a single file only if it is one.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def stream_gaps(frames: DataFrame, cfg: Config, order=("t", "frame_idx"), state: str = "state", lateness: Lateness | None = None) -> DataFrame:
    """Gap flag of every row and the session's running seconds per gated state.

    ``frames`` has session_id, t, frame_idx and ``state`` (null while not gated).
    """
    t, floor, limit = order[0], cfg.span(1e-4), cfg.span(cfg.gap_s)
    # The states that count.
    counted = ("ACTIVE_SPEECH", "BETWEEN_WORDS", "CONVERSATIONAL_PAUSE")
    names = ("speech_seconds", "between_seconds", "pause_seconds")

    def many(memories, rows, edges):
        dts, gaps, totals = [], [], {n: [] for n in names}
        times, labels = rows[t].tolist(), rows[state].tolist()
        for memory, i, j in zip(memories, edges, edges[1:]):
            for now, label in zip(times[i:j], labels[i:j]):
                last = memory["t"]
                dt = None if last is None else max(now - last, floor)
                gaps.append(last is not None and now - last > limit)
                dts.append(dt)
                if dt is not None and label in counted:
                    memory[names[counted.index(label)]] += dt
                for n in names:
                    totals[n].append(memory[n])
                memory["t"] = now
        return memories, rows.assign(dt=pd.array(dts, dtype="Float64" if cfg.unit == 1.0 else "Int64"), is_gap=gaps, **totals)

    kind = T.DoubleType() if cfg.unit == 1.0 else T.LongType()
    start = {"t": None, **{n: 0 if cfg.unit != 1.0 else 0.0 for n in names}}
    added = [("dt", kind), ("is_gap", T.BooleanType()), *[(n, kind) for n in names]]
    return keyed(frames, Together(many), order, start, added, lateness=lateness)


def stream_watch(frames: DataFrame, cfg: Config, order=("t", "frame_idx"), rearm: bool = False, lateness: Lateness | None = None) -> DataFrame:
    """Recording events per session: ``pre_roll`` rows, ``start`` and ``stop``.

    ``frames`` has session_id, t, frame_idx, ``usable`` (trigger) and ``keep``.  The
    ring of recent rows is capped like the batch pre-roll.  With ``rearm`` the watch begins
    anew after each stop, with an empty ring; a trigger row then has to be a keep row as well.
    """
    t, index = order
    cap, reach = max(10, int(cfg.preroll_s * cfg.fps)), cfg.span(cfg.preroll_s)
    trigger, loss = cfg.span(cfg.watch_trigger_s), cfg.span(cfg.watch_loss_s)

    def many(memories, rows, edges):
        events, columns = [], [rows[c].tolist() for c in ("session_id", t, index, "usable", "keep")]
        for memory, i, j in zip(memories, edges, edges[1:]):
            for session, now, frame, usable, keep in zip(*(c[i:j] for c in columns)):
                usable = usable and (keep or not rearm)
                if memory["phase"] == "armed":
                    memory["ring"] = [r for r in [*memory["ring"], [now, frame]] if r[0] >= now - reach][-cap:]
                    if not usable:
                        memory["run"] = None
                    elif memory["run"] is None:
                        memory["run"] = now
                    elif now - memory["run"] >= trigger:
                        events += [(session, "pre_roll", *r) for r in memory["ring"]] + [(session, "start", now, frame)]
                        memory.update(phase="recording", seen=now, ring=[])
                elif memory["phase"] == "recording":
                    if keep:
                        memory["seen"] = now
                    elif now - memory["seen"] >= loss:
                        events.append((session, "stop", now, frame))
                        memory.update(phase="armed" if rearm else "done", run=None)
        return memories, pd.DataFrame(events, columns=["session_id", "event", t, index])

    kinds = {f.name: f.dataType for f in frames.schema}
    added = [("event", T.StringType()), (t, kinds[t]), (index, kinds[index])]
    return keyed(frames, Together(many), order, {"phase": "armed", "run": None, "seen": None, "ring": []}, added, keep=["session_id"], lateness=lateness)


def stream_carry(frames: DataFrame, audio: DataFrame, values: Sequence[str], order=("t", "kind", "id"), lateness: Lateness | None = None) -> DataFrame:
    """Frames with the values of the latest audio row of their session.

    Both streams have session_id, t and id; ``values`` are columns of ``audio``.
    """
    kinds = {f.name: f.dataType for f in audio.schema}
    both = audio.select("session_id", "t", F.lit(0).alias("kind"), "id", *values).unionByName(
        frames.select("session_id", "t", F.lit(1).alias("kind"), "id", *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    )

    def many(memories, rows, edges):
        kept, carried, after = [], {v: [] for v in values}, []
        kind, heard, missing = rows["kind"].tolist(), {v: rows[v].tolist() for v in values}, {v: rows[v].isna().tolist() for v in values}
        for memory, i, j in zip(memories, edges, edges[1:]):
            for k in range(i, j):
                if kind[k] == 0:
                    memory = {v: None if missing[v][k] else heard[v][k] for v in values}
                else:
                    kept.append(k)
                    for v in values:
                        carried[v].append(memory[v])
            after.append(memory)
        return after, rows.iloc[kept][["session_id", "t", "id"]].assign(**carried)

    return keyed(both, Together(many), order, dict.fromkeys(values), [(v, kinds[v]) for v in values], keep=["session_id", "t", "id"], lateness=lateness)


def stream_cap(frames: DataFrame, seconds: str, max_s: float | None, max_frames: int | None, order=("t", "frame_idx"), lateness: Lateness | None = None) -> DataFrame:
    """Rows of a session until its accumulated duration or frame count reaches a cap."""

    def many(memories, rows, edges):
        kept, used = [], rows[seconds].tolist()
        for memory, i, j in zip(memories, edges, edges[1:]):
            for k in range(i, j):
                if (max_s is not None and memory["used"] >= max_s) or (max_frames is not None and memory["taken"] >= max_frames):
                    break
                kept.append(k)
                memory["used"] += used[k]
                memory["taken"] += 1
        return memories, rows.iloc[kept]

    return keyed(frames, Together(many), order, {"used": 0, "taken": 0}, [], lateness=lateness)


def stream_faces(detections: DataFrame, cfg: Config, lateness: Lateness | None = None) -> DataFrame:
    """Track faces and measure their motion.

    ``detections``: session_id, frame_idx, t, det_idx, cx, cy, mouth and ``points``
    (x, y of the jitter landmarks).  Adds face_id, hits, n_faces, jitter, velocity,
    mean_velocity, mouth_range and mouth_peak.  State of retired faces is dropped.
    """
    names = ("jitter", "velocity", "mean_velocity", "mouth_range", "mouth_peak")
    reach = cfg.span(cfg.lip_window_s)

    def moved(points, befores):
        """Sum over landmarks of how far each row's ``points`` are from those before, per landmark."""
        out = np.zeros(len(points))
        for size in {len(p) for p in points}:
            at = [i for i, p in enumerate(points) if len(p) == size]
            now, before = (np.array([x[i] for i in at], float).reshape(len(at), -1, 2) for x in (points, befores))
            out[at] = np.sqrt(((now - before) ** 2).sum(axis=2)).sum(axis=1) / now.shape[1]
        return out.tolist()

    def step(memory, rows):
        places = {}  # rows of a frame, frames as they come
        for i, frame in enumerate(rows["frame_idx"].tolist()):
            places.setdefault(frame, []).append(i)
        cx, cy, times, mouths, points = (rows[c].tolist() for c in ("cx", "cy", "t", "mouth", "points"))
        state, labels = steps.track(memory["track"], [[(cx[i], cy[i]) for i in g] for g in places.values()], cfg)
        out = {n: [None] * len(rows) for n in ("face_id", "hits", "n_faces", *names)}
        later, befores, spans = [], [], []
        for g, faces in zip(places.values(), labels):
            for i, (face, hits) in zip(g, faces):
                mine, now, mouth = memory["faces"].setdefault(str(face), {}), times[i], mouths[i]
                last, speed = mine.get("last"), 0.0
                if last is not None:
                    dt = (now - last[0]) / cfg.unit
                    speed = abs(mouth - last[1]) / dt if dt > 1e-4 else 0.0
                    later.append(i)
                    befores.append(last[2])
                    spans.append(max(1e-4, dt))
                mine["last"] = [now, mouth, points[i]]
                mine["recent"] = [*mine.get("recent", []), [now, mouth, speed]][-cfg.lip_window_rows :]
                near = [r for r in mine["recent"] if now - r[0] <= reach]
                levels = [r[1] for r in near]
                mean = sum((r[2] for r in near), 0.0) / len(near)
                peak = max(levels)
                values = (face, hits, len(faces), 0.0, speed, mean, peak - min(levels) if len(near) >= 2 else 0.0, peak)
                for n, v in zip(out, values):
                    out[n][i] = v
        for i, way, dt in zip(later, moved([points[i] for i in later], befores), spans):
            out["jitter"][i] = way / dt
        live = {str(int(state[i])) for i in range(1, len(state), 5)}
        kept = {k: {**v, "last": [*v["last"][:2], list(map(float, v["last"][2]))]} for k, v in memory["faces"].items() if k in live}
        return {"track": state, "faces": kept}, rows.assign(**out)

    added = [("face_id", T.LongType()), ("hits", T.LongType()), ("n_faces", T.LongType()), *[(n, T.DoubleType()) for n in names]]
    return keyed(detections, step, ("t", "frame_idx", "det_idx"), {"track": [0.0], "faces": {}}, added, lateness=lateness)


def stream_frames(faces: DataFrame, cfg: Config, smooth: str | None = None, order=("t", "frame_idx", "det_idx")) -> DataFrame:
    """Judge and smooth tracked faces: quality flag, speech gate, labels.

    ``faces``: session_id, face_id, n_faces, hits, score, rejected, articulating,
    motion_score and an array column ``smooth``.
    """
    t = order[0]

    def step(memory, rows):
        times, scores, rejected = rows[t].tolist(), rows["score"].tolist(), rows["rejected"].tolist()
        good, taus, smoothed, of_face = [None] * len(rows), [], [None] * len(rows), {}
        for i, (face, now, moving, several) in enumerate(zip(rows["face_id"].tolist(), times, rows["articulating"].tolist(), (rows["n_faces"] > 1).tolist())):
            of_face.setdefault(str(face), []).append(i)
            if moving and not (cfg.strict_single_face and several):
                memory["spoke"] = now
            taus.append(None if memory["spoke"] is None else max(now - memory["spoke"], 0))
        values = rows[smooth].tolist() if smooth else None
        for face, at in of_face.items():  # the rows of a face in one go
            mine = memory["faces"].setdefault(face, {"quality": [0.0, 0.0], "euro": []})
            run = {"t": [times[i] for i in at], "score": [scores[i] for i in at], "rejected": [rejected[i] for i in at]}
            mine["quality"], flags = steps.quality_state(mine["quality"], run, cfg)
            if smooth:
                mine["euro"], levels = steps.one_euro(mine["euro"], np.array(run["t"]), np.array([values[i] for i in at], float), cfg)
            for k, (i, flag) in enumerate(zip(at, flags["is_valid"].tolist())):
                good[i] = flag
                if smooth:
                    smoothed[i] = levels[k]
        out = rows.assign(is_valid=good, _tau=pd.array(taus, dtype="Float64" if cfg.unit == 1.0 else "Int64"))
        return memory, out.assign(**{"smooth_" + smooth: smoothed}) if smooth else out

    kind = T.DoubleType() if cfg.unit == 1.0 else T.LongType()
    added = [("is_valid", T.BooleanType()), ("_tau", kind)]
    if smooth:
        added.append(("smooth_" + smooth, T.ArrayType(T.DoubleType())))
    out = keyed(faces, step, order, {"faces": {}, "spoke": None}, added)
    return out.select(*[c for c in out.columns if c != "_tau"], *gate_labels(cfg, "speech_active" in faces.columns))
