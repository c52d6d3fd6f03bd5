"""Event time: rows put in order under a watermark, late rows counted, windows, interval joins.

Micro-batches bring rows in any order.  A watermark says how far behind the newest time seen a
row may still arrive; what is older than the watermark is *late*.  :func:`in_order` holds rows
back until the watermark has passed them and hands them to a step function sorted, so a stream
of shuffled files gives the rows of a batch run; late rows come out marked, never lost.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIME, MILLIS, SHARE = "_event_time", "_millis", "_share"


@dataclass(frozen=True)
class Lateness:
    """How far rows may lag: ``event_time`` is a SQL expression of a row's timestamp, ``delay`` an interval.

    Sessions share so many keys of state (``shares``); a task holds the waiting rows of one of them.
    """

    event_time: str
    delay: str
    shares: int = 256


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, which keeps the types of every column."""
    sink, table = io.BytesIO(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts as plain objects: put together from pieces they could not go back to Spark."""
    texts = [c for c in rows.columns if isinstance(rows[c].dtype, pd.StringDtype)]
    return rows.astype(dict.fromkeys(texts, object)) if texts else rows


@dataclass(frozen=True)
class Together:
    """A step that takes the rows of many sessions at once; called like any other it takes those of one.

    ``many(states, rows, edges)`` gets one state per session, rows in which sessions follow each
    other, and the places where sessions begin, with the end; it returns new states and the output.
    """

    many: Callable

    def __call__(self, state, rows: pd.DataFrame):
        (state,), output = self.many([state], rows, [0, len(rows)])
        return state, output


def one_by_one(step: Callable, states: list, rows: pd.DataFrame, edges: list[int]):
    """What ``Together.many`` returns, for a step over the rows of one session."""
    after, outputs = [], []
    for state, i, j in zip(states, edges, edges[1:]):
        state, output = step(state, rows.iloc[i:j].reset_index(drop=True))
        after.append(state)
        if len(output):
            outputs.append(output)
    return after, pd.concat(outputs, ignore_index=True) if outputs else rows.iloc[:0]


def named(keys: pd.Series) -> list:
    """Keys as plain values, None for those that are missing."""
    return [None if pd.isna(k) else k for k in keys.tolist()]


class OrderedSession(StatefulProcessor):
    """Buffers the rows of a share of the sessions until the watermark passes them, then steps over each session's in order.

    The buffer is a list state with one packed piece per Arrow batch and what was left over of
    earlier ones; an event-time timer at the oldest buffered row releases.  Only rows younger
    than the watermark are ever held.  What a key of state costs Spark (messages, frames, a look
    at its timers) is paid once a share, not once a session; without ``key`` a share is one session.
    """

    def __init__(self, step: Callable, order: Sequence[str], start: dict, names: Sequence[str], key: str | None = None):
        self.step, self.order, self.start, self.names, self.key = step, list(order), json.dumps(start), list(names), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", T.StructType([T.StructField("json", T.StringType())]))
        self.states = handle.getValueState("states", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.buffer = handle.getListState("buffer", T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, oldest = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:  # one Arrow batch at a time: a burst of rows is never one frame
            if batch.empty:  # a batch without data has no columns either
                continue
            batch.columns = self.names  # columns made on the way may come without their names
            late = (batch[MILLIS] <= mark) & (mark > 0)  # 0: no batch has set the watermark yet
            if late.any():
                yield self.marked(batch[late], True)
            if (~late).any():
                kept = batch[~late]
                self.buffer.appendValue((packed(kept),))
                oldest.append(int(kept[MILLIS].min()))
        if oldest:
            memory = self.memory()
            if self.arm(memory, min(oldest)):
                self.remember(memory)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = pd.concat([unpacked(bytes(piece[0])) for piece in self.buffer.get()], ignore_index=True)
        due = held[MILLIS] <= mark
        rest = held[~due]
        self.buffer.clear()
        # Each call of the state is a message: it is read once and written once.
        memory, output = {**self.memory(), "timer": None}, []
        if len(rest):
            self.buffer.appendValue((packed(rest),))
            self.arm(memory, int(rest[MILLIS].min()))
        if due.any():
            output = self.advance(held[due])
        self.remember(memory)
        if len(output):  # frames without rows need not go back
            yield self.marked(output, False)

    def advance(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The step over the rows of each session in order, which leaves the sessions' new states."""
        rows = rows.sort_values(self.order, kind="mergesort", ignore_index=True)
        codes = np.zeros(len(rows), dtype=int) if self.key is None else pd.factorize(rows[self.key])[0]
        rows, codes = rows.take(np.argsort(codes, kind="stable")).reset_index(drop=True), np.sort(codes)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(rows)]
        names = [None] if self.key is None else named(rows[self.key].iloc[edges[:-1]])
        held, states = self.states.get(), {}
        if held:
            table = unpacked(bytes(held[0]))
            states = dict(zip(named(table["key"]), table["json"].tolist()))
        before = [json.loads(states.get(name, self.start)) for name in names]
        after, output = self.step.many(before, rows, edges) if isinstance(self.step, Together) else one_by_one(self.step, before, rows, edges)
        states.update((name, json.dumps(state)) for name, state in zip(names, after))
        self.states.update((packed(pd.DataFrame({"key": list(states), "json": list(states.values())})),))
        return output

    def arm(self, memory: dict, millis: int) -> bool:
        """A timer at the oldest buffered row, which fires once the watermark is beyond it; whether it is new."""
        if memory["timer"] is not None and millis >= memory["timer"]:
            return False
        if memory["timer"] is not None:
            self.handle.deleteTimer(memory["timer"])
        self.handle.registerTimer(millis)
        memory["timer"] = millis
        return True

    def memory(self) -> dict:
        known = self.value.get()
        return json.loads(known[0]) if known else {"timer": None}

    def remember(self, memory: dict) -> None:
        self.value.update((json.dumps(memory),))

    @staticmethod
    def marked(rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return plain(rows.assign(is_late=late))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, step: Callable, order: Sequence[str], start: dict, added: Sequence[tuple[str, T.DataType]],
             lateness: Lateness, key: str = "session_id", keep: Sequence[str] | None = None) -> DataFrame:
    """Apply a step to the rows of each key in event time: its output plus ``is_late``.

    ``order`` must agree with the event time.  Late rows pass by the step; they carry their own
    columns with the ``added`` ones null.  Rows come out once the watermark, which lags behind the
    newest row of the whole stream, is beyond them.  Keys are dealt by hash to ``lateness.shares`` keys of state.
    """
    names = stream.columns if keep is None else list(keep)
    fields = [f for f in stream.schema if f.name in names] + [T.StructField(n, t) for n, t in added]
    schema = T.StructType([*fields, T.StructField("is_late", T.BooleanType())])
    # The column that carries the watermark ends here, else Spark itself would drop late rows.
    timed = stream.withColumn(TIME, F.expr(lateness.event_time)).withWatermark(TIME, lateness.delay)
    # Null is a share of its own: among numbers it would make them floats.
    share = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(lateness.shares)).cast("int"))
    timed = timed.select(*stream.columns, F.unix_millis(F.col(TIME)).alias(MILLIS), share.alias(SHARE))

    class Step(OrderedSession):
        @staticmethod
        def marked(rows, late):
            absent = {n: pd.Series([None] * len(rows), dtype=object, index=rows.index) for n in schema.names if n not in rows.columns}
            return plain(rows.assign(**{**absent, "is_late": late})[schema.names])

    return timed.groupBy(SHARE).transformWithStateInPandas(
        statefulProcessor=Step(step, order, start, timed.columns, key), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


#: The step that changes nothing, for streams that only need order.
passed = Together(lambda states, rows, edges: (states, rows))


def late_counts(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, on_time, late): how many rows of each key the watermark let through and passed by."""
    return rows.groupBy(key).agg(F.count_if(~F.col("is_late")).alias("on_time"), F.count_if("is_late").alias("late"))


def windowed_counts(stream: DataFrame, lateness: Lateness, key: str = "session_id", width: str | None = None, slide: str | None = None,
                    gap: str | None = None, values: Sequence[Column] = ()) -> DataFrame:
    """Rows and ``values`` (aliased aggregates) per key and window, one row once the window is closed.

    With ``gap`` windows are sessions without a pause as long as it; else they have ``width``
    and start every ``slide`` (default: ``width``).  The watermark drops a window's state when
    it is behind it, so state holds open windows only.
    """
    if (gap is None) == (width is None):
        raise ValueError("give either width or gap")
    timed = stream.withColumn(TIME, F.expr(lateness.event_time)).withWatermark(TIME, lateness.delay)
    window = F.session_window(TIME, gap) if gap else F.window(TIME, width, slide or width)
    out = timed.groupBy(key, window.alias("_w")).agg(F.count(F.lit(1)).alias("n_rows"), *values)
    return out.select(key, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c not in (key, "_w")])


def latest_within(frames: DataFrame, audio: DataFrame, values: Sequence[str], lateness: Lateness, reach: str, key: str = "session_id") -> DataFrame:
    """Frames with the ``values`` of the newest audio row at most ``reach`` older than they are.

    Both streams have the key, ``t`` and ``id``; ``event_time`` makes a timestamp of a stream's
    ``t``.  A join of streams bounded by event time on both sides: an audio row is kept until no
    frame can reach back to it, a frame until no audio row for it can come in time, so either may
    arrive in a later micro-batch.  Of equal times the larger audio id counts.
    """
    left = frames.select(F.col(key).alias("_key"), F.col("t").alias("_t"), F.col("id").alias("_id"), F.expr(lateness.event_time).alias(TIME)).withWatermark(TIME, lateness.delay)
    right = audio.select(key, F.struct("t", "id").alias("_at"), F.struct(*values).alias("_values"), F.expr(lateness.event_time).alias("_heard")).withWatermark("_heard", lateness.delay)
    near = (F.col(key) == F.col("_key")) & (F.col("_heard") <= F.col(TIME)) & (F.col("_heard") >= F.col(TIME) - F.expr(f"INTERVAL {reach}"))
    met = left.join(right, near, "leftOuter")
    newest = met.groupBy(TIME, "_key", "_t", "_id").agg(F.max_by("_values", "_at").alias("_values"))
    return newest.select(F.col("_key").alias(key), F.col("_t").alias("t"), F.col("_id").alias("id"), *[F.col("_values")[v].alias(v) for v in values])
