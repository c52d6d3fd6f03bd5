"""Keyed recursions over sessions of any length.

Flags and levels, whose slices have short functions, take the passes of :mod:`.composed`.  The
others, filters of vectors, voice activity and tracking, go in rounds:

A recursion needs its rows in order, but not its whole session in one task.  A
session is cut into slices (``ordered.Timeline``), every slice is run at once from
a guessed entry state, and the exit states - one short row per slice - are then
compared: a slice whose true entry state differs from the one it was run with is
run again.  When no entry changes any more, the result is exactly the sequential
one: the first slice always starts right, and each other slice starts from the
verified exit of the one before.  Filters and gates forget their past within a
slice, so two rounds are usual; in the worst case the work is sequential but each
task still holds one slice only.  Keys that fit one slice take a single pass.

Per-slice states are cut with a reliable checkpoint each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.config import Config
from kinetable.operators import steps
from kinetable.operators.composed import BATCH, STATE, Composition, Contraction, Hysteresis, composed_fold, entries, in_order, whole_slices
from kinetable.operators.ordered import SLICE, Timeline
from kinetable.operators.windows import timeline
from kinetable.session import cut, staged


@dataclass(frozen=True)
class Recursion:
    """``run(state, rows)`` returns the exit state, output columns and extra slice facts."""

    start: tuple[float, ...]
    outputs: tuple[tuple[str, T.DataType], ...]
    run: Callable


def keyed_fold(df: DataFrame, line: Timeline, recursion: Recursion, with_slices: bool = False):
    """Rows of ``df`` with the recursion's outputs; optionally also the slice table.

    Pass only the columns the recursion reads plus what identifies a row.  A task
    streams over its sorted slices, so it holds one slice at a time.
    """
    data = line.sliced(df)
    group = line.group
    fields = {f.name: f.dataType for f in data.schema}
    entry_type = [T.StructField(c, fields[c]) for c in group]
    exit_schema = T.StructType([*entry_type, T.StructField("entry", STATE), T.StructField("exit", STATE), T.StructField("extra", STATE)])
    row_schema = T.StructType(list(df.schema) + [T.StructField(n, t) for n, t in recursion.outputs])
    start, run = list(recursion.start), recursion.run

    def entry_of(rows: pd.DataFrame) -> list[float]:
        state = rows["entry"].iloc[0] if "entry" in rows.columns else None
        return list(start) if state is None else list(state)

    def exits_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for rows in whole_slices(batches, group):
            entry = entry_of(rows)
            state, _, extra = run(entry, rows)
            done.append((*[rows[c].iloc[0] for c in group], entry, list(state), list(extra)))
            if len(done) >= BATCH:
                yield pd.DataFrame(done, columns=exit_schema.names)
                done = []
        if done:
            yield pd.DataFrame(done, columns=exit_schema.names)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, done, size = row_schema.names, [], 0
        for rows in whole_slices(batches, group):
            _, outputs, _ = run(entry_of(rows), rows)
            done.append(rows.assign(**outputs)[names])
            size += len(rows)
            if size >= BATCH:
                yield pd.concat(done)
                done, size = [], 0
        if done:
            yield pd.concat(done)

    def run_states(states: DataFrame) -> DataFrame:
        return in_order(data.join(states.select(*group, "entry"), group), group, line.order).mapInPandas(exits_of, exit_schema)

    empty_state = F.array(*[F.lit(float(s)) for s in start]).cast(STATE)
    over = Window.partitionBy(*line.key).orderBy(SLICE)
    slices = data.select(*group).distinct()
    slices = cut(slices.withColumn("_last", F.lead(SLICE).over(over).isNull()).withColumn("_first", F.lag(SLICE).over(over).isNull()))
    needed = slices if with_slices else slices.filter(~F.col("_last"))
    todo = needed.withColumn("entry", empty_state)
    if todo.isEmpty():  # every key fits one slice
        out = in_order(data, group, line.order).mapInPandas(rows_of, row_schema)
        return (out, todo.withColumn("extra", F.col("entry"))) if with_slices else out
    exits = cut(run_states(todo))
    while True:
        following = exits.withColumn("_true", F.coalesce(F.lag("exit").over(over), empty_state))
        stale = ~F.col("entry").eqNullSafe(F.col("_true"))
        changed = cut(following.filter(stale).select(*group, F.col("_true").alias("entry")))
        if changed.isEmpty():
            break
        exits = cut(exits.join(changed.select(*group), group, "left_anti").unionByName(run_states(changed)))
    carried = exits.select(*group, F.col("exit").alias("entry"))
    entries = (
        slices.join(carried, group, "left")
        .withColumn("entry", F.lag("entry").over(over))
        .filter(~F.col("_first"))
        .select(*group, "entry")
    )
    out = in_order(data.join(entries, group, "left"), group, line.order).mapInPandas(rows_of, row_schema)
    return (out, exits) if with_slices else out


def _doubles(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=float, na_value=np.nan)


def quality_state(df: DataFrame, cfg: Config, line: Timeline | None = None, score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add ``is_valid``: quality with hysteresis, per face."""
    line = line or timeline(cfg, ("session_id", "face_id"))
    t, flag = line.order[0], Hysteresis(cfg.span(cfg.quality_min_s))

    def marks(rows):
        level, bad = _doubles(rows[score]), rows[rejected].to_numpy(bool)
        up, down = (level >= cfg.quality_enter) & ~bad, (level < cfg.quality_exit) | bad
        return rows[t].to_numpy(), np.flatnonzero(up), np.flatnonzero(down)

    def run(state, rows):
        _, at = flag.flips(state, *marks(rows))
        turned = np.zeros(len(rows), dtype=int)
        turned[at] = 1
        return {"is_valid": (np.cumsum(turned) + int(state[0])) % 2 == 1}

    how = Composition((0.0, 0.0), (("is_valid", T.BooleanType()),), lambda rows: flag.of_rows(*marks(rows)), flag.compose, flag.apply, run)
    return composed_fold(df, line, how)


def one_euro(df: DataFrame, cfg: Config, cols: list[str], line: Timeline | None = None, prefix: str = "smooth_") -> DataFrame:
    """Smooth scalar or array columns together; outputs ``smooth_<name>``."""
    line = line or timeline(cfg, ("session_id", "face_id"))
    t = line.order[0]
    arrays = {c: isinstance(df.schema[c].dataType, T.ArrayType) for c in cols}

    def run(state, rows):
        parts = [np.stack(rows[c].to_numpy()).astype(float) if arrays[c] else _doubles(rows[c])[:, None] for c in cols]
        exit_state, smooth = steps.one_euro(state, rows[t].to_numpy(), np.hstack(parts), cfg)
        out, at = {}, 0
        for c, part in zip(cols, parts):
            width = part.shape[1]
            block = smooth[:, at : at + width]
            out[prefix + c] = list(block) if arrays[c] else block[:, 0]
            at += width
        return exit_state, out, []

    outputs = tuple((prefix + c, STATE if arrays[c] else T.DoubleType()) for c in cols)
    return keyed_fold(df, line, Recursion((), outputs, run))


def clean_layer(df: DataFrame, cfg: Config, line: Timeline | None = None) -> DataFrame:
    """The smoothed sibling of raw observations.

    Reads ``landmarks``, ``channels`` (arrays, channels in sorted-name order) and
    ``pose`` (pitch, yaw, roll, tx, ty, tz); raw columns stay as they are.
    """
    out = one_euro(df, cfg, ["landmarks", "channels", "pose"], line, "clean_")
    return out.withColumns(
        {
            "clean_channels": F.transform(
                "clean_channels", lambda x: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 5)
            ),
            "clean_pose": F.transform(
                "clean_pose", lambda x, i: F.when(i < 3, F.bround(x, 2)).otherwise(F.bround(x, 3))
            ),
            "is_observed": F.lit(True),
            "is_reconstructed": F.lit(False),
        }
    )


def vad(df: DataFrame, cfg: Config, line: Timeline | None = None) -> DataFrame:
    """Add ``is_speech`` and ``vad_confidence`` to audio slices with ``rms`` and ``zcr``.

    With a ``spectral`` array of 64 bands, slices dominated by extreme bands are vetoed.
    """
    line = line or timeline(cfg, order=("t", "slice_idx"))
    t = line.order[0]
    banded = "spectral" in df.columns
    if banded:
        def mean(first, count):
            return F.aggregate(F.slice("spectral", first, count), F.lit(0.0), lambda a, x: a + x) / count

        full = F.size("spectral") == 64
        df = df.withColumns(
            {"_core": F.when(full, mean(5, 42)), "_extreme": F.when(full, (mean(1, 3) + mean(53, 12)) / 2.0)}
        )

    def run(state, rows):
        columns = {"t": rows[t].to_numpy(), "rms": _doubles(rows["rms"]), "zcr": _doubles(rows["zcr"])}
        if banded:
            columns |= {"core": _doubles(rows["_core"]), "extreme": _doubles(rows["_extreme"])}
        exit_state, out = steps.vad(state, columns, cfg)
        return exit_state, out, []

    outputs = (("is_speech", T.BooleanType()), ("vad_confidence", T.DoubleType()))
    out = keyed_fold(df, line, Recursion((cfg.vad_floor_start, -1.0), outputs, run))
    return out.drop("_core", "_extreme")


def stored_audio(df: DataFrame) -> DataFrame:
    """Audio rows as stored: energy with 5 digits, confidence with 3."""
    return df.withColumns(
        {"energy_rms": F.bround(F.coalesce("rms", F.lit(0.0)), 5), "vad_confidence": F.bround("vad_confidence", 3)}
    )


def _level(df: DataFrame, line: Timeline, value: str, name: str, start: tuple[float, ...], step: Callable) -> DataFrame:
    """A level that follows a column by ``step``, a monotone contraction."""
    bounds = df.agg(F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))).first()
    seen = [x for x in (*bounds, *start) if x is not None] or [0.0]
    level = Contraction(step, min(seen), max(seen))

    def run(state, rows):
        return {name: step(state, _doubles(rows[value]))[1]}

    def summary(rows):
        return level.of_rows(_doubles(rows[value]))

    return composed_fold(df, line, Composition(start, ((name, T.DoubleType()),), summary, level.compose, level.apply, run))


def attack_release(df: DataFrame, line: Timeline, value: str, name: str = "envelope", rise: float = 0.65, fall: float = 0.25,
                   start: float | None = None) -> DataFrame:
    """Attack/release envelope; starts at the first value unless ``start`` is given."""
    return _level(df, line, value, name, () if start is None else (start,), lambda state, x: steps.attack_release(state, x, rise, fall))


def ema(df: DataFrame, line: Timeline, value: str, name: str = "ema", alpha: float = 0.1, start: float = 30.0) -> DataFrame:
    return _level(df, line, value, name, (start,), lambda state, x: steps.ema(state, x, alpha))


def adaptive_peak(df: DataFrame, line: Timeline, value: str, name: str = "peak", start: float = 0.04) -> DataFrame:
    """Slowly decaying peak.  It jumps at a row's value, so it is no monotone map, and goes in rounds."""

    def run(state, rows):
        exit_state, out = steps.adaptive_peak(state, _doubles(rows[value]))
        return exit_state, {name: out}, []

    return keyed_fold(df, line, Recursion((start,), ((name, T.DoubleType()),), run))


def track(detections: DataFrame, cfg: Config, line: Timeline | None = None, frame: str = "frame_idx") -> DataFrame:
    """Add ``face_id`` and ``hits`` to detections with ``cx``, ``cy``, in frames.

    Inside a slice the tracks alive at entry are known by their slot only, so a
    slice depends on where they are, not on their numbers; numbers are given in a
    second step over the slice table, by composing the slices' renamings.
    """
    line = line or timeline(cfg, order=("t", "det_idx"))
    group = line.group

    def run(state, rows):
        # State: cx, cy, missed per live track, in age order.
        slots = [state[i : i + 3] for i in range(0, len(state), 3)]
        entry = [0.0]
        for j, (cx, cy, missed) in enumerate(slots):
            entry += [-(j + 1.0), cx, cy, missed, 0.0]
        number, spots = rows[frame].to_numpy(), list(zip(rows["cx"].tolist(), rows["cy"].tolist()))
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(spots)]
        frames = [spots[i:j] for i, j in zip(cuts, cuts[1:])]
        end, labels = steps.track(entry, frames, cfg)
        flat = [pair for faces in labels for pair in faces]
        live = [end[i : i + 5] for i in range(1, len(end), 5)]
        extra = [end[0]] + [v for tr in live for v in (tr[0], tr[4])]
        out = {"_local": [p[0] for p in flat], "_hits": [p[1] for p in flat]}
        return [v for tr in live for v in tr[1:4]], out, extra

    recursion = Recursion((), (("_local", T.LongType()), ("_hits", T.LongType())), run)
    rows, slices = keyed_fold(detections, line, recursion, with_slices=True)
    # A slice renames the slots it finds: births, then the number and hits of each track it leaves,
    # numbers below 0 for slots.  Renamings compose, so numbers need no group by session.
    names = entries(staged(slices.select(*group, F.col("extra").alias("f"))), line, [0.0], renamed_twice, lambda r, known: renamed_twice(known, r or [0.0]))
    numbered = line.sliced(rows).join(names, group)
    old, slot = F.col("_local") < 0, (-F.col("_local") - 1).cast("int")
    number, seen = (F.get("entry", 2 * slot + k) for k in (1, 2))
    return numbered.select(
        *detections.columns,
        F.when(old, number.cast("long")).otherwise(F.col("entry")[0].cast("long") + F.col("_local")).alias("face_id"),
        (F.col("_hits") + F.when(old, seen).otherwise(0.0)).cast("long").alias("hits"),
    )


def renamed_twice(first: list[float], second: list[float]) -> list[float]:
    """Slot renamings one after the other: ``[births, number, hits, number, hits, ...]``."""
    out = [first[0] + second[0]]
    for number, hits in zip(second[1::2], second[2::2]):
        if number < 0:
            slot = int(-number - 1)
            out += [first[1 + 2 * slot], hits + first[2 + 2 * slot]]
        else:
            out += [first[0] + number, hits]
    return out
