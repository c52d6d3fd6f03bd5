"""Recursions whose slices can be summed up, so that all of them are entered in one pass.

What a run of rows does to the state it finds is a function of that state.  Where such functions
have a short form and compose, nothing needs to be guessed and run again: every slice gives its
function (one short row), a prefix of compositions gives each slice its true entry, and one more
pass makes the rows.  The number of passes is the same for two slices and for ten thousand.

* Averages and attack/release envelopes are monotone contractions of their level, also in rounded
  arithmetic.  If the least and the greatest level there can be lead to the same number, bit for
  bit, every level in between does: the function is a constant.  Until then it is kept as the few
  values themselves.  So results are exactly the sequential ones.
* The quality flag is an automaton of two states with a time of its last change.  Entered bad, a
  slice has one exit.  Entered good, its exit depends on that time only through the first row
  that may turn it bad, one of those within the hold time and one beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.ordered import SLICE, SUPER, SUPER_WIDTH, Timeline
from kinetable.session import staged

STATE = T.ArrayType(T.DoubleType())
BATCH = 20_000


def whole_slices(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted batches at slice borders; a slice spanning batches is put together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        columns = [batch[c].to_numpy() for c in group]
        change = np.zeros(len(batch), bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        if held:
            change[0] = any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in group)
        starts = np.flatnonzero(change).tolist()
        if not held and (not starts or starts[0] != 0):
            starts = [0, *starts]
        if held and (not starts or starts[0] != 0):
            held.append(batch.iloc[: starts[0] if starts else len(batch)])
        for first, last in zip(starts, [*starts[1:], len(batch)]):
            if held:
                yield held[0] if len(held) == 1 else pd.concat(held)
            held = [batch.iloc[first:last]]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


class Contraction:
    """Monotone contractions of a level: ``[1, exit]`` if it doesn't depend on the entry, else ``[0, value, ...]``.

    ``step(state, values)`` returns the exit state and the levels; ``low`` and ``high`` bound
    all values and the start, hence all levels.
    """

    def __init__(self, step: Callable, low: float, high: float):
        self.step, self.low, self.high = step, low, high

    def settled(self, values: np.ndarray) -> float | None:
        one, two = (self.step([x], values)[0][0] for x in (self.low, self.high))
        return one if one == two or (np.isnan(one) and np.isnan(two)) else None

    def of_rows(self, values: np.ndarray, block: int = 256) -> list[float]:
        """Looks at the end first: once that doesn't depend on its entry, what came before doesn't matter."""
        while True:
            level = self.settled(values[-block:])
            if level is not None:
                return [1.0, float(level)]
            if block >= len(values):
                return [0.0, *values.tolist()]
            block *= 2

    def apply(self, f: Sequence[float], state: Sequence[float]) -> list[float]:
        return [float(f[1])] if f[0] else self.step(list(state), np.asarray(f[1:], dtype=float))[0]

    def compose(self, f: Sequence[float], g: Sequence[float]) -> list[float]:
        if g[0]:
            return list(g)
        if f[0]:
            return [1.0, *self.apply(g, [f[1]])]
        return self.of_rows(np.array([*f[1:], *g[1:]], dtype=float))


class Hysteresis:
    """Exits of the two-state flag: ``[good, changed of the exit if entered bad, then (limit, good, changed) ...]``.

    Entered good since ``c``, the first triple with ``c <= limit`` is the exit; without one the
    flag stays as it was.
    """

    def __init__(self, hold: float):
        self.hold = hold

    def flips(self, state: Sequence[float], t: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[list[float], list[int]]:
        """The exit state and the rows at which the flag changes; ``up`` and ``down`` are row numbers."""
        good, changed, at, out = bool(state[0]), state[1], 0, []
        down_times = t[down]
        while True:
            if good:
                k = max(np.searchsorted(down, at), np.searchsorted(down_times, changed + self.hold))
                # Rounding may put a row just short of its hold time, seen from the other side.
                while k > 0 and down[k - 1] >= at and t[down[k - 1]] - changed >= self.hold:
                    k -= 1
                while k < len(down) and t[down[k]] - changed < self.hold:
                    k += 1
                if k == len(down):
                    return [1.0, float(changed)], out
                row = int(down[k])
            else:
                k = np.searchsorted(up, at)
                if k == len(up):
                    return [0.0, float(changed)], out
                row = int(up[k])
            good, changed, at = not good, t[row], row + 1
            out.append(row)

    def of_rows(self, t: np.ndarray, up: np.ndarray, down: np.ndarray) -> list[float]:
        f, _ = self.flips([0.0, 0.0], t, up, down)
        entry_bad_stays = not len(up)
        out = [f[0], np.nan if entry_bad_stays else f[1]]  # not a number: as at entry
        following: dict[int, list[float]] = {}
        for row in down:
            # The flag turns bad here; what follows depends only on the next row that turns it good.
            nxt = int(np.searchsorted(up, row + 1))
            if nxt not in following:
                # Nothing turns it good any more: it stays bad since this row, each row for itself.
                following[nxt] = self.flips([0.0, t[row]], t[row + 1 :], up[up > row] - row - 1, down[down > row] - row - 1)[0] if nxt < len(up) else []
            always = t[row] - t[0] >= self.hold  # the last change lies before the slice
            out += [np.inf if always else float(t[row]), *(following[nxt] or [0.0, float(t[row])])]
            if always:
                break
        return out

    def apply(self, f: Sequence[float], state: Sequence[float]) -> list[float]:
        good, changed = state
        if not good:
            return [float(f[0]), float(changed if np.isnan(f[1]) else f[1])]
        for i in range(2, len(f), 3):
            if f[i] - changed >= self.hold:
                return [float(f[i + 1]), float(f[i + 2])]
        return [1.0, float(changed)]

    def compose(self, f: Sequence[float], g: Sequence[float]) -> list[float]:
        if f[0] or not np.isnan(f[1]):
            out = self.apply(g, [f[0], f[1]])
        else:
            out = [g[0], g[1]]
        limits = []
        for i in range(2, len(f), 3):
            limits += [f[i], *self.apply(g, f[i + 1 : i + 3])]
        if len(f) == 2 or f[-3] != np.inf:
            limits += list(g[2:])
        return [*out, *limits]


@dataclass(frozen=True)
class Composition:
    """``summary(rows)`` is a slice's function; ``run(state, rows)`` its output columns from a known entry."""

    start: tuple[float, ...]
    outputs: tuple[tuple[str, T.DataType], ...]
    summary: Callable[[pd.DataFrame], list[float]]
    compose: Callable[[Sequence[float], Sequence[float]], list[float]]
    apply: Callable[[Sequence[float], Sequence[float]], list[float]]
    run: Callable[[list[float], pd.DataFrame], dict]


def in_order(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted by group, every group in one task.

    The shuffle goes by a hash of its own.  One by the columns themselves is left out as redundant if
    a join by them came before, and that join, once broadcast, may split a group over tasks.
    """
    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)


def _in_batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _walk(batches: Iterator[pd.DataFrame], by: list[str], start: Callable, step: Callable) -> Iterator[tuple]:
    """(row, state before, state after, whether it is the last of its key), holding one row."""
    name, state, held = None, None, None
    for batch in batches:
        for row in batch.to_dict("records"):
            mine = tuple(row[c] for c in by)
            if mine != name:
                if held is not None:
                    yield (*held, True)
                state, name = start(row), mine
            elif held is not None:
                yield (*held, False)
            after = step(state, list(row["f"]))
            held = (row, state, after)
            state = after
    if held is not None:
        yield (*held, True)


def entries(table: DataFrame, line: Timeline, start: Sequence[float], compose: Callable, apply: Callable) -> DataFrame:
    """(key, slice, ``entry``): the state at each slice's entry, from a staged table (key, slice, ``f``) of functions.

    A prefix of compositions on two levels: slices are composed within groups of some thousands,
    the groups are walked per key, and the slices once more from their group's entry.  A task
    streams over its sorted rows and holds one.
    """
    group, upper = line.group, [*line.key, SUPER]
    table = table.select(*group, "f", F.floor(F.col(SLICE) / SUPER_WIDTH).alias(SUPER))
    kinds, first = {f.name: f.dataType for f in table.schema}, list(start)

    def schema(columns: list[str], name: str) -> T.StructType:
        return T.StructType([*[T.StructField(c, kinds[c]) for c in columns], T.StructField(name, STATE)])

    def composed(batches):
        rows = _walk(batches, upper, lambda _: None, lambda state, f: f if state is None else compose(state, f))
        yield from _in_batches(((*[row[n] for n in upper], after) for row, _, after, last in rows if last), [*upper, "f"])

    def entered(batches, by, names, begin):
        rows = _walk(batches, by, begin, lambda state, f: apply(f, state))
        yield from _in_batches(((*[row[n] for n in names], before) for row, before, _, _ in rows), [*names, "entry"])

    tops = in_order(table, upper, [SLICE]).mapInPandas(composed, schema(upper, "f"))
    tops = in_order(tops, list(line.key), [SUPER]).mapInPandas(lambda b: entered(b, list(line.key), upper, lambda _: first), schema(upper, "entry"))
    return in_order(table.join(tops, upper), upper, [SLICE]).mapInPandas(
        lambda b: entered(b, upper, group, lambda row: list(row["entry"])), schema(group, "entry"))


def composed_fold(df: DataFrame, line: Timeline, how: Composition) -> DataFrame:
    """Rows of ``df`` with the outputs of the recursion, see the module.

    Pass only the columns that the recursion reads and those that tell rows apart.
    """
    data, group = line.sliced(df), line.group
    kinds = {f.name: f.dataType for f in data.schema}

    def summaries(batches):
        rows = ((*[s[c].iloc[0] for c in group], how.summary(s)) for s in whole_slices(batches, group))
        yield from _in_batches(rows, [*group, "f"])

    summary = T.StructType([*[T.StructField(c, kinds[c]) for c in group], T.StructField("f", STATE)])
    table = staged(in_order(data, group, list(line.order)).mapInPandas(summaries, summary))
    states = entries(table, line, how.start, how.compose, how.apply)
    row_schema = T.StructType(list(df.schema) + [T.StructField(n, t) for n, t in how.outputs])

    def outputs(batches):
        done, size = [], 0
        for rows in whole_slices(batches, group):
            done.append(rows.assign(**how.run(list(rows["entry"].iloc[0]), rows))[row_schema.names])
            size += len(rows)
            if size >= BATCH:
                yield pd.concat(done)
                done, size = [], 0
        if done:
            yield pd.concat(done)

    return in_order(data.join(states, group), group, list(line.order)).mapInPandas(outputs, row_schema)
