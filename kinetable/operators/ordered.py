"""Ordered work over sessions of any length.

A window over ``partitionBy(session)`` sorts a whole session in one task, which
fails once one session holds a large share of all rows.  Everything here cuts a
session into slices of bounded extent along its order column, works inside the
slices in parallel, and passes what a slice needs from earlier (or later) ones
through a small table with one row per slice:

* ``scan``      cumulative sum / max / min and the row before, across slice borders
* ``with_halo`` copies border rows into the neighbouring slices so that bounded
  frames (last 30 rows, last 0.4 s, next L rows) are complete in each slice
* ``spread``    joins a per-key value to rows on (key, slice), so that a hot key
  is spread over its slices
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged

SLICE = "_slice"
SUPER = "_super"
SUPER_WIDTH = 4096
SLICE_ROWS = 200_000

MERGES = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Timeline:
    """Rows of one ``key`` in ``order``; with a key, the first order column is numeric.

    ``width`` is the extent of a slice in units of that column; the order columns
    together must be unique within the key.  An empty key means one global order, which
    is cut by row counts where rows are only numbered (:func:`positions`).
    """

    key: tuple[str, ...]
    order: tuple[str, ...]
    width: float

    def sliced(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, slice_of(F.col(self.order[0]), self.width))

    @property
    def group(self) -> list[str]:
        return [*self.key, SLICE]

    def rows(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def position(self) -> Column:
        return F.struct(*self.order)


def slice_of(position: Column, width: float) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _merge_pair(kind: str, first: Column, second: Column) -> Column:
    if kind == "sum":
        return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))
    return F.greatest(first, second) if kind == "max" else F.least(first, second)


def carried(table: DataFrame, key: tuple[str, ...], kinds: Mapping[str, str], backward: bool = False) -> DataFrame:
    """Exclusive prefix (or suffix) merge of a slice table, one row per (key, slice)."""

    def beyond(window):
        bounds = (1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)
        return window.rowsBetween(*bounds)

    if key:
        window = beyond(Window.partitionBy(*key).orderBy(SLICE))
        return table.select(*key, SLICE, *[MERGES[k](F.col(n)).over(window).alias(n) for n, k in kinds.items()])
    # One global order: a second level keeps every window small.
    table = table.withColumn(SUPER, F.floor(F.col(SLICE) / SUPER_WIDTH))
    top = table.groupBy(SUPER).agg(*[MERGES[k](n).alias(n) for n, k in kinds.items()])
    over_top = beyond(Window.orderBy(SUPER))
    top = top.select(SUPER, *[MERGES[k](F.col(n)).over(over_top).alias("_top_" + n) for n, k in kinds.items()])
    inside = beyond(Window.partitionBy(SUPER).orderBy(SLICE))
    return table.join(top, SUPER).select(
        SLICE,
        *[_merge_pair(k, F.col("_top_" + n), MERGES[k](F.col(n)).over(inside)).alias(n) for n, k in kinds.items()],
    )


def scan(
    df: DataFrame,
    line: Timeline,
    run: Mapping[str, tuple[str, Column]] | None = None,
    prev: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Add cumulative values and values of the preceding row in one pass.

    ``run``: ``{name: ("sum" | "max" | "min", expression)}``; ``max``/``min`` work on
    structs too, so "last non-null value" is the max of ``struct(order..., value)``.
    ``prev``: ``{name: expression}``, null on the first row of a key.

    The input is read twice: once for the slice table (partial aggregates, a tiny
    shuffle) and once for the rows, which are shuffled by (key, slice) only.
    """
    run, prev = run or {}, prev or {}
    data = line.sliced(df)
    for name, (_, expr) in run.items():
        data = data.withColumn("_in_" + name, expr)
    kinds = {name: kind for name, (kind, _) in run.items()}
    parts = [MERGES[k]("_in_" + n).alias(n) for n, k in kinds.items()]
    if prev:
        data = data.withColumn("_row", F.struct(*[expr.alias(n) for n, expr in prev.items()]))
        parts.append(F.max(F.struct(*line.order, F.col("_row").alias("_row"))).alias("_tail"))
    table = data.groupBy(*line.group).agg(*parts)
    # The newest row of all earlier slices is the preceding row: one more maximum.
    merged = {**kinds, **({"_tail": "max"} if prev else {})}
    carry = carried(table, line.key, merged, backward).select(*line.group, *[F.col(n).alias("_carry_" + n) for n in merged])
    if backward:
        local = line.rows().rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    else:
        local = line.rows().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = data.join(carry, line.group)
    for name, kind in kinds.items():
        out = out.withColumn(
            name, _merge_pair(kind, F.col("_carry_" + name), MERGES[kind](F.col("_in_" + name)).over(local))
        )
    if prev:
        before = F.coalesce(F.lag("_row").over(line.rows()), F.col("_carry__tail._row"))
        out = out.withColumn("_before", before)
    return out.select(*df.columns, *kinds, *[F.col("_before")[n].alias(n) for n in prev])


def running(df: DataFrame, line: Timeline, specs: Mapping[str, tuple[str, Column]], inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Cumulative values only, see :func:`scan`."""
    return scan(df, line, run=specs, inclusive=inclusive, backward=backward)


def previous(df: DataFrame, line: Timeline, values: Mapping[str, Column]) -> DataFrame:
    """Values of the preceding row only, see :func:`scan`."""
    return scan(df, line, prev=values)


def positions(df: DataFrame, order: Sequence[str], name: str = "idx", rows: int = SLICE_ROWS) -> DataFrame:
    """Zero-based position of each row in one global order of any orderable columns.

    Range partitioning samples the rows, so that every part holds about ``rows`` of them
    whatever the values are; a part's rows are numbered after those of the parts before.
    """
    data = staged(df)
    parts = max(1, -(-data.count() // rows))
    laid = data.repartitionByRange(parts, *order).withColumn(SLICE, F.spark_partition_id())
    laid = staged(laid)
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes = laid.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
    bases = F.broadcast(sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order)) - 1
    return laid.withColumn("_at", inside).join(bases, SLICE).select(*df.columns, (F.col("_base") + F.col("_at")).alias(name))


def key_positions(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "idx", rows: int = SLICE_ROWS) -> DataFrame:
    """Zero-based position of each row among those of its key, in the order of any orderable columns.

    Range partitioning by key and order cuts where rows are many, not at fixed extents; a part
    of a key is numbered after the key's parts before it.
    """
    data = staged(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-data.count() // rows))
    laid = staged(data.repartitionByRange(parts, *key, *order).withColumn(SLICE, F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes = laid.groupBy(*key, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.select(*key, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*key, SLICE).orderBy(*order)) - 1
    return laid.withColumn("_at", inside).join(bases, [*key, SLICE]).select(*df.columns, (F.col("_base") + F.col("_at")).alias(name))


def row_index(df: DataFrame, line: Timeline, name: str = "idx") -> DataFrame:
    """Zero-based position of each row in its key's order (global if the key is empty)."""
    if not line.key:
        return positions(df, line.order, name)
    return running(df, line, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def with_halo(df: DataFrame, position: Column, width: float, before: float = 0, after: float = 0) -> DataFrame:
    """Copy rows into every slice whose rows look at them.

    A row is visible to rows at most ``before`` later and ``after`` earlier.  The
    copy in a row's own slice has ``_home`` true; keep only those after the window.
    """
    first = slice_of(position - F.lit(after), width)
    last = slice_of(position + F.lit(before), width)
    return df.withColumn(SLICE, F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col(SLICE) == slice_of(position, width)
    )


def spread(df: DataFrame, line: Timeline, per_key: DataFrame, how: str = "inner", base: DataFrame | None = None) -> DataFrame:
    """Join one row per key to the rows of ``df`` over (key, slice).

    ``base`` is a cheaper table with the same keys and positions, if there is one.
    """
    slices = line.sliced(df if base is None else base).select(*line.group).distinct()
    return line.sliced(df).join(slices.join(per_key, list(line.key), how), line.group).drop(SLICE)


def dense_window(df: DataFrame, line: Timeline, width: int, before: int = 0, after: int = 0, index: str = "_idx"):
    """Index the rows, then lay row-count slices with halos; returns (rows, window)."""
    indexed = row_index(df, line, index)
    haloed = with_halo(indexed, F.col(index), width, before, after)
    return haloed, Window.partitionBy(*line.key, SLICE).orderBy(index)


def home_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.filter("_home").drop(SLICE, "_home", *extra)
