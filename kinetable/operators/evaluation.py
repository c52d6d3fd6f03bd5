"""Splits, prediction metrics, loss terms, augmentation and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.anatomy import CHANNELS, channel_weights
from kinetable.operators.ordered import SLICE, Timeline, home_rows, row_index, with_halo

#: Bits of the hash that each of the two counts resolves.
BITS = 16


def hash_rank(key: Sequence[str], seed: int) -> Column:
    """A reproducible 60-bit rank of a row from its key columns."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split(df: DataFrame, key: Sequence[str], ratio: float = 0.15, seed: int = 42, by: Sequence[str] | None = None) -> DataFrame:
    """Add ``is_train``; exactly ``int(N * ratio)`` rows are validation rows.

    Rows are ranked by a hash of ``key``.  Counts by the hash's first bits, then by the
    next ones within one bucket, find the border up to some 2 ** -32 of the rows, and only
    those are ordered.  With ``by`` the columns of ``by`` (for example the session) are
    split instead, and rows follow them.
    """
    if by is not None:
        groups = split(df.select(*by).distinct(), by, ratio, seed)
        return df.join(groups, list(by))
    ranked = df.withColumn("_h", hash_rank(key, seed))
    keys = ranked.select("_h", *key)

    def border(rows: DataFrame, want: DataFrame, level: int) -> DataFrame:
        """One row: prefix of the hash that holds the wanted rank, and the rank inside it."""
        counts = rows.groupBy(F.shiftright("_h", 60 - level * BITS).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** BITS rows
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).crossJoin(F.broadcast(want))
        hit = (F.col("_before") <= F.col("_want")) & (F.col("_want") < F.col("_before") + F.col("_c"))
        return counts.filter(hit).select(F.col("_b").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_want"))

    total = keys.agg(F.floor(F.count(F.lit(1)) * ratio).alias("_want"))
    first = border(keys, total, 1)
    inner = keys.join(F.broadcast(first.select("_edge")), F.shiftright("_h", 60 - BITS) == F.col("_edge"))
    second = border(inner.drop("_edge"), first.select("_want"), 2)
    # The last validation row of the border: the only rows that are ordered.
    place = F.struct("_h", *key)
    edge = keys.join(F.broadcast(second), F.shiftright("_h", 60 - 2 * BITS) == F.col("_edge"))
    last = edge.withColumn("_r", F.row_number().over(Window.orderBy("_h", *key))).filter(F.col("_r") == F.col("_want"))
    # One row even without a border, which is beyond the last row if all rows are validation rows.
    bounds = second.agg(F.max("_edge").alias("_edge")).crossJoin(F.broadcast(last.agg(F.max(place).alias("_last"))))
    placed = ranked.crossJoin(F.broadcast(bounds))  # one row
    prefix = F.shiftright("_h", 60 - 2 * BITS)
    at_edge = F.coalesce(place > F.col("_last"), F.lit(True))
    is_train = F.when(F.col("_edge").isNull(), False).when(prefix == F.col("_edge"), at_edge).otherwise(prefix > F.col("_edge"))
    return placed.select(*df.columns, is_train.alias("is_train"))


def eval_segment(df: DataFrame, line: Timeline, is_val: Column, frames: int = 400, spare: int = 64) -> DataFrame:
    """``min(frames, n_val - spare)`` consecutive rows from the first validation row; none if too few."""
    rows = row_index(df.withColumn("_val", is_val), line, "_i")
    bounds = rows.agg(F.count_if("_val").alias("_n"), F.min(F.when(F.col("_val"), F.col("_i"))).alias("_from"))
    length = F.when(F.col("_n") < spare, 0).otherwise(F.least(F.lit(frames), F.col("_n") - spare))
    inside = (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_from") + F.col("_len"))
    return rows.crossJoin(F.broadcast(bounds.withColumn("_len", length))).filter(inside).select(*df.columns)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def accuracy(df: DataFrame, pred: str = "pred_bs", target: str = "target_bs", names: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean absolute error overall and of the jaw, jaw correlation, range of the predictions."""
    jaw = list(names).index("jawOpen")
    p, g = F.col(pred)[jaw].cast("double"), F.col(target)[jaw].cast("double")
    errors = F.zip_with(pred, target, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    moving = (F.stddev_pop(p) > 1e-6) & (F.stddev_pop(g) > 1e-6)
    return df.agg(
        (F.sum(_total(errors)) / F.sum(F.size(pred))).alias("mae"),
        F.avg(F.abs(p - g)).alias("mae_jaw"),
        F.when(moving, F.corr(p, g)).otherwise(F.lit(0.0)).alias("corr_jaw"),
        F.min(F.array_min(pred)).cast("double").alias("min"),
        F.max(F.array_max(pred)).cast("double").alias("max"),
    )


def smooth_l1(a: Column, b: Column, beta: float) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, d * d * 0.5 / beta).otherwise(d - 0.5 * beta)


# Weights of the loss terms; the training run lowers two of them.
LOSS_WEIGHTS = {"recon": 1.0, "cos": 0.8, "vel": 0.6, "acc": 0.3, "dental": 0.4, "tongue": 0.4, "pose": 0.4, "pose_vel": 0.25}
TRAINING_LOSS_WEIGHTS = {**LOSS_WEIGHTS, "vel": 0.5, "dental": 0.3}
ACTIVE_BOOST, TONGUE_LIMIT = 3.0, 0.05


def animation_loss(
    df: DataFrame,
    weights: dict[str, float] = LOSS_WEIGHTS,
    names: Sequence[str] = CHANNELS,
    key: str = "seq_id",
    t: str = "t",
    group: Sequence[str] = (),
    width: int = 4096,
) -> DataFrame:
    """The loss terms and their weighted total over all rows (or per ``group``).

    Columns: ``pred_bs``/``target_bs``, ``pred_dental``/``target_dental`` and
    ``pred_pose``/``target_pose`` arrays of rows (key, t) with t = 0, 1, ... in each
    sequence.  Channel groups are found by name in ``names``.
    """
    rank = {n: i for i, n in enumerate(CHANNELS)}
    fixed = channel_weights()
    factor = F.array(*[F.lit(fixed[rank[n]]) for n in names])
    mouth = [i for i, n in enumerate(names) if 14 <= rank[n] <= 40]
    tongue = list(names).index("tongueOut")
    vectors = ["pred_bs", "target_bs", "pred_dental", "target_dental", "pred_pose", "target_pose"]
    rows = df.select(*dict.fromkeys([*group, key, t]), *[F.col(v).cast("array<double>").alias(v) for v in vectors])
    rows = with_halo(rows, F.col(t), width, before=2)
    order = Window.partitionBy(key, SLICE).orderBy(t)

    def minus(a, b):
        return F.zip_with(a, b, lambda x, y: x - y)

    def gap(a, b):
        return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

    for v in ("pred_bs", "target_bs", "pred_pose", "target_pose"):
        rows = rows.withColumn("v_" + v, F.when(F.lag(v).over(order).isNotNull(), minus(F.col(v), F.lag(v).over(order))))
    for v in ("pred_bs", "target_bs"):
        rows = rows.withColumn("a_" + v, F.when(F.lag("v_" + v).over(order).isNotNull(), minus(F.col("v_" + v), F.lag("v_" + v).over(order))))
    rows = home_rows(rows)

    huber = F.zip_with(
        F.zip_with("pred_bs", "target_bs", lambda p, g: smooth_l1(p, g, 0.02) * (1.0 + ACTIVE_BOOST * g)), factor, lambda x, w: x * w
    )

    def pick(v):
        return [F.col(v)[i] + 1e-6 for i in mouth]

    p, g = pick("pred_bs"), pick("target_bs")
    dot = sum(a * b for a, b in zip(p, g))
    norms = F.greatest(F.sqrt(sum(a * a for a in p)), F.lit(1e-8)) * F.greatest(F.sqrt(sum(b * b for b in g)), F.lit(1e-8))
    tp, tg = F.col("pred_bs")[tongue], F.col("target_bs")[tongue]
    spurious = F.when(tg < TONGUE_LIMIT, F.greatest(tp - TONGUE_LIMIT, F.lit(0.0))).otherwise(F.lit(0.0))
    active = F.when(tg >= TONGUE_LIMIT, F.abs(tp - tg)).otherwise(F.lit(0.0))

    def l1(a, b, beta):
        return _total(F.zip_with(a, b, lambda x, y: smooth_l1(x, y, beta)))

    parts = {
        "recon": (_total(huber), F.size("pred_bs")),
        "cos": (1.0 - dot / norms, F.lit(1)),
        "vel": (gap("v_pred_bs", "v_target_bs"), F.size("v_pred_bs")),
        "acc": (gap("a_pred_bs", "a_target_bs"), F.size("a_pred_bs")),
        "dental": (l1("pred_dental", "target_dental", 0.02), F.size("pred_dental")),
        "tongue": (spurious * 2.5 + active * 1.5, F.lit(1)),
        "pose": (l1("pred_pose", "target_pose", 0.1), F.size("pred_pose")),
        "pose_vel": (gap("v_pred_pose", "v_target_pose"), F.size("v_pred_pose")),
    }
    means = [
        F.coalesce(F.sum(value) / F.sum(F.when(value.isNotNull(), count)), F.lit(0.0)).alias(f"{n}_loss")
        for n, (value, count) in parts.items()
    ]
    out = rows.groupBy(*group).agg(*means)
    return out.withColumn("total_loss", sum(F.col(f"{n}_loss") * w for n, w in weights.items()))


#: Sequences perturbed together.
AT_ONCE = 64


def augment(seqs: DataFrame, seed: int, epoch: int, vectors: str = "rows", key: str = "seq") -> DataFrame:
    """Perturb audio sequences: gain, noise, a masked band, masked frames.

    Random numbers come from (seed, epoch, sequence), so a retried task repeats them.
    Apply to training sequences only.  A task holds the random numbers and results of
    ``AT_ONCE`` sequences, whatever the size of an Arrow batch.
    """
    fields = [T.StructField(f.name, T.ArrayType(T.ArrayType(T.DoubleType()))) if f.name == vectors else f for f in seqs.schema]

    return seqs.mapInArrow(lambda batches: perturbed_batches(batches, seed, epoch, vectors, key), T.StructType(fields))


def perturbed_batches(batches: Iterator[pa.RecordBatch], seed: int, epoch: int, vectors: str, key: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of ``AT_ONCE`` sequences, perturbed."""
    kind = pa.list_(pa.list_(pa.float64()))
    for whole in batches:
        for start in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(start, AT_ONCE)
            numbers = batch.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64)
            arrays = [np.array([np.asarray(r, float) for r in v]) for v in batch.column(vectors).to_pandas()]
            out = [None] * len(arrays)
            for shape in {x.shape for x in arrays}:
                at = [i for i, x in enumerate(arrays) if x.shape == shape]
                for i, x in zip(at, perturbed(np.stack([arrays[i] for i in at]), numbers[at], seed, epoch)):
                    out[i] = list(x)
            columns = [pa.array(out, kind) if n == vectors else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def uniforms(ids: np.ndarray, seed: int, epoch: int, count: int) -> np.ndarray:
    """``count`` numbers from 0 to 1 per id, the same ones for it in any batch."""
    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    start = mixed(ids + mixed(np.array([seed + 1], np.uint64)) + mixed(np.array([epoch + 2], np.uint64)) * np.uint64(3))
    return (mixed(start[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53


def perturbed(x: np.ndarray, ids: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """All sequences (sequence, row, band) of one shape at once."""
    # Gain .85 to 1.15; noise .02 (p .5); band 1-3 wide (p .4); 2 frames (p .3).
    n, rows, bands = x.shape
    draws = uniforms(ids, seed, epoch, 7 + 2 * rows * bands)
    gain, noisy, banded, band, width, framed, frame = (draws[:, k, None, None] for k in range(7))
    one, two = np.moveaxis(draws[:, 7:].reshape(n, 2, rows, bands), 1, 0)
    noise = np.sqrt(-2.0 * np.log(1.0 - one)) * np.cos(2.0 * np.pi * two) * 0.02
    first, at = np.floor(band * max(1, bands - 4)), np.arange(bands)
    hidden = (banded < 0.4) & (at >= first) & (at < first + 1 + np.floor(width * 3))
    first, at = np.floor(frame * max(1, rows - 3)), np.arange(rows)[:, None]
    hidden = hidden | ((framed < 0.3) & (at >= first) & (at < first + 2))
    return np.where(hidden, 0.0, x * (0.85 + 0.3 * gain) + np.where(noisy < 0.5, noise, 0.0))


def score(seqs: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a predictor to batches of sequences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return seqs.mapInPandas(run, schema)


def blur_score(df: DataFrame, gray: str = "gray", box: str = "bbox", name: str = "blur") -> DataFrame:
    """Variance of the Laplacian inside each box of a gray image (array of rows); 0 below 10 px."""

    @F.pandas_udf("double")
    def sharpness(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for images, boxes in batches:
            yield pd.Series([laplacian_variance(i, b) for i, b in zip(images, boxes.itertuples(index=False))], dtype=float)

    return df.withColumn(name, sharpness(F.col(gray), F.col(box)))


def laplacian_variance(image, box) -> float:
    rows = np.stack([np.asarray(r, float) for r in image])
    height, width = rows.shape
    x0, y0 = max(0, int(box[0])), max(0, int(box[1]))
    x1, y1 = min(width, int(box[0]) + int(box[2])), min(height, int(box[1]) + int(box[3]))
    if x1 - x0 < 10 or y1 - y0 < 10:
        return 0.0
    padded = np.pad(rows[y0:y1, x0:x1], 1, mode="reflect")
    edges = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * padded[1:-1, 1:-1]
    return float(edges.var())
