"""Aggregates over vector columns: statistics, medians, variance, calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.quantiles import exact_quantiles


def components(df: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    """One row per vector component: ``key``, ``pos``, ``x``."""
    return df.select(*key, F.posexplode(column).alias("pos", "_x")).select(*key, "pos", F.col("_x").cast("double").alias("x"))


def vector_stats(df: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, min and max of each component (partials per task)."""
    return components(df, column, key).groupBy(*key, "pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def wide_vector_stats(df: DataFrame, column: str) -> DataFrame:
    """:func:`vector_stats` for very wide vectors of one length.

    Every task reduces its Arrow batches to one row of moments; only those rows are
    exploded and merged, by the usual update of mean and squared deviation.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2, low, high = 0, None, None, None, None
        for batch in batches:
            column_ = batch.column(0).drop_null()
            if not len(column_):
                continue
            x = column_.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column_), -1)
            k, mu = len(x), x.mean(axis=0)
            dev = ((x - mu) ** 2).sum(axis=0)
            if n == 0:
                n, mean, m2, low, high = k, mu, dev, x.min(axis=0), x.max(axis=0)
                continue
            delta = mu - mean
            mean = mean + delta * (k / (n + k))
            m2 = m2 + dev + delta**2 * (n * k / (n + k))
            low, high, n = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)), n + k
        if n:
            columns = [pa.array([n], pa.int64())] + [pa.array([v], pa.list_(pa.float64())) for v in (mean, m2, low, high)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "m2", "low", "high"])

    parts = df.select(column).mapInArrow(moments, "n long, mean array<double>, m2 array<double>, low array<double>, high array<double>")
    flat = parts.select("n", F.posexplode(F.arrays_zip("mean", "m2", "low", "high")).alias("pos", "p")).select("n", "pos", "p.*")
    # Spread around the overall mean: that inside the parts plus that of the parts' means.
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    merged = flat.groupBy("pos").agg(total.alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.min("low").alias("min"), F.max("high").alias("max"))
    centres = F.broadcast(merged.select("pos", F.col("mean").alias("_centre")))  # one row per component
    apart = flat.join(centres, "pos").groupBy("pos").agg(F.sum(F.col("n") * (F.col("mean") - F.col("_centre")) ** 2).alias("_between"))
    return merged.join(apart, "pos").select("pos", "n", "mean", F.sqrt((F.col("_m2") + F.col("_between")) / F.col("n")).alias("std"), "min", "max")


def top_components(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The ``n`` components that vary most, with mean and peak."""
    stats = components(df, column).groupBy("pos").agg(
        F.var_pop("x").alias("variance"), F.avg("x").alias("mean"), F.max("x").alias("peak")
    )
    return stats.orderBy(F.desc("variance"), F.desc("pos")).limit(n)


def median_vector(df: DataFrame, key: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """Exact element-wise median of each key's vectors, the same way for keys of any size.

    Nulls inside vectors and shorter vectors don't count; a component without any value
    has a null median.  Keys without a vector are left out.
    """
    key = list(key)
    values = exact_quantiles(components(df, column, key), [*key, "pos"], "x", [0.5])
    medians = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "q0"))).alias("_m"))
    widths = df.filter(F.col(column).isNotNull()).groupBy(*key).agg(F.max(F.size(column)).alias("_w"))
    places = F.when(F.col("_w") > 0, F.sequence(F.lit(0), F.col("_w") - 1)).otherwise(F.array().cast("array<int>"))
    return widths.join(medians, key, "left").select(*key, F.transform(places, lambda i: F.try_element_at("_m", i)).alias(name))


def pose_delta(df: DataFrame, key: Sequence[str], column: str = "pose", name: str = "pose_delta", from_rows: DataFrame | None = None) -> DataFrame:
    """Each row's pose minus the median pose of its session (of ``from_rows`` if given)."""
    median = median_vector(df if from_rows is None else from_rows, key, column, "_median")
    return df.join(median, list(key)).withColumn(
        name, F.zip_with(F.col(column), "_median", lambda a, b: a.cast("double") - b)
    ).drop("_median")


def mean_variance(df: DataFrame, key: Sequence[str], column: str, points: Sequence[int] | None = None) -> DataFrame:
    """Variance across a key's rows of each coordinate of some landmarks, averaged."""
    return mean_variances(df, key, {"variance": (column, points)})


def mean_variances(df: DataFrame, key: Sequence[str], parts: dict[str, tuple[str, Sequence[int] | None]]) -> DataFrame:
    """:func:`mean_variance` of several ``{name: (column, points)}`` in one pass over the rows."""
    vectors = []
    for name, (column, points) in parts.items():
        vector = F.col(column)
        if points is not None:
            vector = F.array(*[F.col(column)[p * 3 + axis] for p in points for axis in range(3)])
        vectors.append(F.struct(F.lit(name).alias("part"), vector.cast("array<double>").alias("v")))
    rows = df.select(*key, F.explode(F.array(*vectors)).alias("_s")).select(*key, "_s.part", F.posexplode("_s.v").alias("pos", "x"))
    per = rows.groupBy(*key, "part", "pos").agg(F.var_pop("x").alias("v"))
    return per.groupBy(*key).agg(*[F.avg(F.when(F.col("part") == name, F.col("v"))).alias(name) for name in parts])


def variance_report(df: DataFrame, key: Sequence[str], raw: str, normalized: str, anchors: Sequence[int], lips: Sequence[int],
                    residual: str | None = None) -> DataFrame:
    """Mean anchor variance before and after normalization, their ratio, and lip variance.

    Anchors are set to the template at the end of normalization, so the ratio says
    little; pass ``residual`` (vectors before that step) for an honest figure.
    """
    parts = {"raw_anchor": (raw, anchors), "norm_anchor": (normalized, anchors), "norm_lips": (normalized, lips)}
    if residual is not None:
        parts["residual_anchor"] = (residual, anchors)
    out = mean_variances(df, key, parts).agg(*[F.avg(name).alias(name) for name in parts])
    return out.withColumn("reduction_ratio", F.col("raw_anchor") / F.greatest(F.lit(1e-9), F.col("norm_anchor")))


def speech_drive(df: DataFrame, energy: str, jaw: str, key: Sequence[str] = (), name: str = "drive") -> DataFrame:
    """Blend of energy (by its 90th percentile) and jaw opening (5th to 95th percentile)."""
    jaws = exact_quantiles(df, key, jaw, [0.05, 0.95]).withColumnsRenamed({"q0": "_p5", "q1": "_p95"})
    energies = exact_quantiles(df, key, energy, [0.90]).withColumnRenamed("q0", "_p90")
    if key:
        rows = df.join(jaws.join(energies, list(key)), list(key))
    else:
        rows = df.crossJoin(F.broadcast(jaws)).crossJoin(F.broadcast(energies))  # one row each

    def unit(value):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))

    opened = unit((F.col(jaw) - F.col("_p5")) / (F.col("_p95") - F.col("_p5") + 1e-5))
    loud = unit(F.col(energy) / (F.col("_p90") + 1e-5))
    return rows.withColumn(name, loud * 0.65 + opened * 0.35).drop("_p5", "_p95", "_p90")
