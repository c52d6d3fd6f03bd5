"""Exact quantiles per group without gathering a group in one task.

Three aggregations, all with map-side partials: (1) approximate quantiles bracket
the wanted rank, (2) counts check the brackets - a bracket that misses is widened
to the whole range, so the answer never depends on the sketch - and (3) only the
few values inside a bracket are ordered, after equal values were merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged

ACCURACY = 10_000
SLACK = 4.0 / ACCURACY


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``keys`` plus ``q0, q1, ...``: linearly interpolated quantiles of non-null ``value``."""
    keys = list(keys)
    data = df.select(*keys, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    if not keys:
        data, keys = data.withColumn("_all", F.lit(0)), ["_all"]
    probs = list(probs)
    edges = [e for p in probs for e in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    sketch = data.groupBy(*keys).agg(
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", F.array(*[F.lit(e) for e in edges]), F.lit(ACCURACY)).alias("_edges"),
    )
    wanted = sketch.select(
        *keys,
        "_n",
        "_min",
        "_max",
        F.posexplode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("p"),
                        F.col("_edges")[2 * i].alias("lo"),
                        F.col("_edges")[2 * i + 1].alias("hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("_q", "_b"),
    )
    rank = F.col("_b.p") * (F.col("_n") - 1)
    wanted = wanted.select(
        *keys, "_q", "_min", "_max", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"),
        rank.alias("_rank"), F.floor(rank).alias("_r0"), F.ceil(rank).alias("_r1"),
    )
    # The counts keep the bracket they belong to: made a second time, a sketch may give another one.
    checked = (
        data.join(wanted, keys)
        .groupBy(*keys, "_q", "_rank", "_r0", "_r1", "_min", "_max", "_lo", "_hi")
        .agg(F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.count_if(F.col("_x") <= F.col("_hi")).alias("_upto"))
    )
    hit = (F.col("_r0") >= F.col("_below")) & (F.col("_r1") < F.col("_upto"))
    bounds = checked.select(
        *keys, "_q", "_rank", "_r0", "_r1",
        F.when(hit, F.col("_lo")).otherwise(F.col("_min")).alias("_lo"),
        F.when(hit, F.col("_hi")).otherwise(F.col("_max")).alias("_hi"),
        F.when(hit, F.col("_below")).otherwise(F.lit(0)).alias("_below"),
    )
    merged = (
        data.join(bounds, keys)
        .filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*keys, "_q", "_rank", "_r0", "_r1", "_below", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    group = [*keys, "_q"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(merged.repartitionByRange(parts, *group, "_x").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = laid.groupBy(*group, "_r0", "_r1", "_below", "_part").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumn("_low", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    end = F.col("_low") + F.col("_n")
    holding = sizes.filter(((F.col("_r0") >= F.col("_low")) & (F.col("_r0") < end)) | ((F.col("_r1") >= F.col("_low")) & (F.col("_r1") < end)))
    inside = Window.partitionBy(*group, "_part").orderBy("_x")
    ranked = laid.drop("_below").join(holding.select(*group, "_part", "_low"), [*group, "_part"])
    ranked = ranked.withColumn("_end", F.col("_low") + F.sum("_c").over(inside)).withColumn("_begin", F.col("_end") - F.col("_c"))
    holds0 = (F.col("_begin") <= F.col("_r0")) & (F.col("_r0") < F.col("_end"))
    holds1 = (F.col("_begin") <= F.col("_r1")) & (F.col("_r1") < F.col("_end"))
    picked = ranked.groupBy(*keys, "_q", "_rank", "_r0").agg(
        F.max(F.when(holds0, F.col("_x"))).cast("double").alias("_x0"),
        F.max(F.when(holds1, F.col("_x"))).cast("double").alias("_x1"),
    )
    fraction = F.col("_rank") - F.col("_r0")
    value_at = F.when(fraction == 0, F.col("_x0")).otherwise(
        F.col("_x0") + (F.col("_x1") - F.col("_x0")) * fraction
    )
    out = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, value_at)).alias(f"q{i}") for i in range(len(probs))]
    )
    return out.drop("_all")
