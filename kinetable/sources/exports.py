"""Writers: frames, training tables, statistics, JSON lines, animation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS
from kinetable.operators.filters import filter_frames


def export_jsonl(df: DataFrame, path: str, min_level: int = 3) -> int:
    """Write frames of at least ``min_level`` as JSON lines; returns how many were written."""
    seen = Observation("export")
    rows = filter_frames(df, min_level=min_level).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").json(path)
    return seen.get["rows"]


def animation_rows(df: DataFrame, names: Sequence[str] = CHANNELS, values: str = "pred_bs", index: str = "frame", fps: float = 30.0) -> DataFrame:
    """One column per channel (5 digits) after the time in seconds (4 digits)."""
    return df.select(
        F.bround(F.col(index) / fps, 4).alias("time_sec"),
        *[F.bround(F.col(values)[i].cast("double"), 5).alias(n) for i, n in enumerate(names)],
    )


def export_animation_csv(df: DataFrame, path: str, names: Sequence[str] = CHANNELS, values: str = "pred_bs", index: str = "frame") -> None:
    """Animation table as CSV parts with a header, in frame order across the parts."""
    ordered = df.repartitionByRange(F.col(index)).sortWithinPartitions(index)
    animation_rows(ordered, names, values, index).write.mode("overwrite").option("header", "true").csv(path)


def animation_documents(df: DataFrame, names: Sequence[str] = CHANNELS, values: str = "pred_bs", index: str = "frame", fps: float = 30.0) -> DataFrame:
    """One document per frame: number, time and a map of channel values."""
    keys = F.array(*[F.lit(n) for n in names])
    return df.select(
        F.col(index).alias("frame"),
        F.bround(F.col(index) / fps, 4).alias("time_sec"),
        F.map_from_arrays(keys, F.transform(F.slice(values, 1, len(names)), lambda x: x.cast("double"))).alias("blendshapes"),
    )


def animation_metadata(df: DataFrame, accuracy: DataFrame, channels: int = len(CHANNELS), fps: float = 30.0) -> DataFrame:
    """The one-row header of an animation: rate, length, error, correlation."""
    total = df.agg(F.count(F.lit(1)).alias("total_frames"))
    return total.crossJoin(F.broadcast(accuracy.select("mae", F.col("corr_jaw").alias("jaw_correlation")))).select(
        F.lit(int(fps)).alias("fps"), "total_frames", (F.col("total_frames") / fps).alias("duration_sec"),
        F.lit(channels).alias("blendshape_count"), "mae", "jaw_correlation",
    )


def export_animation_json(df: DataFrame, accuracy: DataFrame, path: str, names: Sequence[str] = CHANNELS, values: str = "pred_bs", index: str = "frame") -> None:
    """Frame documents under ``frames``, the header under ``metadata``."""
    documents = animation_documents(df, names, values, index)
    documents.repartitionByRange("frame").sortWithinPartitions("frame").write.mode("overwrite").json(f"{path}/frames")
    animation_metadata(df, accuracy, len(names)).write.mode("overwrite").json(f"{path}/metadata")


def write_frames(df: DataFrame, path: str, by_session: bool = True, slice_rows: int = 100_000, key: str = "session_id", index: str = "frame_idx") -> None:
    """Frames as parquet in (session, frame) order.

    ``by_session`` makes one folder per session, for few sessions; a long session is
    written by several tasks.  Otherwise rows are range-clustered, so that readers
    of any session skip by row-group statistics and no file is tiny.
    """
    if by_session:
        part = F.floor(F.col(index) / slice_rows)
        rows = df.repartition(F.col(key), part).sortWithinPartitions(key, index)
        rows.write.mode("overwrite").partitionBy(key).parquet(path)
    else:
        df.repartitionByRange(key, index).sortWithinPartitions(key, index).write.mode("overwrite").parquet(path)


def write_training(df: DataFrame, path: str) -> None:
    """Training rows in one folder per split, range-clustered by session."""
    rows = df.repartitionByRange("is_train", "session_id", "frame_idx").sortWithinPartitions("session_id", "frame_idx")
    rows.write.mode("overwrite").partitionBy("is_train").parquet(path)


def split_filter(split: str) -> Column:
    """Rows of ``train``, ``val``/``validation``, or all."""
    if split == "train":
        return F.col("is_train")
    return ~F.col("is_train") if split in ("val", "validation") else F.lit(True)


def read_training(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """Rows of one split; only its folder is read."""
    return spark.read.parquet(path).withColumn("is_train", F.col("is_train").cast("boolean")).filter(split_filter(split))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)
