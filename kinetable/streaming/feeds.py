"""Feeds and sinks of a running system: URL folders, the queue table, status rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions import text
from kinetable.operators import catalog
from kinetable.streaming import live


def stream_urls(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the list files in a folder: ``url`` and ``key``; comments are skipped."""
    lines = spark.readStream.text(folder).withColumn("url", text.strip(F.col("value")))
    url = F.col("url")
    wanted = (url != "") & ~url.startswith("#") & ~url.startswith("//")
    return lines.filter(wanted).select("url", text.url_key(url).alias("key"))


def queue_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The queue written so far (empty before the first batch)."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(path)


QUEUE_SCHEMA = (
    "key string, pos long, raw_url string, canonical_url string, video_id string, title string, status string, "
    "session_id string, frame_count long, duration_seconds double"
)


#: Places in the queue set aside for each micro-batch.
BATCH_PLACES = 1 << 42


def first_seen(urls: DataFrame) -> DataFrame:
    """The first row of every key of a stream, by ``pos`` or else ``url`` within a micro-batch.

    Which keys have been seen is keyed state, so a batch is compared with nothing that was written.
    """
    order = [c for c in ("pos", "url") if c in urls.columns]

    def step(memory, rows):
        return {"seen": True}, rows.iloc[: 0 if memory["seen"] else 1]

    return live.keyed(urls, step, order, {"seen": False}, [], key="key")


def append_new(registry: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the queue rows of the sources in the batch.

    A batch writes its own folder, so repeating a batch replaces what it wrote; that no source
    comes twice is :func:`first_seen`'s part.  Places of later batches follow those of earlier ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        if "pos" not in batch.columns:
            batch = batch.withColumn("pos", F.monotonically_increasing_id())
        known = batch.sparkSession.createDataFrame([], QUEUE_SCHEMA)
        fresh = catalog.sync_queue(known, batch.select("pos", "url"), registry).withColumn("pos", F.col("pos") + number * BATCH_PLACES)
        fresh.select(*known.columns).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return write


def stream_queue(urls: DataFrame, registry: DataFrame, path: str, progress: str):
    """Keep the queue table at ``path`` in step with a URL stream; batch n reads batch n only."""
    if "key" not in urls.columns:
        urls = urls.withColumn("key", text.url_key(F.col("url")))
    writer = first_seen(urls).writeStream.foreachBatch(append_new(registry, path)).option("checkpointLocation", progress)
    with live.keyed_store(urls.sparkSession):
        return writer.trigger(availableNow=True).start()


def live_status(frames: DataFrame) -> DataFrame:
    """One status row per session: frames, seconds by state, last state, rate and badge.

    ``frames`` has session_id, t (seconds), frame_idx, dt, conversational_state,
    gate_active and n_faces.
    """
    state, dt = F.col("conversational_state"), F.col("dt")

    def seconds(label):
        return F.coalesce(F.sum(F.when(F.col("gate_active") & (state == label), dt)), F.lit(0.0))

    def last(column):
        return F.max_by(column, F.struct("t", "frame_idx"))

    out = frames.groupBy("session_id").agg(
        F.count_if("gate_active").alias("session_frames"),
        seconds("ACTIVE_SPEECH").alias("speech_seconds"),
        seconds("CONVERSATIONAL_PAUSE").alias("pause_seconds"),
        last("conversational_state").alias("conversational_state"),
        last("gate_active").alias("is_recording"),
        last("n_faces").alias("faces_detected"),
        (F.count(dt) / F.sum(dt)).alias("fps"),
    )
    return out.withColumn("badge", text.status_badge(F.col("is_recording"), F.col("conversational_state"), F.col("faces_detected")))


def stream_status(frames: DataFrame, path: str, progress: str):
    """Keep the status of every session under ``path``; Spark's state holds the totals of all batches.

    A batch writes the rows of the sessions it changed; :func:`status_table` reads the newest.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    writer = live_status(frames).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start()


def status_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest status row of every session."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    kept = [c for c in rows.columns if c != "_batch"]
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*kept), "_batch").alias("s"))
    return newest.select("s.*")
