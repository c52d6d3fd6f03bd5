"""Table functions for SQL: archives opened into rows, sequence windows of a list.

``register(spark)`` makes them known to a session; they run next to the rows that name them, as
``SELECT ... FROM archives, LATERAL read_chunks(path, content)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinetable.sources import sessions

#: Columns of a stored frame that the table function gives; landmarks stay with the readers.
CHUNK_COLUMNS = ("t", "face_id", "level", "role")


def _chunk_fields() -> str:
    kinds = {f.name: f.dataType.simpleString() for f in sessions.frame_schema(CHUNK_COLUMNS)}
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


class ReadChunks:
    """Frames of the sessions inside one archive; damage is a row with ``corrupt`` set."""

    def eval(self, path: str, content: bytes):
        schema = sessions.frame_schema(CHUNK_COLUMNS)
        for frames in sessions.archive_frames(path, bytes(content), schema):
            for row in frames.astype(object).where(frames.notna(), None).itertuples(index=False):
                yield tuple(v.item() if hasattr(v, "item") else v for v in row)


class SequenceWindows:
    """(seq, start, last): strided windows over ``n`` rows, as many as the batch operator makes."""

    def eval(self, n: int, length: int, stride: int):
        for seq in range(max(1, (n - length) // stride) if n else 0):
            yield seq, seq * stride, min(n, seq * stride + length) - 1


def register(spark: SparkSession) -> None:
    """Register ``read_chunks(path, content)`` and ``sequence_windows(n, length, stride)``."""
    spark.udtf.register("read_chunks", F.udtf(ReadChunks, returnType=_chunk_fields()))
    spark.udtf.register("sequence_windows", F.udtf(SequenceWindows, returnType="seq long, start long, last long"))
