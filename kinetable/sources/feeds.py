"""URL lists: text files of sources, one per line, with comments and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions import text
from kinetable.operators.ordered import Timeline, running

TITLE = r"^# [Tt]itle:\s*(.*)$"


def url_lines(lines: DataFrame, line: Timeline, value: str = "value") -> DataFrame:
    """URLs among ordered lines, each with the title comment since the URL before it.

    Blank lines and lines starting with ``#`` or ``//`` are skipped.
    """
    raw = text.strip(F.col(value))
    rows = lines.withColumn("url", raw)
    is_url = (F.col("url") != "") & ~F.col("url").startswith("#") & ~F.col("url").startswith("//")
    titled = F.col("url").rlike(TITLE)
    here = F.struct(*line.order)
    rows = running(
        rows,
        line,
        {
            "_title": ("max", F.when(titled, F.struct(*line.order, F.regexp_extract("url", TITLE, 1).alias("title")))),
            "_url": ("max", F.when(is_url, here)),
        },
        inclusive=False,
    )
    fresh = F.col("_title").isNotNull() & (
        F.col("_url").isNull() | (F.struct(*[F.col("_title")[c] for c in line.order]) > F.col("_url"))
    )
    return rows.filter(is_url).select(
        *line.key, *line.order, "url", F.when(fresh, F.col("_title.title")).alias("title")
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of one or more list files: ``file``, ``block``, ``line``, ``url``, ``title``.

    Big files are read in splits; (file, block, line) sorts rows as they stand.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return url_lines(lines, Timeline(("file",), ("block", "line"), 1))
