"""Session helpers: where reliable checkpoints go, and how executors get this package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, list[str]] = {}
_shipped: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen for a local master that names none.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    For inputs that are expensive to produce and read several times: unlike a
    checkpoint, a later reader still reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Fixed value: Spark's switch for dropping a query's shuffle files once the query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, shuffle files go when the query that wrote them ends; on leaving, staged tables go.

    Yields ``keep``, which stages a table that stays.  For chains of many staged tables, whose
    disk would else fill up until the whole result is written.
    """
    paths, before = _staged.setdefault(spark.sparkContext.applicationId, []), spark.conf.get(TIDY, "false")
    first, kept = len(paths), []

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df)
        kept.append(paths[-1])
        return out

    spark.conf.set(TIDY, "true")
    try:
        yield keep
    finally:
        spark.conf.set(TIDY, before)
        inside, paths[first:] = paths[first:], kept
        _delete(spark, [p for p in inside if p not in kept])


def release(spark: SparkSession) -> int:
    """Delete the tables staged so far, once the results that read them are written."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once, unless they have it on PYTHONPATH."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId in _shipped or root in known:
        return
    _shipped.add(context.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "kinetable")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "kinetable"))
