"""File listings and archive manifests: compare, reconcile, assign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions import text
from kinetable.operators.ordered import Timeline, row_index


def audit_vaults(a: DataFrame, b: DataFrame, tolerance: int = 1024) -> DataFrame:
    """Where each name lives: ``both`` (sizes agree), ``a_only`` (also on a mismatch), ``b_only``."""
    left = a.select("name", F.col("size_bytes").alias("size_a"), F.lit(True).alias("_a"))
    right = b.select("name", F.col("size_bytes").alias("size_b"), F.lit(True).alias("_b"))
    sized = (F.col("size_a") > 0) & (F.col("size_b") > 0)
    differs = F.coalesce(sized & (F.abs(F.col("size_a") - F.col("size_b")) > tolerance), F.lit(False))
    here, there = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    place = F.when(here & there & ~differs, "both").when(here, "a_only").otherwise("b_only")
    return left.join(right, "name", "full_outer").select(
        "name", "size_a", "size_b", place.alias("place"), (here & there & differs).alias("size_mismatch")
    )


def audit_report(audit: DataFrame, mb_per_hour: float = 550.0) -> DataFrame:
    """Totals of an audit: redundancy, volume, estimated hours."""
    mb = 1024.0 * 1024.0
    totals = audit.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        *[F.count_if(F.col("place") == p).alias(p) for p in ("both", "a_only", "b_only")],
        F.greatest(F.coalesce(F.sum("size_a"), F.lit(0)), F.coalesce(F.sum("size_b"), F.lit(0))).alias("_bytes"),
    )
    volume = F.col("_bytes") / mb
    return totals.select(
        "total_chunks", "both", "a_only", "b_only",
        F.when(F.col("total_chunks") == 0, 100.0).otherwise(F.col("both") / F.col("total_chunks") * 100.0).alias("redundancy_pct"),
        F.bround(volume, 2).alias("total_size_mb"),
        F.bround(volume / mb_per_hour, 2).alias("estimated_hours"),
        F.bround(F.least(F.lit(100.0), volume / mb_per_hour), 1).alias("milestone_pct"),
    )


def worker_contribution(audit: DataFrame) -> DataFrame:
    """Bytes per worker, the size from vault A unless it is 0 or missing; largest first."""
    size = F.coalesce(F.nullif(F.col("size_a"), F.lit(0)), F.col("size_b"), F.lit(0))
    rows = audit.select(text.chunk_worker(F.col("name")).alias("worker"), size.alias("size"))
    return rows.groupBy("worker").agg(F.sum("size").alias("size_bytes")).orderBy(F.desc("size_bytes"))


COPY = " ("
SUFFIX = ".tar.gz"


def canonical_names(listing: DataFrame) -> DataFrame:
    """One row per clean name: the clean file, else the first of its marked copies.

    Adds how many other copies there are, and their bytes.
    """
    marked = F.col("name").contains(COPY)
    clean = F.when(marked, F.concat(F.split("name", r" \(")[0], F.lit(SUFFIX))).otherwise(F.col("name"))
    rows = listing.withColumn("clean_name", clean).withColumn("_marked", marked)
    out = rows.groupBy("clean_name").agg(
        F.min_by(F.struct("name", "size_bytes"), F.struct("_marked", "name")).alias("_r"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("_bytes"),
    )
    size = F.col("_r.size_bytes")
    return out.select(
        "clean_name", F.col("_r.name").alias("name"), size.alias("size_bytes"), "duplicates",
        (F.col("_bytes") - F.coalesce(size, F.lit(0))).alias("duplicate_bytes"),
    )


def delta_sync(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files (canonical names) that the local side still lacks.

    Present: the clean name, or its `` (1)`` variant, with the same size; with an
    unknown remote size any local file above 1024 bytes.
    """
    files = canonical_names(remote).select("clean_name", "size_bytes")
    variant = F.replace("name", F.lit(f" (1){SUFFIX}"), F.lit(SUFFIX))
    here = local.select(F.explode(F.array_distinct(F.array(F.col("name"), variant))).alias("clean_name"), F.col("size_bytes").alias("_here"))
    files, here = files.alias("r"), here.alias("l")
    present = (F.col("r.clean_name") == F.col("l.clean_name")) & F.when(
        F.col("r.size_bytes").isNull(), F.col("l._here") > 1024
    ).otherwise(F.col("l._here") == F.col("r.size_bytes"))
    return files.join(here, present, "left_anti")


def unpacked_sessions(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sessions in no archive yet."""
    packed = chunks.select(F.explode("session_ids").alias("session_id"))
    return sessions.join(packed, "session_id", "left_anti")


def pending_uploads(chunks: DataFrame, uploaded: DataFrame, name: str = "chunk_name") -> DataFrame:
    return chunks.join(uploaded.select(name), name, "left_anti")


def exclude_ids(candidates: DataFrame, *known: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose id is in none of the known lists."""
    return reduce(lambda rows, ids: rows.join(ids.select(key), key, "left_anti"), known, candidates)


def chunk_assignment(sessions: DataFrame, line: Timeline, size: int = 10) -> DataFrame:
    """Archive number of each session: every ``size`` sessions in order (of names, say) share one."""
    return row_index(sessions, line, "_i").withColumn("chunk_id", F.floor(F.col("_i") / size)).drop("_i")


def manifest(assigned: DataFrame) -> DataFrame:
    """One row per archive; session lists are bounded by the archive size."""
    return assigned.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.sort_array(F.collect_list("session_id")).alias("session_ids"),
        F.sum("frames").alias("frames"),
        F.bround(F.sum("duration_seconds") / 3600.0, 3).alias("duration_hours"),
        F.bround(F.sum("size_bytes") / (1024.0 * 1024.0), 2).alias("size_mb"),
    )


def manifest_totals(assigned: DataFrame) -> DataFrame:
    return assigned.agg(
        F.count_distinct("chunk_id").alias("total_chunks"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("frames").alias("total_frames"),
        F.bround(F.sum("duration_seconds") / 3600.0, 3).alias("total_duration_hours"),
        F.bround(F.sum("size_bytes") / (1024.0 * 1024.0), 2).alias("total_size_mb"),
    )


def listing_totals(listing: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return listing.agg(
        F.count(F.lit(1)).alias("chunks"), text.megabytes(size).alias("total_mb"), text.gigabytes(size).alias("total_gb")
    )


def set_compare(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Every distinct name with ``both``, ``a_only`` or ``b_only``."""
    tagged = a.select(name, F.lit(1).alias("_in")).unionByName(b.select(name, F.lit(2).alias("_in")))
    return tagged.groupBy(name).agg(F.bit_or("_in").alias("_in")).select(
        name, F.when(F.col("_in") == 3, "both").when(F.col("_in") == 1, "a_only").otherwise("b_only").alias("place")
    )


def overlap(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys found in more than one part; empty for disjoint parts."""
    tagged = [p.select(key).distinct().withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda x, y: x.unionByName(y), tagged)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > 1)


def drop_copies(listing: DataFrame, marker: str = " (1)") -> DataFrame:
    return listing.filter(~F.col("name").contains(marker))


def concat_sessions(tables: list[DataFrame], lean: bool = True, channels: str = "blendshapes", width: int = 52) -> DataFrame:
    """Union by column name; in lean mode sessions without channels get zeros."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
    if lean and channels in rows.columns:
        zeros = F.array_repeat(F.lit(0.0), width).cast(rows.schema[channels].dataType)
        rows = rows.withColumn(channels, F.coalesce(channels, zeros))
    return rows
