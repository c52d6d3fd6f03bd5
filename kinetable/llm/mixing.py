"""Mixing sources to target weights: hash-random order, prefix sums of sizes, exact budgets.

Every document gets a hash-random key.  Within a source documents are cut into key ranges of
bounded size and sorted inside them; sums per range and a prefix sum over the ranges give
each document its distributed prefix sum.  A source's budget is taken as whole epochs over
all of its documents plus the documents before the cut in key order; the one across the cut
gives just the words that are missing, so that a source meets its budget exactly.

Cases: null texts have size 0; a null source is a source of its own, last in order; equal
keys are ordered by id and size; an empty table gives an empty one; if all sizes are 0 every
target is 0.  Repeated rows count as documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """``weights`` repeat over the sources in code point order; ``most`` epochs at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    range_rows: int = 2_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``target`` to (source, source_size, ...), one row per source.

    Filling by weight with caps has a level: sources are capped in order of cap / weight,
    and the first whose share of what is left stays under its cap fixes the level for it
    and all after it.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    rows = sources.withColumn("_w", F.element_at(weights, ((F.row_number().over(ordered) - 1) % len(settings.weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", (F.col("source_size") * settings.most).cast("double"))
    # One row per source in these windows, whatever the number of documents.
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(after))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    rows = rows.withColumn("_level", F.first(fits, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("target", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).drop("_w", "_cap", "_level")


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), settings)
    # One row per source: bounded by the number of sources, which a mix names one by one.
    sources = staged(sources)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("_rows") / settings.range_rows)
    same = F.col("source").eqNullSafe(F.col("_source"))
    rows = sized.join(F.broadcast(sources.withColumnRenamed("source", "_source")), same).drop("_source")
    rows = rows.withColumn("_range", F.floor(place * ranges / F.lit(2**32)).cast("long"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    inside = Window.partitionBy("source", "_range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_base") + F.sum("size").over(inside)
    budget = F.round("target").cast("long")
    epochs = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - (end - F.col("size"))))
    taken = F.when(F.col("source_size") > 0, epochs * F.col("size") + rest).otherwise(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "key")


def mixed_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: documents with all their columns, repeated per epoch, the last copy cut to its words.

    Documents with no word in the mix go, so documents without a word do.  Rows that share
    an id share what the mix takes of them evenly; rows without an id can't be named and go.
    """
    shares = mix(docs, settings).groupBy(F.col("doc_id").alias("_id")).agg(F.floor(F.sum("taken") / F.count("*")).alias("_taken"))
    rows = docs.join(staged(shares.filter("_taken > 0")).hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).withColumn("_size", words(F.col("text")))
    copies = F.least(F.ceil(F.col("_taken") / F.greatest("_size", F.lit(1))), F.lit(settings.most)).cast("int")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    wanted = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    # Cut where a word ends: every piece is a word with the white space before it.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(wanted < F.col("_size"), F.array_join(F.slice(pieces, F.lit(1), F.greatest(wanted, F.lit(0))), "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
