"""Line dedup: overlapping windows of three lines, repeated windows found globally.

Every window of three consecutive lines is hashed to 96 bits.  A window that occurs more than
once keeps its first occurrence, by id and then position; the lines of all later ones are
marked, overlapping marks merge, and marked lines are removed.  A later occurrence in the
first one's own document removes nothing of the first.

Cases: null texts have no lines, the empty text has one; documents of fewer than three lines
have no window and stay as they are, like those without an id; rows that share an id count as
one document;
windows of blank lines count like any other; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.session import staged

LINES = 3


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, h, g): hashes of each window and the position of its first line, from 0."""
    def hashed(at):
        window = [F.get("_lines", at + i) for i in range(LINES)]
        return F.struct(at.alias("at"), F.xxhash64(*window).alias("h"), F.hash(*window).alias("g"))

    rows = docs.select("doc_id", lines(F.col("text")).alias("_lines")).filter(F.size("_lines") >= LINES)
    rows = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_lines") - LINES), hashed)).alias("w"))
    return rows.select("doc_id", "w.at", "w.h", "w.g")


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, removed): sorted distinct positions of the lines that later occurrences cover."""
    firsts = found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = found.join(staged(firsts.select("h", "g", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))), ["h", "g"])
    same = F.col("doc_id") == F.col("first_doc")
    later = later.filter(~(same & (F.col("at") == F.col("first_at"))))
    begin = F.when(same, F.greatest(F.col("at"), F.col("first_at") + LINES)).otherwise(F.col("at"))
    # A document's positions are no more than its lines.
    marks = later.select("doc_id", F.explode(F.sequence(begin, F.col("at") + LINES - 1)).alias("line"))
    return marks.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (positions, comma-joined), text without them."""
    found = staged(windows(docs.select("doc_id", "text").filter("doc_id is not null")))
    # Marks grow with the corpus: one plan at every size, with the marks as the hashed side.
    rows = docs.select("doc_id", "text").join(staged(covered(found)).hint("shuffle_hash"), "doc_id", "left")
    # Columns of their own, so that no later expression splits a text again for every line.
    rows = rows.select("doc_id", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("_gone"), lines(F.col("text")).alias("_lines"))
    gone, every = F.col("_gone"), F.col("_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda at: F.get(every, at)), "\n"))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).alias("n_lines"),
        F.size(gone).alias("n_removed"),
        F.array_join(gone.cast("array<string>"), ",").alias("removed"),
        text.alias("text"),
    )
