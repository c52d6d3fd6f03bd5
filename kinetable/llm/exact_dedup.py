"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders.

Each partition counts the 64-bit fingerprints of its texts in counting quotient filters, one
per range of fingerprints.  A filter keeps of a fingerprint its quotient, as two bits per slot
(quotient occupied; last slot of a quotient's run), and its remainder with a count, in
order.  Quotient and remainder give the fingerprint back, so filters of any sizes merge
without loss: their sorted remainders are merged and equal ones add their counts.  Only
fingerprints with a count above one are routed to the byte check, which groups the texts
themselves; all other documents are known to be alone and their text never moves again.

Cases: null texts count as empty ones and equal them; repeated rows are copies of each
other; a null id loses to any other; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged


@dataclass(frozen=True)
class Settings:
    """``range_bits`` split the fingerprints into 2 ** bits ranges, each merged by one task."""

    range_bits: int = 9


@dataclass(frozen=True)
class Filter:
    """Counting quotient filter over the low ``width`` bits of fingerprints of one range."""

    width: int
    quotient_bits: int
    occupied: bytes
    run_ends: bytes
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, width: int) -> Filter:
        """From distinct ascending values (uint64, below 2 ** width)."""
        bits = min(width, max(1, math.ceil(math.log2(len(values) + 1))))
        shift = np.uint64(width - bits)
        quotients = values >> shift
        occupied = np.zeros(1 << bits, dtype=bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True) if len(values) else np.zeros(0, dtype=bool)
        remainders = values & ((np.uint64(1) << shift) - np.uint64(1))
        return cls(width, bits, np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), remainders, counts)

    def values(self) -> np.ndarray:
        """The counted values, ascending: the k-th run belongs to the k-th occupied quotient."""
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.quotient_bits))
        ends = np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=len(self.remainders))
        run = np.cumsum(ends) - ends
        return (occupied[run].astype(np.uint64) << np.uint64(self.width - self.quotient_bits)) | self.remainders

    def merged(self, other: Filter) -> Filter:
        """Both filters' contents; no value or count is lost, whatever the filters' sizes."""
        both, counts = np.concatenate([self.values(), other.values()]), np.concatenate([self.counts, other.counts])
        order = np.argsort(both, kind="stable")  # two sorted runs: a merge
        both, counts = both[order], counts[order]
        first = np.append(True, both[1:] != both[:-1]) if len(both) else np.zeros(0, dtype=bool)
        return Filter.of(both[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(both) else counts, self.width)

    def row(self) -> dict:
        return {"width": self.width, "quotient_bits": self.quotient_bits, "occupied": self.occupied, "run_ends": self.run_ends, "remainders": self.remainders.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> Filter:
        remainders, counts = np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64)
        return cls(row["width"], row["quotient_bits"], row["occupied"], row["run_ends"], remainders, counts)


FILTER = "range int, width int, quotient_bits int, occupied binary, run_ends binary, remainders binary, counts binary"
ARROW = pa.schema([("range", pa.int32()), ("width", pa.int32()), ("quotient_bits", pa.int32()), *[(n, pa.binary()) for n in ("occupied", "run_ends", "remainders", "counts")]])


def filters(fingerprints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per partition and range: the filter of the column ``fp`` (long) in it."""
    width = 64 - settings.range_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column(0).to_numpy().view(np.uint64) for batch in batches]
        values, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        where = (values >> np.uint64(width)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(values) else []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            inner = values[a:b] & np.uint64((1 << width) - 1)
            yield pa.RecordBatch.from_pylist([{"range": int(where[a]), **Filter.of(inner, counts[a:b], width).row()}], schema=ARROW)

    return fingerprints.select("fp").mapInArrow(build, FILTER)


def repeated(parts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(fp, copies) of the fingerprints that all filters together count more than once."""
    width = 64 - settings.range_bits

    def merge(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for row in batch.to_pylist():
                part = Filter.from_row(row)
                whole = part if whole is None else whole.merged(part)
        kept = whole.counts > 1
        values = (np.uint64(group[0].as_py()) << np.uint64(width)) | whole.values()[kept]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(whole.counts[kept])], names=["fp", "copies"])

    return parts.groupBy("range").applyInArrow(merge, "fp long, copies long")


def exact_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays; of its repeated rows exactly those rows do.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    copies = staged(repeated(filters(rows, settings), settings))
    marked = rows.join(copies, "fp", "left")
    several = F.col("copies") > 1
    # Texts of documents that are alone stay behind; the others' are written once.
    marked = staged(marked.select("doc_id", "fp", "sha", F.when(several, F.col("text")).alias("text"), F.coalesce(several, F.lit(False)).alias("several")))
    alone = marked.filter("not several").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    routed = marked.filter("several")
    groups = routed.groupBy("fp", "sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # The bytes are compared above; the text rides along only where a checksum names two texts.
    same = F.count("*").over(Window.partitionBy("fp", "sha"))
    groups = staged(groups.withColumn("_texts", same).select(F.col("fp").alias("_fp"), F.col("sha").alias("_sha"), F.when(F.col("_texts") > 1, F.col("text")).alias("_text"), "keep_id", "group_size"))
    shared = (F.col("fp") == F.col("_fp")) & (F.col("sha") == F.col("_sha")) & (F.col("_text").isNull() | (F.col("_text") == F.col("text")))
    found = routed.join(groups, shared).select("doc_id", "keep_id", "group_size", "sha")
    every = alone.union(found)
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
