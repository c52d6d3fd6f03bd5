"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Distinct fingerprints are range-sorted by the population counts of the whole word and of its
four 16-bit parts and cut into tiles.  Counts differ by at most as much as the bits do, so a
pair of tiles whose ranges of counts lie further apart than the radius holds no link and is
never formed; the other pairs meet one by one in a task, which compares sub-tiles (again only
those within the radius) by numpy exclusive-or and bit counts.  A pair returns a spanning
forest of its links, at most one row per fingerprint, so that a group of many near copies
doesn't produce all of its pairs; :mod:`.components` joins the forests.

The comparison is exact and its work is quadratic by nature; the counts' skips divide it by a
number that grows with the table, as tiles get narrower ranges.

Cases: null texts and texts without words have the fingerprint zero and link like any other;
rows without an id take the component of their fingerprint, if a row with an id has it or is
linked to it, else null.  Repeated rows keep their number; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.components import components
from kinetable.session import staged

PARTS = 4
#: Fingerprints of a sub-tile; two of them make one matrix of comparisons.
INNER = 512


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, bits within which fingerprints link, fingerprints of a tile."""

    words: int = 4
    radius: int = 4
    seed: int = 42
    tile: int = 32_768


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half of the shingle hashes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    found = data.split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(found) - words + 1)].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(settings: Settings, text: str = "text") -> Column:
    words, seed = settings.words, settings.seed

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), words, seed) for t in texts], type=pa.int64())

    return hashed(F.col(text))


def part_counts(values: np.ndarray) -> np.ndarray:
    """Set bits of the four 16-bit parts of each fingerprint, one row per fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(values, dtype="<u8").view("<u2").reshape(-1, PARTS)).astype(np.int16)


def tiles(prints: DataFrame, settings: Settings) -> DataFrame:
    """Cut distinct (fp, rep) into tiles: id, range of bit counts in all and per part, packed rows."""
    whole = F.bit_count("fp")
    parts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(PARTS)]
    number = max(1, -(-prints.count() // settings.tile))
    laid = prints.select("fp", "rep", whole.alias("n"), *[p.alias(f"n{i}") for i, p in enumerate(parts)])
    keys = ["n", *[f"n{i}" for i in range(PARTS)], "fp"]
    laid = laid.repartitionByRange(number, *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "fp", "rep")
    size = settings.tile

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, reps, part, made = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0

        def packed(fps, reps, made):
            counts = part_counts(fps)
            total = counts.sum(axis=1)
            row = {
                "tile": (part << 24) + made, "low": int(total.min()), "high": int(total.max()),
                "lows": counts.min(axis=0).tolist(), "highs": counts.max(axis=0).tolist(), "fps": fps.tobytes(), "reps": reps.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("tile", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("lows", pa.list_(pa.int32())), ("highs", pa.list_(pa.int32())), ("fps", pa.binary()), ("reps", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            fps, reps = np.concatenate([fps, batch.column(1).to_numpy()]), np.concatenate([reps, batch.column(2).to_numpy()])
            while len(fps) >= size:
                yield packed(fps[:size], reps[:size], made)
                fps, reps, made = fps[size:], reps[size:], made + 1
        if len(fps):
            yield packed(fps, reps, made)

    return laid.mapInArrow(pack, "tile long, low int, high int, lows array<int>, highs array<int>, fps binary, reps binary")


def tile_pairs(table: DataFrame, radius: int) -> DataFrame:
    """(one, two) with one <= two: tiles whose ranges of counts are within the radius.

    An equi-join on the count of set bits; a tile covers few counts, as tiles are sorted by it.
    """
    bounds = table.select("tile", "low", "high", "lows", "highs")
    left = bounds.select(F.col("tile").alias("one"), *[F.col(c).alias("l_" + c) for c in ("low", "high", "lows", "highs")])
    left = left.withColumn("n", F.explode(F.sequence(F.col("l_low") - radius, F.col("l_high") + radius)))
    right = bounds.withColumnRenamed("tile", "two").withColumn("n", F.explode(F.sequence("low", "high")))

    def gap(low, high, other_low, other_high):
        return F.greatest(low - other_high, other_low - high, F.lit(0))

    apart = sum((gap(F.col("l_lows")[i], F.col("l_highs")[i], F.col("lows")[i], F.col("highs")[i]) for i in range(PARTS)), F.lit(0))
    return left.join(right, "n").filter((F.col("one") <= F.col("two")) & (apart <= radius)).select("one", "two").distinct()


def forest(fps: np.ndarray, others: np.ndarray | None, radius: int) -> np.ndarray:
    """Smallest index linked to each row of ``fps`` then ``others`` within this pair of tiles.

    With ``others`` only links between the two sides count, else those within ``fps``.
    """
    second = fps if others is None else others
    offset = 0 if others is None else len(fps)
    labels = np.arange(offset + len(second))

    def boxes(values):
        counts = part_counts(values)
        starts = np.arange(0, len(values), INNER)
        return starts, np.minimum.reduceat(counts, starts, axis=0), np.maximum.reduceat(counts, starts, axis=0)

    (starts, low, high), (starts2, low2, high2) = boxes(fps), boxes(second)
    gaps = np.maximum(np.maximum(low[:, None] - high2[None], low2[None] - high[:, None]), 0).sum(axis=2)
    # Ranges of the whole word's count follow from the parts' and are no narrower here.
    a, b = fps.view(np.uint64), second.view(np.uint64)
    for x, y in np.argwhere(gaps <= radius):
        if others is None and y < x:
            continue
        i, j = starts[x], starts2[y]
        near = np.bitwise_count(a[i : i + INNER, None] ^ b[None, j : j + INNER]) <= radius
        one, two = np.nonzero(near)
        one, two = one + i, two + j + offset
        if others is None:
            one, two = one[one < two], two[one < two]
        hook(labels, one, two)
    return labels


def hook(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Join the trees of linked rows in place; every label ends as its tree's smallest row."""
    while True:
        a, b = labels[one], labels[two]
        differ = a != b
        if not differ.any():
            return
        one, two = one[differ], two[differ]
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def links(table: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): a spanning forest, over representatives, of the links between distinct fingerprints."""
    pairs = tile_pairs(table, settings.radius)
    body = table.select("tile", "fps", "reps")
    sides = [pairs.select("one", "two", F.lit(s).alias("side"), F.col(c).alias("tile")) for s, c in ((0, "one"), (1, "two"))]
    sent = sides[0].union(sides[1].filter("one <> two")).join(body, "tile").select("one", "two", "side", "fps", "reps")
    radius = settings.radius

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["side", "fps", "reps"]).to_pylist(), key=lambda r: r["side"])
        fps = [np.frombuffer(r["fps"], dtype=np.int64) for r in rows]
        reps = np.concatenate([np.frombuffer(r["reps"], dtype=np.int64) for r in rows])
        labels = forest(fps[0], fps[1] if len(fps) > 1 else None, radius)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": reps[moved], "b": reps[labels[moved]]})

    return sent.groupBy("one", "two").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest id that links reach)."""
    printed = staged(docs.select("doc_id", fingerprint_column(settings).alias("fp")))
    prints = printed.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = staged(prints.filter("rep is not null"))
    roots = components(links(staged(tiles(named, settings)), settings))
    lookup = staged(named.join(roots, named.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    fingerprint_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return printed.join(lookup, "fp", "left").select("doc_id", fingerprint_hex, "component_id")


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Keep the document with the smallest id of each component; rows without an id stay.

    Repeated rows of a kept id stay as well, as they are one document.
    """
    dropped = near_duplicates(docs, settings).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(staged(dropped).hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
