"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a document draws one number per child from a hash of its id and the child's
name and descends to the child with the smallest ``-ln(u) / weight`` (the race of exponential
clocks: a child wins in proportion to its weight, and a change of one child's weight moves
documents only to or from it).  The weight of a rack or region is the sum of its shards', so
movement stays inside the subtrees whose weights change.  ``grown`` opens a region of its own
for a new shard: whatever leaves the other regions can only land in that shard.

Cases: a null id draws like the empty string; null texts have no bytes and checksum 0; equal
ids share a shard; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged

#: region -> rack -> shard number -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

EIGHT: Tree = {
    "region0": {"rack0": {0: 1.0, 1: 1.0}, "rack1": {2: 1.0, 3: 1.0}},
    "region1": {"rack2": {4: 1.0, 5: 1.0}, "rack3": {6: 1.0, 7: 1.0}},
}


@dataclass(frozen=True)
class Settings:
    """``range_rows``: about so many rows are numbered together within a shard."""

    range_rows: int = 20_000


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a rack of a new region."""
    shards = [s for racks in tree.values() for some in racks.values() for s in some]
    new = max(shards, default=-1) + 1
    return {**tree, f"region+{new}": {f"rack+{new}": {new: weight}}}


def draw(doc_id: Column, name: str, weight: float) -> Column:
    """The child's clock: exponential with the child's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(2**53)) / weight


def descend(doc_id: Column, children: Mapping[str, tuple[float, Column]]) -> Column:
    """Value of the child that wins the draw; of a lone child, without a draw."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    clocks = {name: draw(doc_id, name, weight) for name, (weight, _) in children.items()}
    first = F.least(*clocks.values())
    picked = None
    for name, (_, value) in children.items():
        hit = clocks[name] == first
        picked = F.when(hit, value) if picked is None else picked.when(hit, value)
    return picked


def shard(doc_id: Column, tree: Tree) -> Column:
    """Shard number of an id; a function of the id and the tree alone."""
    regions = {}
    for region, racks in tree.items():
        inner = {}
        for rack, shards in racks.items():
            leaves = {f"{region}/{rack}/{s}": (w, F.lit(s)) for s, w in shards.items() if w > 0}
            if leaves:
                inner[f"{region}/{rack}"] = (sum(w for w, _ in leaves.values()), descend(doc_id, leaves))
        if inner:
            regions[region] = (sum(w for w, _ in inner.values()), descend(doc_id, inner))
    return descend(doc_id, regions).cast("int")


def assign(docs: DataFrame, tree: Tree = EIGHT, more: Tree | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard(F.col("doc_id"), tree).alias("shard"),
        shard(F.col("doc_id"), grown(tree) if more is None else more).alias("grown_shard"),
    )
    return slots(rows, ["doc_id", "text_crc32", "size"], settings)


def slots(rows: DataFrame, order: list[str], settings: Settings = Settings()) -> DataFrame:
    """Add ``slot``: positions 0, 1, ... within each shard, in hash order of ``order``.

    A shard's rows are cut into hash ranges of bounded size; a row's slot is the number of
    rows in earlier ranges plus its position in its own.
    """
    rows = staged(rows.withColumn("_hash", F.xxhash64(*order)))
    ranges = max(1, -(-rows.count() // settings.range_rows))
    rows = rows.withColumn("_range", F.pmod(F.col("_hash"), F.lit(ranges)))
    sums = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("shard").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.join(bases, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy("shard", "_range").orderBy("_hash", *order)
    rows = rows.withColumn("slot", (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
    return rows.drop("_hash", "_range", "_s", "_r", "_base")


def sharded_documents(docs: DataFrame, tree: Tree = EIGHT, settings: Settings = Settings()) -> DataFrame:
    """The documents with all their columns and their ``shard``; a plain projection, no shuffle."""
    return docs.withColumn("shard", shard(F.col("doc_id"), tree))
