"""Prefix trie of conversations, and subtree totals by parallel tree contraction.

A node is a sequence of first turns.  It is known by a 128-bit exclusive-or of the hashes of its
turns with their places, which a running window makes for all turns at once; conversations are
cut into slices, so that none of them is one task.

:func:`subtree_totals` contracts a forest of any shape in rounds of joins.  *Rake* takes all
leaves away and adds what they hold to their parents.  *Compress* takes nodes out of unary
chains, those whose drawn rank is above that of both neighbours, so that no two neighbours go at
once; what such a node holds moves to the link between its child and its parent.  A chain shrinks
by about a third a round, so the rounds grow with the logarithm of the tree, also where it is
one long path.  *Re-expansion* then gives every node taken out the total of the node that it was
left above, plus what lay between; these references are shortened by doubling.

Cases: rows without a conversation id belong to none; turns sort by number (null first), equal
numbers by the digest of role and text; null roles and texts are empty; repeated rows are turns
of their own.  A negative id's remainder has its sign.  Only the four named
columns are read.  An empty table has no conversation and so no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.session import staged

#: A word of a turn.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids written together in one piece of a list to be hashed.
IDS = 512


@dataclass(frozen=True)
class Settings:
    """Conversations of a family share the turns of its first one: ``c - c % family``, at most ``heads - 1`` of them.

    ``part_rows`` rows are numbered in one task, ``slice_turns`` turns are hashed in one.
    """

    family: int = 20
    heads: int = 4
    part_rows: int = 200_000
    slice_turns: int = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): texts are read once and leave only a hash and a count."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def head(conv_id: Column, settings: Settings) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % settings.heads


def rebuilt(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length) of every conversation, (conv_id, depth, digest, words) of its rebuilt turns)."""
    rows = staged(rows)
    number = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // settings.part_rows))
    # Parts of about equal numbers of rows, whatever one conversation holds.
    laid = staged(rows.repartitionByRange(number, "conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()))
    pieces = staged(laid.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")))
    family = F.col("conv_id") - F.col("conv_id") % settings.family
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("own")).select("conv_id", "own", family.alias("base"), head(F.col("conv_id"), settings).alias("head"))
    bases = convs.filter("conv_id = base").select("base", F.col("own").alias("there"))
    lent = F.least("head", F.coalesce("there", F.lit(0)))
    convs = staged(convs.join(bases, "base", "left").select("conv_id", "base", "own", "head", lent.alias("lent")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(convs, "conv_id")
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest"))
    placed = laid.withColumn("at", at).join(starts.drop("n"), ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("at"))
    placed = staged(placed.select("conv_id", "base", "head", "lent", "at", "digest", "words"))
    own = placed.filter("at > head").select("conv_id", (F.col("at") - F.col("head") + F.col("lent")).alias("depth"), "digest", "words")
    firsts = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("at") < settings.heads)).select("base", F.col("at").alias("depth"), "digest", "words")
    heads = convs.filter("lent > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lent").cast("long"))).alias("depth"))
    borrowed = heads.join(firsts, ["base", "depth"]).select("conv_id", "depth", "digest", "words")
    length = F.col("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), own.union(borrowed)


def prefixes(rows: DataFrame, settings: Settings) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words): the names of each turn's node and of the node's parent."""
    lanes = [F.xxhash64(F.lit(k), "depth", "digest").alias(n) for k, n in ((1, "hx"), (2, "hy"))]
    part = F.floor(F.col("depth") / settings.slice_turns)
    hashed = staged(rows.select("conv_id", "depth", "words", *lanes, part.alias("slice")))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "slice").agg(F.bit_xor("hx").alias("sx"), F.bit_xor("hy").alias("sy"))
    carry = sums.select("conv_id", "slice", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias("c" + s[1]) for s in ("sx", "sy")])
    inside = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    joined = hashed.join(carry, ["conv_id", "slice"])
    for n in "xy":
        joined = joined.withColumn(n, F.bit_xor("h" + n).over(inside).bitwiseXOR(F.col("c" + n)))
    return joined.select("conv_id", "depth", "x", "y", *[F.col(n).bitwiseXOR(F.col("h" + n)).alias("p" + n) for n in "xy"], "words")


def trie(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(turns(conversations), settings)
    convs = staged(convs)
    paths = staged(prefixes(rows, settings))
    least = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    inner = paths.groupBy("depth", "x", "y").agg(*least, F.max("px").alias("px"), F.max("py").alias("py"), F.max("words").alias("words"))
    root = convs.agg(*least).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("words"))
    # Numbers stay as they are once the table is written.
    nodes = staged(inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = staged(nodes.join(parents, ["px", "py"], "left").drop("px", "py"))
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = staged(linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    held = tree.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(held, ["n_leaves", "saved_tokens"])
    last = convs.filter("length > 0").select("conv_id", F.col("length").alias("depth")).join(paths, ["conv_id", "depth"]).select("x", "y", "conv_id")
    ends = id_hashes(last.union(convs.filter("length = 0").select(zero, zero, "conv_id")))
    out = tree.join(totals, "node").join(ends, ["x", "y"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def id_hashes(members: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of (x, y, conv_id): the hash of each group's ids, ascending and comma-joined.

    Ids are first written together in pieces in range-sorted parts; a hash, sequential by nature,
    is then fed piece by piece, so that it never holds a group.
    """

    def keyed(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns[:columns]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"x": key[0], "y": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=schema)

        schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for x, y, conv_id in keyed(batches, 3):
            if ids and (key != (x, y) or len(ids) == IDS):
                yield piece()
                ids = []
            key = (x, y)
            ids.append(conv_id)
        if ids:
            yield piece()

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for x, y, _, ids in keyed(batches, 4):
            if key == (x, y):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                yield pa.RecordBatch.from_pylist([{"x": key[0], "y": key[1], "ends_sha256": state.hexdigest()}])
            key, state = (x, y), hashlib.sha256(ids.encode())
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"x": key[0], "y": key[1], "ends_sha256": state.hexdigest()}])

    laid = staged(members).repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    pieces = laid.mapInArrow(write, "x long, y long, first long, ids string")
    return pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(feed, "x long, y long, ends_sha256 string")


def subtree_totals(forest: DataFrame, values: Sequence[str], rounds: list[int] | None = None) -> DataFrame:
    """(node, values): sums over each node's subtree, its own value included.

    ``forest`` has (node, parent, values), all long; ``node`` is unique, roots have no parent.
    ``rounds`` gets the number of nodes left before each round.
    """
    kept = [F.col(v).cast("long").alias(v) for v in values]
    links = ["link_" + v for v in values]  # what lies on the way to the parent
    kids = forest.filter("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    live = forest.select("node", "parent", *kept, *[F.lit(0).cast("long").alias(k) for k in links]).join(kids, "node", "left")
    live = staged(live.withColumn("inner", F.coalesce("inner", F.lit(False))))
    raked, taken, turn = [], [], 0
    while left := live.count():
        if rounds is not None:
            rounds.append(left)
        raked.append(live.filter("not inner").select("node", *values))
        # Rake: leaves are added up before the shuffle, so a node of very many leaves is no burden.
        leaf = ~F.col("inner")
        sums = [F.sum(F.when(leaf, F.col(v) + F.col(k)).otherwise(0)).alias("from_" + v) for v, k in zip(values, links)]
        only = [F.count_if("inner").alias("n"), F.bit_xor(F.when(F.col("inner"), F.col("node")).otherwise(0)).alias("only")]
        only += [F.sum(F.when(leaf, 0).otherwise(F.col(k))).alias("only_" + k) for k in links]  # of the only child, if n is 1
        given = live.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(*sums, *only)
        state = live.filter("inner").drop("inner").join(given, "node")
        state = state.select("node", "parent", *[(F.col(v) + F.col("from_" + v)).alias(v) for v in values], *links, "n", "only", *["only_" + k for k in links])
        # Compress: a node above its only child goes if its rank tops those of both neighbours.
        rank = {c: F.xxhash64(c, F.lit(turn)) for c in ("node", "parent", "only")}
        goes = (F.col("n") == 1) & F.col("parent").isNotNull() & (rank["node"] > rank["only"]) & (rank["node"] > rank["parent"])
        state = staged(state.withColumn("goes", F.coalesce(goes, F.lit(False))))
        gone = state.filter("goes")
        taken.append(gone.select("node", F.col("only").alias("to"), *[(F.col(v) + F.col("only_" + k)).alias(v) for v, k in zip(values, links)]))
        moved = gone.select(F.col("only").alias("node"), F.col("parent").alias("up"), *[(F.col(v) + F.col(k)).alias("more_" + k) for v, k in zip(values, links)])
        stays = state.filter("not goes").join(moved, "node", "left")
        longer = [(F.col(k) + F.coalesce("more_" + k, F.lit(0))).alias(k) for k in links]
        live = staged(stays.select("node", F.coalesce("up", "parent").alias("parent"), *values, *longer, (F.col("n") > 0).alias("inner")))
        turn += 1
    if not raked:
        return forest.select("node", *kept)
    known = raked[0]
    for some in raked[1:]:
        known = known.union(some)
    refs = staged(_union(taken))
    # A reference leads to a node taken out later or raked, so doubling ends after log2(rounds) steps.
    reach = 1
    while reach < turn:
        ahead = refs.select(F.col("node").alias("to"), F.col("to").alias("beyond"), *[F.col(v).alias("more_" + v) for v in values])
        summed = [(F.col(v) + F.coalesce("more_" + v, F.lit(0))).alias(v) for v in values]
        refs = staged(refs.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), *summed))
        reach *= 2
    known = staged(known)
    found = refs.join(known.select(F.col("node").alias("to"), *[F.col(v).alias("more_" + v) for v in values]), "to")
    return known.union(found.select("node", *[(F.col(v) + F.col("more_" + v)).alias(v) for v in values]))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
