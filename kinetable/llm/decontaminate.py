"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised to lower-case words separated by single spaces, with the source offset of
each character kept.  If a region of a document is within ``k`` edits of an item of ``m``
characters, the two share at least ``m - q + 1 - k q`` q-grams (the q-gram lemma), and the
shared ones lie on at most ``k + 1`` neighbouring diagonals.  Shared q-grams are therefore
counted in overlapping bands of ``2 (k + 1)`` diagonals, bands that reach the bound are kept,
and an alignment banded to those diagonals finds the region and its number of edits.

The benchmark is the query set: it is read in blocks of bounded size, and each block is
searched for in all documents, where its q-gram index is sent along.

Cases: null or empty texts contain nothing; items without q characters can't be told from
chance and are not searched for; equal items are all reported; rows that share an id are
reported together; an empty documents or benchmark table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.session import staged

RESULT = "doc_id long, item_id long, start int, end int, edits int, item_chars int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(n, pa.int32()) for n in ("start", "end", "edits", "item_chars")]])
TABLE_BITS, ROUGH_BITS = 20, 18
UNIT = 1 << 24
#: Normalised characters searched at once, shared q-grams expanded at once, alignments made at once.
PIECE, HITS, ALIGNED = 1 << 18, 1 << 18, 256


@dataclass(frozen=True)
class Settings:
    """``rate``: edits allowed per character of an item; ``block_chars``: items searched in one pass."""

    q: int = 8
    rate: float = 0.1
    block_chars: int = 2_000_000

    def edits(self, size: int) -> int:
        """Edit budget of an item, lowered where the lemma would ask for no shared q-gram."""
        return max(0, min(int(self.rate * size), (size - self.q) // self.q))

    def bound(self, size: int) -> int:
        return size - self.q + 1 - self.q * self.edits(size)


@lru_cache(1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and "is a word character" of each code point of the basic plane."""
    chars = [chr(c) for c in range(1 << 16)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint32)
    return lower, np.array([c.isalnum() for c in chars])


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, source offset of each): lower-case words, single spaces between them."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lower, alnum = alphabet()
    low = np.minimum(codes, 0xFFFF)
    word = alnum[low] | (codes > 0xFFFF)
    after_word = np.append(False, word[:-1]) if len(word) else word
    where = np.flatnonzero(word | after_word)
    out = np.where(word[where], np.where(codes[where] > 0xFFFF, codes[where], lower[low[where]]), 32).astype(np.uint32)
    keep = slice(0, len(out) - 1 if len(out) and out[-1] == 32 else len(out))
    return out[keep], where[keep]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit key of each q-gram (q up to 8), a byte per character; 0 bytes mark gaps between texts."""
    small = np.where(codes == 0, 0, (codes * np.uint32(2654435761) >> np.uint32(24)) % np.uint32(255) + np.uint32(1)).astype(np.uint64)
    keys = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint64)
    power, done, run = 1, 0, small
    while done < q:  # doubling: runs of 1, 2, 4, 8 characters
        if q & power:
            keys |= run[done : done + len(keys)] << np.uint64(8 * done)
            done += power
        if done < q:
            run = run[:-power] | (run[power:] << np.uint64(8 * power)) if len(run) > power else run[:0]
            power *= 2
    return keys


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Index:
    """q-grams of a block of items: sorted keys, and for each its (item, position) places."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        normal = [(i, normalise(t)[0]) for i, t in items]
        normal = [(i, c) for i, c in normal if len(c) >= settings.q]
        self.settings, self.ids, self.codes = settings, [i for i, _ in normal], [c for _, c in normal]
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([settings.edits(m) for m in self.sizes], dtype=np.int64)
        self.bounds = np.array([settings.bound(m) for m in self.sizes], dtype=np.int64)
        keys = [grams(c, settings.q) for c in self.codes]
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.known = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.known[slot(self.keys)] = True
        #: Characters of a region at most, which neighbouring pieces of a long text share.
        self.reach = int((self.sizes + 4 * self.edits + 4).max()) if keys else 0

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of the bands of diagonals in which the bound is met."""
        keys = grams(codes, self.settings.q)
        at = np.flatnonzero(self.known[slot(keys)])
        found = np.searchsorted(self.keys, keys[at])
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == keys[at]
        at, found = at[hit], found[hit]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        many = self.count[found]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), HITS), side="right")
        chunks = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(at)]) if b > a]

        def expand(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = many[a:b]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(self.first[found[a:b]], n) + inner
            item = self.item[row].astype(np.int64)
            # Shifted by the reach, so that bands are never negative.
            return item, (np.repeat(at[a:b], n) - self.place[row] + self.reach) // (self.edits[item] + 1)

        def rough(item: np.ndarray, band: np.ndarray) -> np.ndarray:
            return ((item * 1_000_003 + band) * 2_654_435_761 >> 7) & ((1 << ROUGH_BITS) - 1)

        # Counts by hash are never too small: they drop most shared q-grams before any sorting.
        totals = np.zeros(1 << ROUGH_BITS, dtype=np.int64)
        for a, b in chunks:
            totals += np.bincount(rough(*expand(a, b)), minlength=1 << ROUGH_BITS)
        kept = []
        for a, b in chunks:
            item, band = expand(a, b)
            own, bound = totals[rough(item, band)], self.bounds[item]
            likely = (own + totals[rough(item, band + 1)] >= bound) | (own + totals[rough(item, band - 1)] >= bound)
            kept.append((item[likely] << 40) + band[likely])
        kept, counts = np.unique(np.concatenate(kept), return_counts=True)
        # Band b holds the halves b and b + 1.
        both = np.unique(np.concatenate([kept, kept - 1]))
        total = np.zeros(len(both), dtype=np.int64)
        for shift in (0, 1):
            index = np.searchsorted(kept, both + shift)
            index[index == len(kept)] = 0
            total += np.where(kept[index] == both + shift, counts[index], 0)
        item = both >> 40
        met = total >= self.bounds[item]
        return item[met], both[met] & ((1 << 40) - 1)

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the verified regions of one run of characters."""
        item, band = self.bands(codes)
        for at in range(0, len(item), ALIGNED):
            yield from self.align(codes, item[at : at + ALIGNED], band[at : at + ALIGNED])

    def align(self, codes: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Cheapest alignment of each item within its band's diagonals, all items side by side.

        A cell holds edits * UNIT + offset of the diagonal where the alignment starts.
        """
        k, m = self.edits[item], self.sizes[item]
        left = band * (k + 1) - self.reach - k
        width = int((4 * k + 3).max())
        longest = int(m.max())
        texts = np.zeros((len(item), longest), dtype=np.uint32)
        for row, i in enumerate(item):
            texts[row, : self.sizes[i]] = self.codes[i]
        padded = np.concatenate([codes, [0]])
        source = left[:, None] + np.arange(longest + width)[None]
        source = padded[np.where((source < 0) | (source >= len(codes)), len(codes), source)]
        steps = np.arange(width, dtype=np.int64) * UNIT
        outside = np.arange(width)[None] >= (4 * k + 3)[:, None]
        cost = np.where(outside, 1 << 60, np.arange(width, dtype=np.int64)[None])
        last = np.full(cost.shape, 1 << 60)
        for i in range(longest):
            change = np.where(source[:, i : i + width] == texts[:, i : i + 1], 0, UNIT)
            change[source[:, i : i + width] == 0] = 1 << 50  # never across the edge of a text
            new = cost + change
            np.minimum(new[:, :-1], cost[:, 1:] + UNIT, out=new[:, :-1])
            # Characters only in the document: the cheapest cell to the left plus its distance.
            new = np.minimum.accumulate(new - steps, axis=1) + steps
            new[outside] = 1 << 60
            cost = new
            ended = m == i + 1
            last[ended] = cost[ended]
        best = last.argmin(axis=1)
        value = last[np.arange(len(item)), best]
        for row in np.flatnonzero(value // UNIT <= k):
            yield int(item[row]), int(left[row] + value[row] % UNIT), int(left[row] + m[row] + best[row]), int(value[row] // UNIT)


def search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Regions of each document (doc_id, text) near an item, short texts searched together."""
    run: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        gap = np.zeros(1, dtype=np.uint32)
        codes = np.concatenate([x for _, c, _ in run for x in (c, gap)])
        starts = np.cumsum([0, *[len(c) + 1 for _, c, _ in run]])
        best: dict = {}
        for item, start, end, edits in index.regions(codes):
            at = int(np.searchsorted(starts, start, side="right")) - 1
            doc, _, where = run[at]
            a, b = start - starts[at], end - starts[at]
            if 0 <= a < b <= len(where):
                best.setdefault((at, item), []).append((int(where[a]), int(where[b - 1]) + 1, edits))
        rows = []
        for (at, item), found in sorted(best.items()):
            end = -1
            for start, stop, edits in sorted(found, key=lambda x: (x[0], x[2])):
                if start >= end:  # overlapping bands find the same region again
                    rows.append((run[at][0], index.ids[item], start, stop, edits, int(index.sizes[item])))
                    end = stop
                elif edits < rows[-1][4]:
                    rows[-1], end = (run[at][0], index.ids[item], start, stop, edits, int(index.sizes[item])), stop
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), ARROW)] if rows else [pa.array([], type=f.type) for f in ARROW], schema=ARROW)

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            codes, where = normalise(text.as_py())
            for start in range(0, max(1, len(codes) - index.reach), PIECE):
                piece = slice(start, start + PIECE + index.reach)
                run.append((doc.as_py(), codes[piece], where[piece]))
                held += len(codes[piece])
                if held >= PIECE:
                    yield flush()
                    run, held = [], 0
    if run:
        yield flush()


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_chars``, never more than one in memory."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null and item_id is not null").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= settings.block_chars:
            yield block
            block, held = [], 0
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per region and item: doc_id, item_id, start, end (code points), edits, item_chars."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    found = None
    for block in blocks(benchmark, settings):
        # At most block_chars of text and one table of fixed size.
        shared = context.broadcast(Index(block, settings))
        part = rows.mapInArrow(lambda batches, shared=shared: search(batches, shared.value), RESULT)
        found = part if found is None else found.union(part)
    return found.dropDuplicates(["doc_id", "item_id", "start", "end"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    dirty = contaminated(docs, benchmark, settings).select("doc_id").distinct()
    return docs.join(staged(dirty).hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
