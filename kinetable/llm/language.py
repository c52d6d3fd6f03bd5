"""Language identification by partial matching: one byte context tree per language.

A tree holds the byte strings of up to ``order`` bytes that are frequent in a language, each
with the counts of the bytes that follow it.  The longest suffix of what has been read that is
in the tree predicts the next byte; a byte not seen there costs an escape (method C: as many
chances as there are distinct followers) and is sought in the next shorter context, leaving
out what the longer one could have given, down to equal chances.  Statistics are frozen, so a
text's code length in a language is a sum of fixed numbers, and the shortest code wins.

Spark counts the contexts of a bounded sample of distinct learned texts: about the first
``fit_rows`` of each language in hash order, whole.  A context is kept if it makes up at least one in
``contexts`` of its language's bytes, which bounds the trees at every size of the sample.  For
scoring, the trees become one automaton whose states are the contexts of any of them, with the
exact cost of each byte in each language; numpy walks all positions of a text together.

Cases: ``lang`` null is not learned from, nor are rows without an id; the text decides alone.
Texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with
score 0; equal code lengths give the language that sorts first.  Repeated texts of a language
are learned once; very long texts are read in pieces; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.session import staged

#: Positions scored together, and bytes counted together; both bound a task's memory.
PIECE, FLUSH = 1 << 15, 1 << 21
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Longest context (at most 6), least count and share of a context, texts learned per language."""

    order: int = 4
    least: int = 2
    contexts: int = 4096
    fit_rows: int = 600
    seed: int = 42


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, text) of about the first ``fit_rows`` distinct texts in hash order of each language.

    Hashes are evenly spread, so the share of texts wanted is the share of the range of hashes
    taken: no language is sorted.
    """
    known = docs.select("doc_id", "lang", "text").filter("lang is not null and doc_id is not null and text is not null")
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("text", F.lit(settings.seed)))
    firsts = staged(known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")))
    shares = firsts.groupBy("lang").agg((settings.fit_rows / F.count(F.lit(1))).alias("share"))
    place = F.col("h").cast("double") / 2.0**64 + 0.5  # from 0 to 1
    picked = firsts.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("lang", "h", "doc_id")  # a row per language
    # Some fit_rows rows per language, at any size of the corpus.
    return known.join(F.broadcast(picked), ["lang", "h", "doc_id"]).select("lang", "text")


def windows(data: bytes, size: int) -> np.ndarray:
    """Every run of ``size`` bytes of ``data`` as one number."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(codes) - size + 1), dtype=np.int64)
    for i in range(size if len(out) else 0):
        out = (out << 8) | codes[i : i + len(out)]
    return out


def follower_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """(lang, size, context, byte, n): followers of every context of the texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, bytes]]] = {}  # pieces of texts after up to ``order`` bytes of what came before
        pending = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, pieces in held.items():
                for size in range(settings.order + 1):
                    runs = [windows(data[max(0, before - size) :], size + 1) for before, data in pieces]
                    keys, counts = np.unique(np.concatenate(runs), return_counts=True)
                    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys >> 8), pa.array((keys & 255).astype(np.int32)), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "context", "byte", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for start in range(0, len(data), FLUSH):
                    before = min(start, settings.order)
                    held.setdefault(lang.as_py(), []).append((before, data[start - before : start + FLUSH]))
                    pending += min(FLUSH, len(data) - start)
                    if pending >= FLUSH:
                        yield from flush()
                        pending = 0
        yield from flush()

    rows = texts.select("lang", "text").mapInArrow(count, "lang string, size int, context long, byte int, n long")
    return rows.groupBy("lang", "size", "context", "byte").agg(F.sum("n").alias("n"))


def kept_contexts(counts: DataFrame, settings: Settings) -> DataFrame:
    """The rows of the contexts that are frequent enough; never more than order times ``contexts`` per language."""
    counts = staged(counts)
    sums = counts.groupBy("lang", "size", "context").agg(F.sum("n").alias("m"))
    total = sums.filter("size = 0").select("lang", F.col("m").alias("total"))
    least = F.greatest(F.lit(settings.least), F.ceil(F.col("total") / settings.contexts))
    frequent = sums.join(total, "lang").filter((F.col("size") == 0) | (F.col("m") >= least)).select("lang", "size", "context")
    return counts.join(frequent, ["lang", "size", "context"])


@dataclass(frozen=True)
class Model:
    """``follow[state, class]`` is the next state, ``bits[state * classes + class]`` a row of costs per language."""

    langs: list[str]
    order: int
    classes: np.ndarray
    follow: np.ndarray
    bits: np.ndarray

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits that each language's tree takes for the whole text."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        width, costs = self.follow.shape[1], self.bits.shape[0] // len(self.follow)
        follow, sums = self.follow.ravel(), np.zeros(len(self.langs))
        pad = np.full(self.order, width - 1, dtype=np.int64)  # before the start: back to the empty context
        for start in range(0, len(data), PIECE):
            read = self.classes[data[max(0, start - self.order) : start + PIECE]]
            if start == 0:
                read = np.concatenate([pad, read])
            n = len(read) - self.order
            state = np.zeros(n, dtype=np.int64)
            for k in range(self.order):
                state = follow[state * width + read[k : k + n]]
            sums += np.take(self.bits, state * costs + read[self.order :], axis=0).sum(axis=0, dtype=np.float64)
        return sums

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """(language, its chance if all were equally likely before, bits a byte in it)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, None
        sums = self.code_lengths(text)
        best = int(sums.argmin())
        share = 1.0 / np.exp2(np.maximum(sums[best] - sums, -1000.0)).sum()
        return self.langs[best], float(share), float(sums[best] / len(text.encode("utf-8", "surrogatepass")))


def escaped_costs(counts: list[np.ndarray], shorter: list[np.ndarray]) -> list[np.ndarray]:
    """Bits of each class after each context of one tree, by sizes of contexts.

    ``counts[k]`` has a row of follower counts per context of size k, ``shorter[k]`` the row of
    its next shorter context.  The last class stands for any one byte that nothing has seen.
    """
    out, below, seen_below = [], None, None
    for size, table in enumerate(counts):
        seen = table > 0
        if size == 0:
            rest = 256 - seen.sum(axis=1, keepdims=True)
            after = np.where(seen, 0.0, 1.0 / np.maximum(rest, 1))  # chances once this context has escaped
        else:
            at = shorter[size]
            left = np.where(seen, 0, counts[size - 1][at])  # what the shorter context offers beyond this one
            offered, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
            shared = offered + kinds
            escape = np.where(shared > 0, kinds / np.maximum(shared, 1), 1.0)
            after = np.where(seen_below[at], left / np.maximum(shared, 1), escape * below[at])
        total, kinds = table.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        chance = np.where(seen, table / (total + kinds), kinds / (total + kinds) * after)
        out.append(-np.log2(np.maximum(chance, 1e-300)))
        below, seen_below = after, seen
    return out


def build(rows: pd.DataFrame, settings: Settings) -> Model:
    """The automaton of the trees given as (lang, size, context, byte, n)."""
    langs = sorted(rows["lang"].unique())
    used = np.sort(rows["byte"].unique()).astype(np.int64)
    number = len(used) + 1  # the last one: all other bytes
    classes = np.full(256, number - 1, dtype=np.int64)
    classes[used] = np.arange(len(used))
    order = settings.order
    # States by size of context, so that shorter ones come first.
    found = [np.sort(rows.loc[rows["size"] == k, "context"].unique()).astype(np.int64) for k in range(order + 1)]
    firsts = np.concatenate([[0], np.cumsum([len(f) for f in found])])

    def place(contexts: np.ndarray, size: int) -> np.ndarray:
        """States of contexts of a size, -1 where there is none."""
        if not len(found[size]):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(found[size], contexts), len(found[size]) - 1)
        return np.where(found[size][at] == contexts, at + firsts[size], -1)

    states = int(firsts[-1])
    follow = np.zeros((states, number + 1), dtype=np.int64)  # the last column: before a text's start
    shorter = np.zeros(states, dtype=np.int64)
    for size in range(order + 1):
        mine = np.arange(firsts[size], firsts[size + 1])
        if size:
            shorter[mine] = place(found[size] & ((1 << 8 * (size - 1)) - 1), size - 1)
            follow[mine] = follow[shorter[mine]]
        if size < order and len(mine):
            longer = place(((found[size][:, None] << 8) | used).ravel(), size + 1).reshape(len(mine), len(used))
            follow[mine, : len(used)] = np.where(longer >= 0, longer, follow[mine, : len(used)])
    bits = np.zeros((states * number, len(langs)), dtype=np.float32)
    for column, lang in enumerate(langs):
        tree = rows[rows["lang"] == lang]
        own = np.zeros(states, dtype=np.int64)  # rows of the language's own contexts, over all sizes
        tables, links, count = [], [], 0
        for size in range(order + 1):
            part = tree[tree["size"] == size]
            contexts, at = np.unique(part["context"].to_numpy(dtype=np.int64), return_inverse=True)
            table = np.zeros((len(contexts), number), dtype=np.int64)
            np.add.at(table, (at, classes[part["byte"].to_numpy(dtype=np.int64)]), part["n"].to_numpy(dtype=np.int64))
            mine = np.arange(firsts[size], firsts[size + 1])
            own[mine] = own[shorter[mine]]
            here = place(contexts, size)
            links.append(own[shorter[here]] - (count - len(tables[-1])) if size else np.zeros(len(contexts), np.int64))
            own[here] = np.arange(len(contexts)) + count
            tables.append(table)
            count += len(contexts)
        costs = np.concatenate(escaped_costs(tables, links))
        bits[:, column] = costs[own].ravel()
    return Model(langs, order, classes, follow, bits)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn the trees from documents that may be learned from."""
    kept = kept_contexts(follower_counts(sample(docs, settings), settings), settings)
    return build(kept.toPandas(), settings)  # no more rows than the contexts of the languages have followers


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        rows = [shared.value.predict(t.as_py()) for t in texts]
        columns = zip(*rows) if rows else ([], [], [])
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(arrays, names=["lang_pred", "score", "bits_per_byte"])

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted("text").alias("s"))
    return found.select("doc_id", "held_out", "s.lang_pred", "s.score", "s.bits_per_byte")
