"""Fill-in-middle: texts cut at two token ranks and put together for infilling.

The tokens of a text are the nodes of an indexable skip list.  Every link of every lane carries
two widths, how many units (tokens) and how many code points it spans; going down from the
highest lane and adding up widths, a rank is reached in about as many steps as the logarithm
of the text, together with its exact code point.  Which nodes rise to a lane is drawn from the
hash of their rank, so a retry builds the same list.

A document becomes ``plain`` (the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
prefix, middle), with sentinels between the parts; :func:`restored` gives the text back.

Cases: a null text is empty; empty texts and texts that hold a sentinel stay plain; a null id
counts as the empty string in the draw, repeated ids draw alike; cuts may be equal or at the
ends, which leaves parts empty.  Only the id and the text are read, so other columns of the
table can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points looked at together, which bounds what tokenising adds to a text's own memory.
PIECE = 1 << 20
#: One node in so many rises to the next lane.
RISE = 4


@dataclass(frozen=True)
class Settings:
    """Seed of the draw, share of documents cut, share of these in ``spm`` (both in hundredths), sentinels."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")


class SkipList:
    """Indexable skip list over nodes of given widths in code points, one unit each."""

    def __init__(self, widths: np.ndarray):
        self.size, self.width = len(widths), int(widths.sum())
        #: Per lane: units and code points that each link spans, and its end's place one lane below.
        self.lanes = [(np.ones(len(widths), np.int64), widths.astype(np.int64), np.arange(len(widths)))]
        ranks = np.arange(1, len(widths) + 1, dtype=np.uint64)
        drawn = ranks * np.uint64(0x9E3779B97F4A7C15)
        drawn ^= drawn >> np.uint64(32)
        while len(ranks) > RISE:
            up = np.flatnonzero(drawn % np.uint64(RISE) == 0)
            if not len(up):
                break
            units, chars, _ = self.lanes[-1]
            starts = np.concatenate([[0], up[:-1] + 1])
            last = up[-1] + 1  # nodes after the lane's last one are reached from below
            self.lanes.append((np.add.reduceat(units[:last], starts), np.add.reduceat(chars[:last], starts), up))
            ranks, drawn = ranks[up], drawn[up] // np.uint64(RISE)

    def find(self, rank: int) -> int:
        """Code points spanned by the first ``rank`` units."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        at, seen, passed = -1, 0, 0  # place of the node reached in this lane, before its first: -1
        for units, chars, below in reversed(self.lanes):
            while at + 1 < len(units) and seen + units[at + 1] <= rank:
                at += 1
                seen, passed = seen + int(units[at]), passed + int(chars[at])
            at = int(below[at]) if at >= 0 else -1
        return passed


def token_widths(text: str) -> np.ndarray:
    """Code points of each token: white space and the word after it, or white space at the end."""
    ends, inside = [], False
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        word = (codes != 0x20) & ((codes < 0x09) | (codes > 0x0D))
        before = np.concatenate([[inside], word[:-1]])
        ends.append(np.flatnonzero(before & ~word) + start)
        inside = bool(word[-1])
    found = np.concatenate([*ends, [len(text)]]) if text else np.empty(0, np.int64)
    return np.diff(found, prepend=0)


def draws(doc_id: str | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the id's hash."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: str | None, text: str | None, settings: Settings = Settings()) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    widths = token_widths(text)
    n = len(widths)
    one, two, three, four = draws(doc_id, settings.seed)
    p, s, m = settings.sentinels
    if not text or three % 100 >= settings.rate or any(x in text for x in settings.sentinels):
        return n, "plain", None, None, text
    units = SkipList(widths)
    start, end = (units.find(rank) for rank in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if four % 100 < settings.spm:
        return n, "spm", start, end - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", start, end - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output."""

    @F.arrow_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>")
    def made(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows: Iterator = zip(*(rearranged(i.as_py(), t.as_py(), settings) for i, t in zip(ids, texts)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(rows) or [[] for _ in kinds]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.StructArray.from_arrays(arrays, names=["n", "form", "prefix_chars", "middle_chars", "output"])

    found = docs.select(F.col(doc_id).alias("doc_id"), made(F.col(doc_id).cast("string"), F.col(text)).alias("s"))
    return found.select("doc_id", "s.n", "s.form", "s.prefix_chars", "s.middle_chars", "s.output")


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output of :func:`fill_in_middle` was made from.

    No part holds a sentinel, and none can arise across a border, since no sentinel starts as
    another one ends; so the first occurrence of each is the border.
    """
    p, s, m = settings.sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        before = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(before) + len(second) + 1, F.lit(2**31 - 1))
        between = F.substring_index(rest, m, 1)
        return before, between, F.substring(rest, F.length(between) + len(m) + 1, F.lit(2**31 - 1))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Outputs replaced by their hashes and those of the restored texts."""
    back = restored(F.col("output"), F.col("form"), settings)
    hashes = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)
