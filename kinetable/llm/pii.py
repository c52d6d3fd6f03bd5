"""Personal data: identifiers in plain and in disguised spelling, with source offsets.

Plain e-mail addresses, IPv4 addresses, card numbers and phone numbers are found in the text as
it is.  Then a chain of transducers rewrites disguises - look-alike characters, invisible
characters, spelled digits, spelled "at" and "dot" - each keeping for every output character
the span of input it stands for.  Identifiers found at the end of the chain are mapped back
through all tapes; those that no plain span of their kind contains are added.

Offsets are code points, ends exclusive.  Cases: null and empty texts have no spans; rules
that fail (address parts over 255, digits that fail the checksum or their number) drop the
match without a second try; every row stands for itself, repeated or not.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Possessive runs match what plain ones do here, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυκ", "ABESIJKMHOPCTYXaeopcyxijsdqwhABEZHIKMNOPTYXoavipuk", strict=True))
# Digit words in English, French, German and Spanish.
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq sept huit neuf".split(), "012345789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
}
#: Characters besides Latin letters, whose folding is looked up.
ODD = re.compile(r"[^\x00-\x7FÀ-ſ]")
INVISIBLE = frozenset("​‌‍⁠﻿­")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+(?={_WORD}))?{_WORD}(?:[ -]{{1,2}}(?:{_WORD}|[0-9]+))*[ -]{{1,2}}{_WORD}(?!\w)", re.I)
SPELLED_PART = re.compile(rf"plus[ -]+|{_WORD}", re.I)
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu"
_DOT = r"(?: *[\[({<] *(?:dot|\.) *[\])}>] *| +dot +)"
AT = re.compile(rf" *[\[({{<] *(?:at|@) *[\])}}>] *| +at +(?=[A-Za-z0-9-]+(?:{_DOT}|\.(?:{DOMAINS})\b))", re.I)
DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.I)

Found = Iterator[tuple[int, int]]


def emails(text: str) -> Found:
    """Leftmost non-overlapping addresses, found from their @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Found:
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Found:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = [int(c) for c in m.group() if c not in " -"]
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def luhn(digits: list[int]) -> bool:
    doubled = (2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def phones(text: str) -> Found:
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield m.span()


def identifiers(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    finders: list[tuple[str, Callable[[str], Found]]] = [("email", emails)]
    if DIGIT.search(text):
        finders += [("ip", addresses), ("card", cards), ("phone", phones)]
    for kind, finder in finders:
        for start, end in finder(text):
            yield kind, start, end


class Tape:
    """A rewritten text; ``source`` maps spans of it back to the text it was made from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), ascending and apart."""
        out, self.at, self.runs, length, free = [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for piece, span in ((text[free:start], None), (new, (start, end))):
                if piece:
                    self.at.append(length)
                    self.runs.append((free, span))
                    out.append(piece)
                    length += len(piece)
            free = end
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, at: int) -> tuple[int, int]:
        run = bisect_right(self.at, at) - 1
        begin, span = self.runs[run]
        return span if span else (begin + at - self.at[run], begin + at - self.at[run] + 1)


@lru_cache(65_536)
def folded(char: str) -> str:
    """The plain character that an odd one looks like or stands for, else itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain < "\x80" else char


def fold(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in ODD.finditer(text) if (new := folded(m.group())) != m.group()]


def digits(text: str) -> list[tuple[int, int, str]]:
    """Digit words in runs of at least four digits, and the "plus" before such a run."""
    edits = []
    for m in SPELLED.finditer(text):
        parts = list(SPELLED_PART.finditer(text, *m.span()))
        if len(re.findall(r"[^\s-]+", m.group())) >= 4:
            edits += [(p.start(), p.end(), DIGIT_WORDS.get(p.group().lower(), "+")) for p in parts]
    return edits


def signs(text: str) -> list[tuple[int, int, str]]:
    """Spelled or bracketed at and dot signs in places where an address can be."""
    found = [(m.start(), m.end(), "@") for m in AT.finditer(text)] + [(m.start(), m.end(), ".") for m in DOT.finditer(text)]
    edits: list[tuple[int, int, str]] = []
    for edit in sorted(found):
        if not edits or edit[0] >= edits[-1][1]:
            edits.append(edit)
    return edits


#: A transducer runs where its hint is in the lower-case text.
_AT_HINTS = ("dot", "(at", "[at", "{at", "<at", "( at", "[ at", "(@", "[@", " at ", "(.", "[.")
CHAIN: tuple[tuple[Callable[[str], bool], Callable[[str], list]], ...] = (
    (lambda low: ODD.search(low) is not None, fold),
    (lambda low: any(w in low for w in DIGIT_WORDS), digits),
    (lambda low: any(h in low for h in _AT_HINTS), signs),
)


def spans(text: str | None) -> list[dict]:
    """All spans by kind, then start: kind, start, end, base (found as it is), value."""
    text = text or ""
    base = list(identifiers(text))
    tapes: list[Tape] = []
    current = text
    for hint, transducer in CHAIN:
        if hint(current.lower()) and (edits := transducer(current)):
            tapes.append(Tape(current, edits))
            current = tapes[-1].text
    added = []
    if tapes:
        for kind, start, end in identifiers(current):
            value = current[start:end]
            for tape in reversed(tapes):
                start, end = tape.source(start, end)
            if not any(k == kind and s <= start and end <= e for k, s, e in base):
                added.append((kind, start, end, False, value))
    found = [(k, s, e, True, text[s:e]) for k, s, e in base] + added
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [dict(zip(("kind", "start", "end", "base", "value"), x)) for x in found]


def spans_column(text: str = "text") -> Column:
    """Spans of each text as an array of structs; only the text travels to Python."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,base:boolean,value:string>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([spans(t.as_py()) for t in texts], type=pa.list_(SPAN))

    return found(F.col(text))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), one row per document."""
    return docs.select("doc_id", spans_column().alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksum of the plain spans, text of all spans, number of the added ones."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(k) for k in KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
