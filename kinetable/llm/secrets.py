"""Secrets, in DataFrame functions alone: fixed forms, and strings of high windowed entropy.

Assignments of passwords and keys, access keys and long hexadecimal strings are found by
pattern.  Other candidates are runs of at least ``Settings.window`` characters of the base64
alphabet.  A window slides over a candidate one character at a time; the Shannon entropy of
its characters is kept up to date from two counts a step, that of the character which enters
and of the one which leaves.  A candidate whose highest entropy reaches the threshold of its
character class is a span, unless the allow-list names it or another span contains it.

Offsets are code points, ends exclusive; the span of an assignment is the whole match.
Cases: null and empty texts have no spans; a match that is too short is dropped and the search
goes on behind it; every row stands for itself.  Two control characters mark matches while
offsets are counted; where a text holds them itself they count as line breaks, which no
pattern contains, so that offsets stay true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
OPEN, CLOSE = "\x01", "\x02"

# The patterns of the plain forms.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class Settings:
    """Window in characters; entropy in bits that a class must reach; what is never a secret."""

    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 3.75
    allow: tuple[str, ...] = (
        r"^[A-Za-z]+$|^[0-9]+$",  # one word or number
        r"(?i)example|sample|placeholder|xxxx|dummy",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
        r"^[a-z]+([-_/][a-z]+)+$|^(/[A-Za-z_-]+)+/?$",  # hyphenated words, paths
    )


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """array<struct<start,end,value>>: leftmost non-overlapping matches, offsets in code points.

    Matches are wrapped in marks and the text is split at them: every second piece is one.
    """
    clean = F.translate(text, OPEN + CLOSE, "\n\n")
    marked = F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE)
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]", -1)

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece)
        hit = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(
            end.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(state["inside"], F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"),
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("hits")), step, lambda s: s["hits"])
    return F.when(F.coalesce(hint, F.lit(False)), found).otherwise(none) if hint is not None else found


def tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def plain_spans(text: Column) -> Column:
    """Spans of the fixed forms: struct<start, order, end, kind, value>."""
    low = F.lower(text)
    keyword = F.lit(False)
    for word in KEYWORDS:
        keyword = keyword | F.contains(low, F.lit(word))
    assign = F.filter(matches(text, ASSIGN, keyword), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: s["end"] - s["start"] >= 20)
    # A run of the class is one match, so its shortest length may as well be part of the pattern.
    hexes = matches(text, HEX[:-1] + "{24,}", F.rlike(text, F.lit(HEX[:-1] + "{24}")))
    return F.concat(tagged("assign", assign), tagged("access", access), tagged("hex", hexes))


def highest_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits, of the windows of ``value``.

    With S the sum of c log2 c over the counts c in the window, the entropy is
    log2(window) - S / window; a step changes S by the terms of two counts.
    """

    def term(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(0.0)

    def step(chars: Column, state: Column, at: Column) -> Column:
        new, old = F.get(chars, at), F.get(chars, at - window)
        # Characters between the one that leaves and the one that enters.
        begin = F.greatest(at - window + 1, F.lit(0))
        inner = F.slice(chars, begin + 1, at - begin)
        entering = F.size(F.filter(inner, lambda c: c == new))
        leaving = F.when(at >= window, F.size(F.filter(inner, lambda c: c == old))).otherwise(F.lit(-1))
        without = state["sum"] - F.when(leaving >= 0, term(leaving + 1) - term(leaving)).otherwise(0.0)
        total = without + term(entering + 1) - term(entering)
        full = at >= window - 1
        least = F.when(full, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(total.alias("sum"), least.alias("least"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1e18).alias("least"))

    def least(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(chars) - 1)
        return F.aggregate(places, start, lambda state, at: step(chars, state, at), lambda s: s["least"])

    # The characters are bound to a lambda variable, so that they are split off once and not at each step.
    sums = F.transform(F.array(F.split(value, "")), least)
    return F.log2(F.lit(float(window))) - F.get(sums, F.lit(0)) / window


def entropy_spans(text: Column, plain: Column, settings: Settings) -> Column:
    """Candidates of high entropy that neither the allow-list nor a plain span covers."""
    pattern = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{settings.window},}}+"
    found = matches(text, pattern, F.rlike(text, F.lit(rf"[A-Za-z0-9+/=_-]{{{settings.window}}}")))

    def secret(s: Column) -> Column:
        value = s["value"]
        allowed = F.lit(False)
        for rule in settings.allow:
            allowed = allowed | F.rlike(value, F.lit(rule))
        covered = F.exists(plain, lambda p: (p["start"] <= s["start"]) & (s["end"] <= p["end"]))
        hexadecimal = F.rlike(value, F.lit(r"^[0-9a-fA-F]+$"))
        bits = F.when(hexadecimal, settings.hex_bits).otherwise(settings.mixed_bits)
        return F.when(allowed | covered, False).otherwise(highest_entropy(value, settings.window) >= bits)

    return tagged("entropy", F.filter(found, secret))


def secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, order, end, kind, value>, sorted by place."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.sort_array(plain_spans(F.col("text"))).alias("base"))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", entropy_spans(F.col("text"), F.col("base"), settings))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksum of the plain spans by start, then kind; text of all spans."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(k) for k in KINDS[:3]],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"),
    )
