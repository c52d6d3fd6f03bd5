"""Column functions on URLs, titles and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where an 11-character video id can stand in a URL, and the canonical form.
ID_PATTERN = r"(?:v=|/vi/|youtu\.be/|/v/|/embed/|/shorts/|/live/)([0-9A-Za-z_-]{11})"
BARE_ID = r"^[0-9A-Za-z_-]{11}$"
CANONICAL = "https://www.youtube.com/watch?v="
URL_IN_TEXT = r"""https?://[^\s\)'"]+"""


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def extract_video_id(text: Column) -> Column:
    """The 11-character id of a bare id or URL; null if there is none."""
    raw = strip(text)
    found = F.nullif(F.regexp_extract(raw, ID_PATTERN, 1), F.lit(""))
    return F.when(raw.rlike(BARE_ID), raw).otherwise(found)


def canonical_url(text: Column) -> Column:
    video = extract_video_id(text)
    return F.when(video.isNotNull(), F.concat(F.lit(CANONICAL), video)).otherwise(strip(text))


def url_key(text: Column) -> Column:
    """Identity of a source: its video id, else its stripped URL."""
    return F.coalesce(extract_video_id(text), strip(text))


def url_in_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, URL_IN_TEXT, 0), F.lit(""))


def fmt_duration(seconds: Column) -> Column:
    """``Xm Ys``."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), whole % 60)


def fmt_clock(seconds: Column) -> Column:
    """``mm:ss.mmm``."""
    whole = F.floor(seconds).cast("long")
    millis = F.floor(seconds * 1000).cast("long") % 1000
    return F.format_string("%02d:%02d.%03d", F.floor(whole / 60).cast("long"), whole % 60, millis)


def chunk_name(worker: Column, stamp: Column, index: Column) -> Column:
    # Archive naming scheme.
    return F.format_string("dataset_chunk_%s_%s_%04d.tar.gz", worker, stamp, index)


def chunk_worker(name: Column) -> Column:
    """Worker part of an archive name."""
    return F.split(F.replace(name, F.lit("dataset_chunk_"), F.lit("")), "_")[0]


def megabytes(size: Column) -> Column:
    return F.bround(size / (1024.0 * 1024.0), 2)


def gigabytes(size: Column) -> Column:
    return F.bround(size / (1024.0 * 1024.0 * 1024.0), 2)


def status_badge(recording: Column, state: Column, faces: Column) -> Column:
    # Badge texts.
    return (
        F.when(recording & (state == "ACTIVE_SPEECH"), "[*] RECORDING: ACTIVE SYLLABLE SPEECH")
        .when(recording & (state == "CONVERSATIONAL_PAUSE"), "[*] RECORDING: CONVERSATIONAL PAUSE / IDLE")
        .when(faces > 1, "[!] PAUSED: MULTIPLE FACES DETECTED (Strict Single-Face Gate)")
        .when(faces == 1, "[-] WAITING: SILENCE / LISTENER DETECTED (Audio Gate Closed)")
        .otherwise("[-] SEARCHING: NO FACE DETECTED IN TARGET WINDOW")
    )
