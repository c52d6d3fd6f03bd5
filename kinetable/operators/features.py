"""Audio feature jobs: stand-in spectra, frame energies, slices and log-mel bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import audio

FFT = 512
BANDS = 64


def fallback_spectrum(df: DataFrame, key=("session_id",), from_rows: DataFrame | None = None) -> DataFrame:
    """Replace the spectra of sessions that have energy but no spectra at all.

    ``from_rows`` is a cheaper table of the same rows to judge the sessions by.
    """
    largest = F.array_max("spectral")
    per = (df if from_rows is None else from_rows).groupBy(*key).agg(F.max(largest).alias("_band"), F.max("energy").alias("_energy"))
    empty = (F.col("_band") < 1e-5) & (F.col("_energy") > 1e-4)
    made = audio.spread_spectrum(F.col("energy"), F.col("prob"))
    return df.join(per, list(key)).withColumn(
        "spectral", F.when(empty, made).otherwise(F.col("spectral"))
    ).select(*df.columns)


def frame_rms(df: DataFrame, hop: int, key: str = "session_id", samples: str = "samples") -> DataFrame:
    """RMS of every full hop of samples, scaled by the largest of its recording.

    A recording is one row, or pieces with an ``offset`` column; a piece gives the sums of
    squares of the hops it touches, and hops across pieces add them up.
    """
    offset = F.col("offset").cast("long") if "offset" in df.columns else F.lit(0).cast("long")
    touched = F.sequence(F.floor(offset / hop), F.floor((offset + F.size(samples) - 1) / hop))

    def part(frame: Column) -> Column:
        start = F.greatest(frame * hop - offset, F.lit(0))
        n = F.least((frame + 1) * hop - offset, F.size(samples)) - start
        inner = F.slice(F.col(samples), (start + 1).cast("int"), n.cast("int"))
        squares = F.aggregate(inner, F.lit(0.0), lambda done, x: done + x.cast("double") * x.cast("double"))
        return F.struct(frame.alias("frame"), n.alias("n"), squares.alias("squares"))

    parts = df.filter(F.size(samples) > 0).select(key, F.explode(F.transform(touched, part)).alias("p"))
    sums = parts.groupBy(key, "p.frame").agg(F.sum("p.n").alias("_n"), F.sum("p.squares").alias("_squares")).filter(F.col("_n") == hop)
    values = sums.select(key, "frame", F.sqrt(F.col("_squares") / hop).alias("rms"))
    top = values.groupBy(key).agg(F.max("rms").alias("_top"))
    return values.join(top, key).select(
        key, "frame", F.when(F.col("_top") > 0, F.col("rms") / F.col("_top")).otherwise(F.col("rms")).alias("rms")
    )


def slice_audio(frames: DataFrame, clips: DataFrame, rate: int = 16000, fps: float = 30.0, key: str = "session_id",
                t: str = "t", block: int | None = None) -> DataFrame:
    """Samples of each frame, zeros where the recording has none: ``rate/fps`` samples from ``int(t * rate)``.

    ``clips`` holds one recording as rows of (key, offset, samples).  They are cut into blocks (by default
    as long as a frame's samples), and a frame meets only the blocks its samples lie in, through an
    equi-join on the block number: what is joined grows with the frames' samples, however long pieces are.
    """
    length = int(rate * (1.0 / max(1.0, fps)))
    block = block or max(1, length)
    start = (F.col(t) * rate).cast("long")
    # Equal frames share one window, which is joined back to each of them.
    placed = frames.withColumn("_from", start)
    wanted = placed.select(key, "_from").distinct().withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + length - 1) / block)))
    )
    first = F.floor(F.col("offset") / block)
    last = F.floor((F.col("offset") + F.size("samples") - 1) / block)

    def within(number: Column) -> Column:
        start = F.greatest(F.col("offset"), number * block)
        n = F.least(F.col("offset") + F.size("samples"), (number + 1) * block) - start
        inner = F.slice("samples", (start - F.col("offset") + 1).cast("int"), n.cast("int"))
        return F.struct(number.alias("_block"), F.col("offset").alias("_begun"), start.alias("offset"), inner.alias("samples"))

    parts = F.explode(F.transform(F.sequence(first, last), within)).alias("_part")
    pieces = clips.filter(F.size("samples") > 0).select(key, parts).select(key, "_part.*")
    low = F.greatest(F.col("_from"), F.col("offset"), F.col("_block") * block)
    high = F.least(F.col("_from") + length, F.col("offset") + F.size("samples"), (F.col("_block") + 1) * block)
    met = wanted.join(pieces, [key, "_block"], "left").withColumn("_low", low).withColumn("_n", (high - low).cast("int"))
    piece = F.when(
        F.col("offset").isNotNull() & (F.col("_n") > 0),
        F.struct(
            F.col("_low").alias("at"),
            F.col("_begun").alias("begun"),
            F.slice("samples", (F.col("_low") - F.col("offset") + 1).cast("int"), F.col("_n")).alias("s"),
        ),
    )
    # No more pieces than blocks and recordings that meet one window.
    out = met.groupBy(key, "_from").agg(F.array_sort(F.collect_list(piece)).alias("_p"))

    def place(done, p):
        """Each piece at its own offset: gaps become zeros, what an earlier piece holds is skipped."""
        at = (p["at"] - F.col("_from")).cast("int")
        zeros = F.array_repeat(F.lit(0.0), F.greatest(at - F.size(done), F.lit(0)))
        held = F.greatest(F.size(done) - at, F.lit(0))
        rest = F.slice(p["s"].cast("array<double>"), held + 1, F.greatest(F.size(p["s"]) - held, F.lit(0)))
        return F.concat(done, zeros, rest)

    body = F.aggregate("_p", F.array().cast("array<double>"), place)
    padded = out.select(key, "_from", body.alias("_body")).withColumn(
        "samples", F.concat("_body", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_body")))
    )
    return placed.join(padded, [key, "_from"], "left").select(*frames.columns, "samples")


def mel_filterbank(rate: int = 16000, bands: int = BANDS, fft: int = FFT, low: float = 60.0) -> np.ndarray:
    """Triangular filters, equally spaced in mel between ``low`` and half the rate.

    A rate that leaves nothing between them would make all bands silent; it is an error.
    """
    if low >= rate / 2.0:
        raise ValueError(f"no band lies between {low} Hz and half of {rate} Hz")

    def mel(hz):
        return 2595.0 * np.log10(1.0 + hz / 700.0)

    grid = np.linspace(mel(low), mel(rate / 2.0), bands + 2)
    edges = np.floor((fft + 1) * (700.0 * (10.0 ** (grid / 2595.0) - 1.0)) / rate).astype(int)
    freq = np.arange(fft // 2 + 1)[None, :]
    left, centre, right = (edges[i : i + bands, None] for i in (0, 1, 2))
    rising = np.where((freq >= left) & (freq < centre), (freq - left) / np.maximum(centre - left, 1), 0.0)
    falling = np.where((freq >= centre) & (freq < right), (right - freq) / np.maximum(right - centre, 1), 0.0)
    return (rising + falling).astype(np.float32)


def log_mel_matrix(frames: np.ndarray, bank: np.ndarray, fft: int = FFT) -> np.ndarray:
    """Log-mel bands of frames that already have ``fft`` samples each."""
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(fft).astype(np.float32), n=fft, axis=1))
    energy = (spectrum**2 / float(fft)) @ bank.T
    return np.clip(np.log1p(1e4 * energy) / 10.0, 0.0, 1.0).astype(np.float32)


def centred(samples, fft: int = FFT) -> np.ndarray:
    """Pad or crop around the middle to ``fft`` samples."""
    x = np.zeros(0, np.float32) if samples is None else np.asarray(samples, np.float32)
    if len(x) >= fft:
        at = (len(x) - fft) // 2
        return x[at : at + fft]
    lead = (fft - len(x)) // 2
    return np.pad(x, (lead, fft - len(x) - lead))


def log_mel(df: DataFrame, samples: str = "samples", rate: int = 16000, name: str = "spectral") -> DataFrame:
    """Add the 64 log-mel bands of each row's samples (one Arrow batch at a time)."""
    bank = mel_filterbank(rate)

    @F.pandas_udf("array<float>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            values = log_mel_matrix(np.stack([centred(s) for s in batch]), bank)
            empty = batch.map(lambda s: s is None or len(s) == 0).to_numpy()
            values[empty] = 0.0
            yield pd.Series(list(values))

    return df.withColumn(name, bands(F.col(samples)))


def log_mel_sequence(frames: DataFrame, clips: DataFrame, rate: int = 16000, key: str = "session_id", t: str = "t") -> DataFrame:
    """Log-mel bands around ``round(t * rate)`` of a peak-normalized recording.

    ``clips`` holds the recording in pieces (key, offset, samples); the peak is an
    aggregate over the pieces, which are scaled before windows repeat their samples; the
    window of a frame comes from :func:`slice_audio`, in the single precision the bands are made from.
    """
    peak = clips.groupBy(key).agg(F.max(F.array_max(F.transform("samples", lambda x: F.abs(x)))).alias("_peak"))
    centre = F.bround(F.col(t) * rate).cast("long")
    # A window starts half its length early; a shifted clock keeps starts non-negative.
    at = (centre - FFT // 2 + FFT) / F.lit(float(rate))
    scaled = F.when(F.col("_peak") > 1e-4, F.transform("samples", lambda x: x / F.col("_peak"))).otherwise(F.col("samples"))
    shifted = clips.join(peak, key).select(key, (F.col("offset") + FFT).alias("offset"), scaled.cast("array<float>").alias("samples"))
    # Sessions without a recording keep their frames, with silence.
    windows = slice_audio(frames.withColumn("_at", at + 1e-9), shifted, rate, rate / FFT, key, "_at")
    return log_mel(windows.drop("_at"), rate=rate).drop("samples")
