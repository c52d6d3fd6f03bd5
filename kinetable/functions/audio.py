"""Column functions on sample arrays, energies and the mel scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hz_to_mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def rms(samples: Column) -> Column:
    squares = F.transform(samples, lambda x: x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(_total(squares) / F.size(samples))).otherwise(F.lit(0.0))


def zcr(samples: Column) -> Column:
    """Mean absolute change of sign, halved."""
    signs = F.transform(samples, lambda x: F.signum(x.cast("double")))
    ahead = F.slice(signs, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0)))
    behind = F.slice(signs, F.lit(1), F.greatest(F.size(samples) - 1, F.lit(0)))
    jumps = F.zip_with(ahead, behind, lambda a, b: F.abs(a - b))
    return F.when(F.size(samples) > 1, _total(jumps) / F.size(jumps) / 2.0).otherwise(F.lit(0.0))


def pcm_to_float(samples: Column, width: int) -> Column:
    """Integer samples of 1, 2 or 4 bytes to [-1, 1); others pass through."""
    # Full scale per sample width.
    if width == 1:
        return F.transform(samples, lambda x: (x.cast("double") - 128.0) / 128.0)
    scale = {2: 32768.0, 4: 2147483648.0}.get(width)
    return samples if scale is None else F.transform(samples, lambda x: x.cast("double") / scale)


def downmix(samples: Column, n_channels: int) -> Column:
    """Mean of interleaved channels."""
    frames = (F.size(samples) / n_channels).cast("int")
    return F.when(
        frames > 0,
        F.transform(
            F.sequence(F.lit(0), frames - 1),
            lambda i: sum(F.get(samples, i * n_channels + c).cast("double") for c in range(n_channels)) / n_channels,
        ),
    ).otherwise(F.array().cast("array<double>"))


def peak_normalize(samples: Column) -> Column:
    """Scale to a peak of 1 unless the signal is practically silent."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 1e-4, F.transform(samples, lambda x: x.cast("double") / peak)).otherwise(
        F.transform(samples, lambda x: x.cast("double"))
    )


def spread_spectrum(energy: Column, prob: Column) -> Column:
    """A 64-band stand-in spectrum from energy and speech probability."""
    # Band edges 8, 24, 48, 64 and their shares.
    bands = [energy * 0.8] * 8 + [energy * 1.0] * 16 + [energy * 0.6] * 24 + [energy * 0.3 * prob] * 16
    return F.array(*bands)
