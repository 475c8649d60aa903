"""PCM samples as arrays: casts, layouts, downmix and resampling. Arithmetic is in long, so nothing overflows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.bits import clamp
from reelframe.operators.rows import appended

S16 = (-32768, 32767)
S32 = (-(1 << 31), (1 << 31) - 1)


def _saturated(x: Column, low: int, high: int) -> Column:
    """A double as a long within bounds: clamped before it is cast, as infinities have no long; what is no number is 0."""
    return F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))).cast("long")


def float_to_s16(samples: Column) -> Column:
    """Half to even, then saturated; infinities too, and NaN is 0."""
    return F.transform(samples, lambda x: _saturated(F.rint(x.cast("double") * 32768), *S16))


def float_to_s32(samples: Column) -> Column:
    """Half away from zero, then saturated; infinities too, and NaN is 0."""
    return F.transform(samples, lambda x: _saturated(F.round(x.cast("double") * 2147483648.0), *S32))


def u8_to_s16(samples: Column) -> Column:
    return F.transform(samples, lambda v: (v - 128) * 256)


def u8_to_s32(samples: Column) -> Column:
    return F.transform(samples, lambda v: (v - 128) * 16777216)


def s16_to_s32(samples: Column) -> Column:
    return F.transform(samples, lambda v: v * 65536)


def s32_to_s16(samples: Column) -> Column:
    return F.transform(samples, lambda v: clamp(F.shiftright(v + 32768, 16), *S16))


def planarize(samples: Column, channels: int, frames: int) -> Column:
    """Interleaved samples as an array for each channel."""
    plane = lambda c: F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda j: samples[j * channels + c])
    return F.array(*map(plane, range(channels)))


def interleave(planes: Column) -> Column:
    """One array of the channels' samples in turn."""
    n = F.size(planes)
    frames = F.size(planes[0])
    return F.flatten(F.transform(F.sequence(F.lit(0), frames - 1), lambda j: F.transform(F.sequence(F.lit(0), n - 1), lambda c: planes[c][j])))


def downmix(planes: list[Column]) -> list[Column]:
    """Left and right of front left, front right, centre, low frequency, back left and back right.

    The surround terms are scaled by 0.707 and the low-frequency one is added, as the mix is meant.
    """
    fl, fr, fc, lfe, bl, br = planes
    side = lambda front, back: F.transform(front, lambda x, j: x + 0.707 * fc[j] + 0.707 * back[j] + lfe[j])
    return [side(fl, bl), side(fr, br)]


def resample(samples: Column, n_in: int, n_out: int) -> Column:
    """n_out samples by linear interpolation between n_in; the last sample is held."""

    def at(k: Column) -> Column:
        place = k * F.lit(n_in) / F.lit(n_out)
        i = F.floor(place).cast("int")
        t = place - i
        return (1 - t) * samples[i] + t * samples[F.least(i + 1, F.lit(n_in - 1))]

    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), at)


# Sample formats that need no decoder, planar and packed.
RAW_FORMATS = ("u8", "s16", "s32", "f32", "f64", "u8-packed", "s16-packed", "s32-packed", "f32-packed", "f64-packed")


def is_raw(name: Column) -> Column:
    """Whether samples of this format bypass the decoder."""
    return name.isin(*RAW_FORMATS)


# Little-endian samples of WAVE data.
_STORED = {"u8": "<u1", "s16": "<i2", "s32": "<i4", "f32": "<f4"}


def _decoded(data: bytes, form: str) -> np.ndarray:
    if form == "s24":  # into the upper bytes of 32 bits
        raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        return np.concatenate([np.zeros((len(raw), 1), np.uint8), raw], axis=1).reshape(-1).view("<i4")
    kind = np.dtype(_STORED[form])
    return np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind)


def samples(data: Column, form: Column) -> Column:
    """Stored samples (binary) of a format of wav_files() as an array of double; those of s24 become samples of 32 bits. A
    sample that is cut off is none; null data or another format is null."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series, form: pd.Series) -> pd.Series:
        known = ("s24", *_STORED)
        return pd.Series([_decoded(b, f).astype(np.float64) if b is not None and f in known else None for b, f in zip(data, form)], dtype=object)

    return run(data, form)


def decoded(packets: DataFrame, form: str) -> DataFrame:
    """packets with samples: samples() of their data in one format, a few MB at a time, as samples are longer than what stores them."""
    return appended(packets, ["data"], lambda b: (None if b is None else _decoded(b, form).astype(np.float64),), "samples array<double>")
