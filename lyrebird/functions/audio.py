"""Column functions over waveforms (arrays of samples), and the spectral features that need a transform."""

from __future__ import annotations

import io
import wave as wav
from functools import cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.vectors import bound

RATE, WINDOW, HOP, MELS = 16000, 400, 160, 128


def to_mono(channels: Column) -> Column:
    """Mean of an array of channels."""

    def mean(own: Column) -> Column:
        n = F.size(own)
        return F.transform(own[0], lambda v, i: F.aggregate(own, F.lit(0.0), lambda s, c: s + F.get(c, i)) / n)

    return bound(mean, channels)


def into_range(wave: Column) -> Column:
    """Divided by its peak where that is above 1, and clipped to [-1, 1]."""

    def scaled(own: Column) -> Column:
        peak = F.greatest(F.array_max(F.transform(own, F.abs)), F.lit(1.0))
        return bound(lambda most: F.transform(own, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / most))), peak)

    return bound(scaled, wave)


def from_integers(wave: Column, bits: int, is_signed: bool = True) -> Column:
    """Integer samples to [-1, 1]: signed by their largest magnitude, unsigned around the middle."""
    half = float(1 << (bits - 1))
    return F.transform(wave, lambda v: v / half if is_signed else (v - half) / half)


def resample_linear(wave: Column, rate: Column, target: int) -> Column:
    """Linear interpolation; as it is where the rates agree."""
    n = F.floor(F.size(wave) * target / rate).cast("int")

    def at(i: Column) -> Column:
        place = i * rate / target
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(wave) - 1)
        return F.get(wave, low) * (1 - (place - low)) + F.get(wave, high) * (place - low)

    return F.when(rate == target, wave).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def seek(wave: Column, rate: int, start: float, duration: float | None) -> Column:
    """From a second on, for so many seconds, or to the end."""
    first = int(start * rate)
    length = F.greatest(F.size(wave) - first, F.lit(0)) if duration is None else F.lit(int(duration * rate))
    return F.slice(wave, F.lit(first + 1), length)


def chunks(wave: Column, size: int) -> Column:
    """Consecutive stretches of a size, the last filled up with zeros."""
    n = F.ceil(F.size(wave) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(wave, i * size + 1, F.lit(size)))
    return F.transform(parts, lambda p: F.concat(p, F.array_repeat(F.lit(0.0), size - F.size(p))))


def frames(wave: Column, width: int, hop: int) -> Column:
    """Overlapping stretches of the wave mirrored at both ends by half a width."""
    half = width // 2
    padded = F.concat(F.reverse(F.slice(wave, 2, half)), wave, F.reverse(F.slice(wave, F.size(wave) - half, F.lit(half))))
    n = F.floor((F.size(padded) - width) / hop).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(padded, i * hop + 1, F.lit(width)))


def energy(wave: Column) -> Column:
    return F.aggregate(wave, F.lit(0.0), lambda s, v: s + v * v)


def padded_to(wave: Column, size: Column) -> Column:
    """Filled with zeros, or cut, to a size."""
    return F.concat(F.slice(wave, F.lit(1), size), F.array_repeat(F.lit(0.0), F.greatest(size - F.size(wave), F.lit(0))))


@cache
def _windowed_sinc(up: int, down: int) -> np.ndarray:
    """A low-pass filter for resampling by up / down: a sinc under a Kaiser window of beta 5."""
    most = max(up, down)
    half = 10 * most
    taps = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def resampled(wave: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling: zeros between samples, the filter, and each down-th sample."""
    if rate == target:
        return wave
    common = gcd(rate, target)
    up, down = target // common, rate // common
    taps = _windowed_sinc(up, down)
    spread = np.zeros(len(wave) * up)
    spread[::up] = wave
    half = len(taps) // 2
    return np.convolve(spread, taps)[half : half + len(spread)][::down]


def resample(wave: Column, rate: Column, target: int = RATE) -> Column:
    @F.pandas_udf("array<double>")
    def run(waves: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([resampled(np.asarray(w, dtype=np.float64), int(r), target) for w, r in zip(waves, rates, strict=True)])

    return run(wave, rate)


@cache
def mel_filters(rate: int = RATE, width: int = WINDOW, n: int = MELS) -> np.ndarray:
    """Triangular filters of equal area on the mel scale, a row for each bin."""

    def hz(m: np.ndarray) -> np.ndarray:
        return np.where(m >= 15, 1000 * np.exp(np.log(6.4) / 27 * (m - 15)), m * 200 / 3)

    edges = hz(np.linspace(0, 15 + np.log(rate / 2 / 1000) / (np.log(6.4) / 27), n + 2))
    bins = np.linspace(0, rate / 2, width // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))) * 2 / (high - low)


def log_mel_of(wave: np.ndarray) -> np.ndarray:
    """Log-mel features, a row for each filter and a column for each hop."""
    wave = np.asarray(wave, dtype=np.float64)
    padded = np.pad(wave, WINDOW // 2, mode="reflect")
    stretches = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    power = np.abs(np.fft.rfft(stretches * hann, axis=1)) ** 2
    logs = np.log10(np.maximum(power @ mel_filters(), 1e-10)).T
    return ((np.maximum(logs, logs.max() - 8) + 4) / 4)[:, : len(wave) // HOP]


def log_mel(wave: Column) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: list(log_mel_of(w)), na_action="ignore")

    return run(wave)


def wav_file(wave: Column, rate: int) -> Column:
    """The bytes of a 16-bit PCM file of one channel."""

    @F.pandas_udf("binary")
    def run(waves: pd.Series) -> pd.Series:
        def one(own) -> bytes:
            out = io.BytesIO()
            with wav.open(out, "wb") as sound:
                sound.setnchannels(1)
                sound.setsampwidth(2)
                sound.setframerate(rate)
                sound.writeframes(np.rint(np.clip(np.asarray(own, dtype=np.float64), -1, 1) * 32767).astype("<i2").tobytes())
            return out.getvalue()

        return waves.map(one, na_action="ignore")

    return run(wave)


def clip(content: Column, start: float = 0.0, duration: float | None = None) -> Column:
    """(sr, wave) of a PCM file's bytes from a second on, for so many seconds or to the end: the reader seeks, and only what is asked for becomes samples; channels are averaged."""

    @F.pandas_udf("struct<sr:int,wave:array<double>>")
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for own in files:
            if own is None:
                rows.append((None, None))
                continue
            with wav.open(io.BytesIO(own)) as sound:
                rate, width, channels, n = sound.getframerate(), sound.getsampwidth(), sound.getnchannels(), sound.getnframes()
                first = min(n, int(start * rate))
                sound.setpos(first)
                data = np.frombuffer(sound.readframes(n - first if duration is None else min(n - first, int(duration * rate))), dtype={1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                data = (data - 128) / 128 if width == 1 else data / (1 << (8 * width - 1))
                rows.append((rate, data.reshape(-1, channels).mean(axis=1)))
        return pd.DataFrame(rows, columns=["sr", "wave"])

    return run(content)


def normalised(rows: DataFrame, channels: str, rate: str, out: str = "wav", target: int = RATE) -> DataFrame:
    """rows with what a model takes: one channel, at its rate, within [-1, 1]."""
    mono = rows.withColumn("_mono", to_mono(F.col(channels)))
    at_rate = mono.withColumn("_at", F.when(F.col(rate) == target, F.col("_mono")).otherwise(resample(F.col("_mono"), F.col(rate), target)))
    return at_rate.withColumn(out, into_range(F.col("_at"))).drop("_mono", "_at")
