"""Waveform features that need a Fourier transform, batched through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPSILON, AcousticConfig


def band_edges(c: AcousticConfig) -> list[int]:
    """Edges of bands of rising width over the spectrum's places."""
    width = c.n_fft // 2 + 1
    return np.minimum(np.logspace(0, np.log10(width), c.n_bands + 1).astype(int), width).tolist()


def band_features(x: np.ndarray, c: AcousticConfig) -> np.ndarray:
    """signals x frames x bands, of signals of equal length (rows of x): log of the mean magnitude in each band, over
    windowed, overlapping frames of the zero-padded waveform."""
    x = np.concatenate((x, np.zeros((len(x), c.n_fft))), axis=1)
    cut = np.lib.stride_tricks.sliding_window_view(x, c.n_fft, axis=1)[:, :: c.hop][:, : 1 + (x.shape[1] - c.n_fft) // c.hop]
    spectrum = np.abs(np.fft.rfft(cut * np.hanning(c.n_fft), axis=2))
    edges = band_edges(c)
    return np.log1p(np.stack([spectrum[:, :, a:b].mean(axis=2) if b > a else np.zeros(spectrum.shape[:2]) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=2))


def acoustic_entropies(x: np.ndarray, c: AcousticConfig = AcousticConfig()) -> np.ndarray:
    """Mean entropy of the quantile-binned bands of each signal (rows of equal length)."""
    values = np.sort(np.moveaxis(band_features(x, c), 1, 2), axis=2)  # signals x bands x frames
    n = values.shape[2]
    edges = np.quantile(values, np.linspace(0, 1, c.n_bins + 1), axis=2)  # edges x signals x bands
    # the values' bins: distinct inner edges at or below; the least and the greatest value are no inner edges
    new = np.concatenate((np.ones((1, *edges.shape[1:]), bool), edges[1:] != edges[:-1]))
    new &= (edges != edges[0]) & (edges != edges[-1])
    several = new.any(axis=0)
    bins = np.zeros(values.shape, dtype=int)
    for e, is_new in zip(edges, new, strict=True):
        bins += (values >= e[..., None]) & is_new[..., None]
    bins = np.where(several[..., None], np.minimum(bins, c.n_bins - 1), 0)
    total = np.zeros(values.shape[:2])
    z = 1 + c.n_bins * EPSILON
    for k in range(c.n_bins):
        p = ((bins == k).sum(axis=2) / n + EPSILON) / z
        total -= p * np.log2(p)
    return total.mean(axis=1)


def acoustic_entropy_of(x, c: AcousticConfig = AcousticConfig()) -> float:
    if x is None or len(x) == 0:
        return 0.0
    return float(acoustic_entropies(np.asarray(x, dtype=np.float64)[None, :], c)[0])


def centroid_of(x) -> float:
    """Spectral centroid as a share of the spectrum, of at most 16000 samples; 0.5 for silence."""
    if x is None or len(x) == 0:
        return 0.5
    spectrum = np.abs(np.fft.rfft(np.asarray(x, dtype=np.float64)[:16_000]))
    mass = spectrum.sum()
    return float((np.arange(len(spectrum)) * spectrum).sum() / mass / len(spectrum)) if mass > 1e-10 else 0.5


def _by_length(s: pd.Series, most: int = 4_000_000):
    """(places, signals as rows of one array) of the non-empty signals, those of equal length together."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        if x is not None and len(x):
            places.setdefault(len(x), []).append(i)
    for n, at in places.items():
        step = max(1, most // n)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            yield some, np.stack([np.asarray(s.iloc[i], dtype=np.float64) for i in some])


def acoustic_entropy(audio: Column, config: AcousticConfig = AcousticConfig()) -> Column:
    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s))
        for at, x in _by_length(s):
            out[at] = acoustic_entropies(x, config)
        return pd.Series(out)

    return f(audio)


def spectral_centroid(audio: Column) -> Column:
    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        out = np.full(len(s), 0.5)
        for at, x in _by_length(s):
            spectrum = np.abs(np.fft.rfft(x[:, :16_000], axis=1))
            mass = spectrum.sum(axis=1)
            heard = mass > 1e-10
            out[at] = np.where(heard, (spectrum * np.arange(spectrum.shape[1])).sum(axis=1) / np.where(heard, mass, 1) / spectrum.shape[1], 0.5)
        return pd.Series(out)

    return f(audio)


def frames(audio: Column, n_fft: int = 512, hop: int = 160) -> Column:
    """Overlapping frames of the zero-padded waveform, as arrays."""
    padded = F.concat(audio, F.array_repeat(F.lit(0.0).cast("float"), n_fft))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(padded) - n_fft) / hop).cast("int")), lambda i: F.slice(padded, i * hop + 1, F.lit(n_fft)))
