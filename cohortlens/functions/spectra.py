"""Short-time series of a waveform: what built-in expressions cannot do well.

A small numpy helper behind an Arrow-batched pandas UDF; one call gives all the
series, so a waveform crosses to Python once. Window, mel filters and cosine
basis are computed on the driver and travel with the function (about 300 kB).
Definitions: Davis and Mermelstein (1980) for the cepstrum; McFee et al. (2015)
for framing, mel scale and filter scaling.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as K

# workers get these functions by value: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: mel scale (linear below the knee, logarithmic above) ------
MEL_HZ_STEP = 200.0 / 3.0
MEL_KNEE_HZ = 1000.0
MEL_LOG_STEP = float(np.log(6.4) / 27.0)
POWER_FLOOR = 1e-10
TOP_DB = 80.0

QUIET = 1e-10

SERIES_TYPE = ("struct<mfcc: array<array<double>>, centroid: array<double>, "
               "zcr: array<double>, mel: array<array<double>>, erro: string>")


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    knee = MEL_KNEE_HZ / MEL_HZ_STEP
    bent = MEL_KNEE_HZ * np.exp(MEL_LOG_STEP * (np.maximum(mel, knee) - knee))
    return np.where(mel < knee, mel * MEL_HZ_STEP, bent)


def hz_to_mel(hz: float) -> float:
    if hz < MEL_KNEE_HZ:
        return hz / MEL_HZ_STEP
    return MEL_KNEE_HZ / MEL_HZ_STEP + np.log(hz / MEL_KNEE_HZ) / MEL_LOG_STEP


def mel_filters(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles of equal area, ``n_mels`` x ``n_fft // 2 + 1``."""
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    edges = mel_to_hz(np.linspace(0.0, hz_to_mel(rate / 2), n_mels + 2))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.maximum(0.0, np.minimum(rise, fall)) * 2.0 / (high - low)


def cosine_basis(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k, n = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    return basis


def hann_window(n_fft: int, win: int) -> np.ndarray:
    """Periodic Hann window of ``win`` samples in the middle of ``n_fft``."""
    window = np.zeros(n_fft)
    at = (n_fft - win) // 2
    window[at:at + win] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    return window


def frame_spectra(y: np.ndarray, window: np.ndarray, hop: int, center: bool) -> np.ndarray:
    """Magnitudes, one row per frame."""
    n_fft = len(window)
    if center:
        y = np.pad(y, n_fft // 2)
    if len(y) < n_fft:
        raise ValueError(f"waveform of {len(y)} samples is shorter than a frame of {n_fft}")
    rows = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
    return np.abs(np.fft.rfft(rows * window, axis=1))


def crossing_rate(y: np.ndarray, hop: int, win: int, center: bool) -> np.ndarray:
    """Sign changes inside each frame over its length; zero counts as positive."""
    if center:
        y = np.pad(y, win // 2, mode="edge")
    below = y < -QUIET
    so_far = np.concatenate([[0], np.cumsum(below[1:] != below[:-1])])
    starts = np.arange(0, len(y) - win + 1, hop)
    return (so_far[starts + win - 1] - so_far[starts]) / win


def short_time(samples: Column | str, rate: int = K.SAMPLE_RATE, n_mfcc: int = K.N_MFCC,
            n_fft: int = K.N_FFT, hop: int = K.HOP, win: int = K.WIN,
            n_mels: int = K.N_MELS, center: bool = True,
            top_db: float | None = TOP_DB, keep_mel: bool = False) -> Column:
    """Struct of per-frame ``mfcc`` (frame x coefficient), ``centroid``, ``zcr``
    and, with ``keep_mel``, ``mel`` in decibels. A row that fails has ``erro``
    set and the rest null, so one bad waveform does not end the job.

    Give it a stored column: the planner cannot run a Python function whose
    argument holds nested lambdas (see ``features.with_series``)."""
    window = hann_window(n_fft, win)
    filters, basis = mel_filters(rate, n_fft, n_mels).T, cosine_basis(n_mfcc, n_mels).T
    hz = np.arange(n_fft // 2 + 1) * rate / n_fft

    def one(samples) -> dict:
        y = np.asarray(samples, dtype=np.float64)
        if not np.isfinite(y).all():
            raise ValueError("waveform has values that are not finite")
        if not len(y):
            raise ValueError("waveform is empty")
        size = frame_spectra(y, window, hop, center)
        weight = size.sum(axis=1)
        centroid = np.divide(size @ hz, weight, out=np.zeros(len(size)), where=weight > 0)
        mel = 10 * np.log10(np.maximum(
            POWER_FLOOR, size ** 2 @ filters))
        if top_db is not None:
            mel = np.maximum(mel, mel.max() - top_db)
        mfcc = mel @ basis
        zcr = crossing_rate(y, hop, win, center)
        return {"mfcc": list(mfcc), "centroid": centroid, "zcr": zcr,
                "mel": list(mel) if keep_mel else None, "erro": None}

    @F.pandas_udf(SERIES_TYPE)
    def batch(column: pd.Series) -> pd.DataFrame:
        out = []
        for samples in column:
            try:
                out.append(one(samples))
            except Exception as e:      # reported per row, see the docstring
                out.append({"erro": repr(e)})
        return pd.DataFrame({name: [row.get(name) for row in out]
                             for name in ("mfcc", "centroid", "zcr", "mel", "erro")})

    return batch(samples)
