"""From raw waveforms to feature rows in one Arrow pass, whole batches at a time.

The steps are those of ``waves`` and ``spectra``: mix down, scale, drop quiet
frames, fix the length, short-time series, mean and deviation of each. Waves of
one length are stacked, so numpy works on blocks of ``BLOCK_SAMPLES`` samples
instead of single waves. What does not change reaches the output as it came.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from cohortlens.functions import spectra as S

# workers get these functions by value: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Samples that are worked on at once; a frame takes some 30 times its samples in between.
BLOCK_SAMPLES = 1 << 18


def mixed_down(wave: np.ndarray, channels: list[int]) -> np.ndarray:
    """Mean of the channels that lie one after the other in ``wave``."""
    if len(set(channels)) > 1:
        raise ValueError("channels have different lengths")
    return wave.reshape(len(channels), -1).mean(axis=0).astype(np.float32)


def waves_of(column: pa.Array) -> Iterator[np.ndarray | Exception]:
    """Each row's samples as 32-bit numbers; an empty array for null."""
    if pa.types.is_list(column.type.value_type) or pa.types.is_large_list(column.type.value_type):
        for row in column:
            try:
                parts = [np.array(c, np.float64) for c in row.as_py() or [] if c is not None]
                yield mixed_down(np.concatenate(parts), [len(p) for p in parts]) if parts else np.zeros(0, np.float32)
            except Exception as e:      # reported per row
                yield e
        return
    flat = column.flatten()
    values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False)  # a null sample becomes nan
    at = np.cumsum([0] + [0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    for a, b in zip(at[:-1], at[1:]):
        yield values[a:b]


def prepared(wave: np.ndarray, length: int, frame: int | None, loud_rms: float, silent: float) -> tuple[np.ndarray, float]:
    """The wave scaled, without quiet frames and of fixed length, and the share that was kept."""
    if not len(wave):
        raise ValueError("waveform is empty")
    y = wave.astype(np.float64)
    if not np.isfinite(y).all():
        raise ValueError("waveform has values that are not finite")
    peak = np.abs(y).max()
    if peak >= silent:
        y = (y / peak).astype(np.float32).astype(np.float64)
    share = 1.0
    if frame is not None:
        rows = y[:len(y) // frame * frame].reshape(-1, frame)
        loud = np.sqrt((rows ** 2).sum(axis=1) / frame) >= loud_rms
        share = loud.sum() * frame / len(y)
        if loud.any():
            y = rows[loud].ravel()
    out = np.zeros(length)
    out[:min(length, len(y))] = y[:length]
    return out, share


def summaries(block: np.ndarray, hz: np.ndarray, window: np.ndarray, filters: np.ndarray, basis: np.ndarray,
              hop: int, win: int, center: bool, top_db: float | None) -> np.ndarray:
    """Rows of features, in the published order, of waves of one length."""
    n_fft = len(window)
    y = np.pad(block, ((0, 0), (n_fft // 2, n_fft // 2))) if center else block
    if y.shape[1] < n_fft:
        raise ValueError(f"waveform of {y.shape[1]} samples is shorter than a frame of {n_fft}")
    frames = np.lib.stride_tricks.sliding_window_view(y, n_fft, axis=1)[:, ::hop]
    size = np.abs(np.fft.rfft(frames * window, axis=2))
    weight = size.sum(axis=2)
    centroid = np.divide(size @ hz, weight, out=np.zeros(weight.shape), where=weight > 0)
    mel = 10 * np.log10(np.maximum(S.POWER_FLOOR, size ** 2 @ filters))
    if top_db is not None:
        mel = np.maximum(mel, mel.max(axis=(1, 2), keepdims=True) - top_db)
    mfcc = mel @ basis
    y = np.pad(block, ((0, 0), (win // 2, win // 2)), mode="edge") if center else block
    below = y < -S.QUIET
    so_far = np.zeros(y.shape, np.int64)
    np.cumsum(below[:, 1:] != below[:, :-1], axis=1, out=so_far[:, 1:])
    starts = np.arange(0, y.shape[1] - win + 1, hop)
    zcr = (so_far[:, starts + win - 1] - so_far[:, starts]) / win
    return np.concatenate([mfcc.mean(axis=1), mfcc.std(axis=1), zcr.mean(axis=1)[:, None], zcr.std(axis=1)[:, None],
                           centroid.mean(axis=1)[:, None], centroid.std(axis=1)[:, None]], axis=1).astype(np.float32)


def extractor(carry: list[str], names: list[str], rate: int, seconds: float, vad: bool, loud_rms: float, frame_ms: int,
              silent: float, n_mfcc: int, n_fft: int, hop: int, win: int, n_mels: int, center: bool,
              top_db: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches with ``carry`` and ``_wave`` to batches with ``carry``, ``prop_fala``, features, ``erro``."""
    tables = (np.arange(n_fft // 2 + 1) * rate / n_fft, S.hann_window(n_fft, win), S.mel_filters(rate, n_fft, n_mels).T,
              S.cosine_basis(n_mfcc, n_mels).T)
    length, frame = int(rate * seconds), int(rate * frame_ms / 1000) if vad else None
    at_once = max(1, BLOCK_SAMPLES // max(1, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            features = np.full((n, len(names)), np.nan, np.float32)
            share, error = np.full(n, np.nan), np.full(n, None, object)
            ready: list[tuple[int, np.ndarray]] = []

            def work() -> None:
                rows = [i for i, _ in ready]
                try:
                    features[rows] = summaries(np.stack([y for _, y in ready]), *tables, hop, win, center, top_db)
                except Exception as e:      # reported per row
                    error[rows] = repr(e)
                ready.clear()

            for i, wave in enumerate(waves_of(batch.column("_wave"))):
                try:
                    if isinstance(wave, Exception):
                        raise wave
                    y, share[i] = prepared(wave, length, frame, loud_rms, silent)
                    ready.append((i, y))
                except Exception as e:      # reported per row
                    error[i] = repr(e)
                if len(ready) == at_once:
                    work()
            if ready:
                work()
            failed = error != None  # noqa: E711
            columns = [batch.column(c) for c in carry]
            columns.append(pa.array(share, mask=np.isnan(share)))
            columns += [pa.array(features[:, j].copy(), mask=failed) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error.tolist(), pa.string())],
                                             names=[*carry, "prop_fala", *names, "erro"])

    return run
