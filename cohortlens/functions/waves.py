"""Waveform expressions on array columns. All run inside the JVM, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as K


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression used inside a lambda would otherwise be worked out again for
    every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def mix_down(channels: Column | str) -> Column:
    """Mean over channels of ``array<array<float>>`` (channel first)."""
    def mean(x: Column) -> Column:
        total = F.aggregate(
            F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))),
            F.transform(F.element_at(x, 1), lambda v: v.cast("double")),
            lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
        return bind(total, lambda t: F.transform(t, lambda v: (v / F.size(x)).cast("float")))

    return bind(_col(channels), mean)


def peak(samples: Column | str) -> Column:
    """Largest absolute value, without a pass through a lambda."""
    x = _col(samples)
    return F.greatest(F.array_max(x), -F.array_min(x))


def peak_normalize(samples: Column | str, silent: float = K.SILENT_PEAK) -> Column:
    """Scale to a peak of 1; a silent or empty waveform stays as it is."""
    return bind(_col(samples), lambda x: bind(peak(x), lambda p: F.when(
        p.isNull() | (p < silent), x
    ).otherwise(F.transform(x, lambda v: (v / p).cast("float")))))


def fix_length(samples: Column | str, length: int) -> Column:
    """Exactly ``length`` samples: the start of a longer one, or zeros after."""
    def fitted(x: Column) -> Column:
        pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(length - F.size(x), F.lit(0)))
        return F.when(F.size(x) >= length, F.slice(x, 1, length)).otherwise(F.concat(x, pad))

    return bind(_col(samples), fitted)


def frames(samples: Column | str, win: int, hop: int) -> Column:
    """Overlapping frames; a tail shorter than ``win`` is left out."""
    empty = F.array().cast("array<array<float>>")
    return bind(_col(samples), lambda x: F.when(F.size(x) >= win, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(x) - win, F.lit(0)), F.lit(hop)),
        lambda s: F.slice(x, s + 1, win))).otherwise(empty))


def edge_padded(samples: Column | str, pad: int) -> Column:
    """Repeat the first and last sample ``pad`` times, to centre the frames."""
    return bind(_col(samples), lambda x: F.when(F.size(x) > 0, F.concat(
        F.array_repeat(F.try_element_at(x, F.lit(1)), pad), x,
        F.array_repeat(F.try_element_at(x, F.lit(-1)), pad))).otherwise(x))


def rms(frame: Column) -> Column:
    energy = F.aggregate(frame, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.sqrt(F.try_divide(energy, F.size(frame).cast("double")))


def active_frames(samples: Column | str, frame: int, threshold: float) -> Column:
    """Struct ``samples, share``: loud frames joined, and how much they keep.

    The share divides by the full length, tail included. When no frame is loud
    the waveform comes back whole with share 0.
    """
    def chosen(x: Column) -> Column:
        loud = F.filter(frames(x, frame, frame), lambda f: rms(f) >= threshold)
        return bind(F.flatten(loud), lambda kept: F.struct(
            F.when(F.size(kept) > 0, kept).otherwise(x).alias("samples"),
            F.when(F.size(kept) > 0, F.size(kept) / F.size(x)).otherwise(F.lit(0.0))
            .alias("share")))

    return bind(_col(samples), chosen)


def zero_crossings(frame: Column) -> Column:
    """Sign changes between neighbours over the frame length; zero is positive."""
    quiet = 1e-10
    sign = F.transform(frame, lambda v: v < -quiet)
    return bind(sign, lambda s: F.size(F.filter(F.zip_with(
        F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
        F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))),
        lambda a, b: a != b), lambda changed: changed)) / F.size(frame))
