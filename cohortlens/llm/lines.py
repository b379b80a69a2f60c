"""Numbers about the lines of a block of texts, from their bytes and without a loop over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE, LOWER, UPPER, DIGIT, SYMBOL, BANG, POINT, OTHER = range(8)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[97:123] = LOWER
CLASSES[128:] = LOWER  # bytes of letters outside ASCII, most often
CLASSES[65:91] = UPPER
CLASSES[48:58] = DIGIT
CLASSES[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
CLASSES[[ord("!"), ord("?")]] = BANG
CLASSES[[ord(c) for c in ".,;:"]] = POINT

NAMES = ["upper", "digit", "symbol", "bang", "point", "other", "space", "length", "words",
         "word_length", "same_as_previous", "repeated_line", "upper_words", "ends_in_point"]
#: An odd multiplier has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


@dataclass
class Lines:
    document: np.ndarray   # of each line
    first: np.ndarray      # each document's first line
    count: np.ndarray      # each document's lines
    length: np.ndarray     # bytes of each line
    features: np.ndarray   # lines x NAMES


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and where each row begins, and the end."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def line_bounds(raw: np.ndarray, at: np.ndarray):
    """Documents' line counts, lines' begins and ends; the line break belongs to neither line."""
    breaks = np.flatnonzero(raw == 10)
    upto = np.searchsorted(breaks, at)
    count = np.diff(upto) + 1
    ends = np.insert(breaks, upto[1:], at[1:])
    begins = np.empty_like(ends)
    begins[1:] = ends[:-1] + 1
    first = np.cumsum(count) - count
    begins[first] = at[:-1]
    return count, first, begins, ends


def word_bounds(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of ``inside`` bytes; a run ends where its text does."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[at] = False
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[at] = False
    return np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, ``n`` at least; kept for the next block."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[:1] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def span_hashes(raw: np.ndarray):
    """A function from begins and ends to the spans' polynomial hashes, equal for equal bytes."""
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
    return lambda a, b: (total[b] - total[a]) * inverse[a]


def line_numbers(column: pa.Array) -> Lines:
    """One row of numbers for each line. A document without text has one empty line."""
    raw, at = text_bytes(column)
    count, first, begins, ends = line_bounds(raw, at)
    n = len(ends)
    document = np.repeat(np.arange(len(count)), count)
    width = ends - begins
    spans = width + 1
    spans[first + count - 1] -= 1
    line = np.repeat(np.arange(n, dtype=np.int32), spans)
    kind = CLASSES[raw]
    per = np.bincount(line.astype(np.int64) * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    start, stop = word_bounds(kind != SPACE, at)
    hashes = span_hashes(raw)
    word_line = line[start] if len(start) else np.zeros(0, np.int32)
    word_hash = hashes(start, stop)
    same = np.zeros(len(start), bool)
    same[1:] = (word_hash[1:] == word_hash[:-1]) & (word_line[1:] == word_line[:-1])
    words = np.bincount(word_line, minlength=n).astype(float)
    some = np.maximum(words, 1)
    repeats = np.bincount(word_line[same], minlength=n)
    shouted = np.bincount(word_line[kind[start] == UPPER], minlength=n)
    key = hashes(begins, ends) ^ (document.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = np.ones(n, bool)
    again[np.unique(key, return_index=True)[1]] = False
    again &= words > 0
    closing = np.zeros(n, bool)
    full = width > 0
    closing[full] = kind[ends[full] - 1] == POINT
    chars = np.maximum(width, 1)
    features = np.column_stack([
        per[:, UPPER] / chars, per[:, DIGIT] / chars, per[:, SYMBOL] / chars, per[:, BANG] / chars,
        per[:, POINT] / chars, per[:, OTHER] / chars, per[:, SPACE] / chars, np.log1p(width) / 5,
        np.log1p(words) / 4, np.minimum(width / some, 60) / 10, repeats / some, again,
        shouted / some, closing])
    return Lines(document, first, count, width, features.astype(np.float32))
