"""Sets of word shingles as sorted 64-bit hashes, for a block of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cohortlens.llm.lines import CLASSES, SPACE, span_hashes, text_bytes, word_bounds

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Bits of a set's parity sketch, in 64-bit words.
SKETCH_WORDS = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``words`` lower-cased words, sorted.

    A text with fewer words has one shingle, all of them; one without words, or a null, has none.
    """
    raw, at = text_bytes(column)
    raw = LOWERED[raw]
    start, stop = word_bounds(CLASSES[raw] != SPACE, at)
    word = mixed(span_hashes(raw)(start, stop) + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    odd = [np.uint64(pow(0xA24BAED4963EE407, j, 1 << 64)) for j in range(words)]
    n = max(len(word) - words + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total += word[j:j + n] * odd[j]
    total = mixed(total)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            yield np.unique(total[a:b - words + 1])
        elif b > a:
            short = sum((word[a + j:a + j + 1] * odd[j] for j in range(b - a)), np.zeros(1, np.uint64))
            yield mixed(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_number(items: np.ndarray) -> np.int64:
    """A 64-bit number of a set: equal sets share it, others do not but by accident."""
    total = mixed(items ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)
    return mixed(np.array([total, len(items)], np.uint64)).sum(dtype=np.uint64).astype(np.int64)


def parities(items: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH_WORDS buckets whether it holds an odd number of items, as signed words.

    Two sets differ in at least as many items as their sketches differ in bits.
    """
    bucket = (items >> np.uint64(11)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def long_parities(items: np.ndarray) -> np.ndarray:
    """The same over a power of two of buckets, at least as many as items: large sets stay apart.

    A sketch of twice as many buckets folds to a shorter one by the exclusive or of its halves.
    """
    buckets = max(64, 1 << (len(items) - 1).bit_length())
    odd = np.bincount(((items >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
