"""Token counts: greedy longest-match word pieces by a linear automaton, without building the pieces.

The vocabulary is a trie with failure links. Where a byte has no child, the
automaton leaves a node by its link: that stands for taking the longest pieces
off the front of what the node spells, and how many those are is stored with
the link. So a word's number of pieces is a sum of stored counts, and each of
its bytes is looked at once.

A word is a run of bytes other than white space, with a mark for its begin in
front of it (the vocabulary spells it as its byte for a space). A byte where no
piece begins counts as one unknown piece; so every byte is a piece here.

Defined cases: a null or empty text, and one of white space, has no words and
no pieces. Repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.tables import pieces, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BEGIN = b" "
#: Words up to this many bytes are counted together, longer ones one by one.
TOGETHER = 64
#: Distinct words that a worker remembers.
REMEMBERED = 1_000_000


def printed_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a byte-level vocabulary file that hold no white space but one in front."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    written = printed_bytes()
    every = (bytes(written[c] for c in t) for t in tokens if all(c in written for c in t))
    return sorted(p for p in every if p and not any(x in b" \t\n\r\x0b\x0c" for x in p[1:]))


class Automaton:
    """Trie nodes by number (0: nothing read). ``link`` and ``popped`` say where failure leads and what it took.

    As every byte is a piece, each node but the first has a link.
    """

    def __init__(self, every: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends = [False]
        for piece in [bytes([b]) for b in range(256)] + list(every):
            node = 0
            for byte in piece:
                at = node << 8 | byte
                if at not in self.child:
                    self.child[at] = len(ends)
                    ends.append(False)
                node = self.child[at]
            ends[node] = True
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for at, node in self.child.items():
            below[at >> 8].append((at & 255, node))
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below[parent]:
                queue.append(node)
                if ends[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                taken, at = self.popped[parent], self.link[parent]
                while at << 8 | byte not in self.child:
                    taken, at = taken + self.popped[at], self.link[at]
                self.link[node], self.popped[node] = self.child[at << 8 | byte], taken
        # the same table for many words at once
        keys = np.array(sorted(self.child), np.int64)
        self.keys, self.nodes = keys, np.array([self.child[k] for k in keys.tolist()], np.int32)
        self.links, self.pops = np.array(self.link, np.int32), np.array(self.popped, np.int32)

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        node = total = 0
        child, link, popped = self.child, self.link, self.popped
        for byte in word:
            while node << 8 | byte not in child:
                total, node = total + popped[node], link[node]
            node = child[node << 8 | byte]
        while node:
            total, node = total + popped[node], link[node]
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word: every step reads the next byte of all words that have one."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                out[i] = self.count(w)
        if not short:
            return out
        short.sort(key=lambda i: -len(words[i]))
        raw = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        length = np.array([len(words[i]) for i in short])
        start = np.cumsum(length) - length
        node, total = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
        for t in range(int(length[0]) + 1):
            reading = np.searchsorted(-length, -t, side="left")  # words longer than t come first
            here = np.arange(reading)
            byte = raw[start[:reading] + t].astype(np.int64)
            while len(here):
                key = node[here] << 8 | byte[here]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                node[here[found]] = self.nodes[at[found]]
                here = here[~found]
                total[here] += self.pops[node[here]]
                node[here] = self.links[node[here]]
            ended = np.arange(reading, len(short))
            ended = ended[node[ended] > 0]
            while len(ended):
                total[ended] += self.pops[node[ended]]
                node[ended] = self.links[node[ended]]
                ended = ended[node[ended] > 0]
        out[short] = total
        return out


class WordCounts(dict):
    """Pieces of the words met so far."""

    def __init__(self, vocabulary: str):
        self.automaton = Automaton(vocabulary_pieces(vocabulary))

    def learn(self, words: set[bytes]) -> None:
        new = list(words - self.keys())
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        self.update(zip(new, self.automaton.counts([BEGIN + w for w in new]).tolist()))


_COUNTS: dict[str, WordCounts] = {}


def word_counts(vocabulary: str = VOCABULARY) -> WordCounts:
    """One per worker process: the automaton is built once and words stay known."""
    if vocabulary not in _COUNTS:
        _COUNTS[vocabulary] = WordCounts(vocabulary)
    return _COUNTS[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens``, the greedy longest-match pieces of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_counts(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                words = [(t or b"").split() for t in part.column("text").to_pylist()]
                known.learn({w for every in words for w in every})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = [op5_token_counts]
ORACLES: dict[str, str] = {}
