"""Best-fit packing: documents into sequences of a fixed number of tokens.

Pattern packing. Only the histogram of piece lengths (at most ``capacity``
bins) reaches the driver. There, patterns of a few lengths that fill a sequence
are enumerated, non-negative least squares says how often each repeats, the
counts are rounded down, and what is left is packed best fit first, again by
length and count and never by document. Pieces then find their place by their
rank among the pieces of the same length.

Defined cases: a null text counts as empty, and an empty document is its end
token alone. Repeated rows are packed each on its own. Rows that are equal in
everything may change places. An empty table gives no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.tables import pieces, table
from cohortlens.storage import materialise

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBERED = 2_000_000
#: Slices that the pieces of one length are ranked in.
RANK_SLICES = 64

#: The tokenizer's own cut into pre-tokens, for texts of the characters below.
PRETOKEN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Other characters may be classed differently by other Unicode tables.
UNUSUAL = re.compile("[^\t-\r\x20-\x7eÀ-ɏ–—‘’“”…]")


class TokenIds(dict):
    """From a pre-token to its ids, as little-endian unsigned 32-bit numbers.

    The ids are those of ``tokenizer``. A text of usual characters is cut into
    pre-tokens, and the byte-pair merges of one are worked out when it is first
    met, from the same vocabulary in its ``ranks`` form. Texts with unusual
    characters or with a special token's string go to the tokenizer whole.
    """

    def __init__(self, tokenizer: str, ranks: str):
        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=merges,
                                        special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merges.encode_ordinary(word), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, PRETOKEN.findall(text)))


_IDS: dict[tuple[str, str], TokenIds] = {}


def token_ids(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> TokenIds:
    """One per worker process: later tasks find the words of earlier ones."""
    key = (tokenizer, ranks)
    if key not in _IDS:
        _IDS[key] = TokenIds(*key)
    return _IDS[key]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
                    ranks: str = RANKS, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document; only documents over ``capacity`` are cut.

    A cut document's first piece takes what the full ones leave over.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = token_ids(tokenizer, ranks)
        for batch in batches:
            out = []
            for part in pieces(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    tokens = (ids.text(text) if text else b"") + end
                    n = len(tokens) // 4
                    ends = range(n % capacity or capacity, n + 1, capacity) if n > capacity else [n]
                    at = 0
                    for k, to in enumerate(ends):
                        out.append((doc, k, at, to - at, zlib.crc32(tokens[4 * at:4 * to])))
                        at = to
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def fill_patterns(counts: np.ndarray, per_length: int = 24, parts: int = 5) -> np.ndarray:
    """Patterns of two to ``parts`` lengths that occur and together fill a sequence.

    A row holds lengths, longest first, padded with 0. From each length, partners are tried that lie
    evenly among those that occur, and the last part is the one that fills the rest exactly.
    """
    capacity = len(counts) - 1
    there = np.flatnonzero(counts[:capacity])
    there = there[there > 0]
    if not len(there):
        return np.zeros((0, parts), int)
    present = np.zeros(capacity + 1, bool)
    present[there] = True
    found = {}
    open_rows = [(int(x),) for x in there]
    for depth in range(2, parts + 1):
        rows = np.array(open_rows)
        rest = capacity - rows.sum(axis=1)
        ok = (rest >= 1) & (rest <= rows[:, -1])
        ok[ok] = present[rest[ok]]
        for row, last in zip(rows[ok], rest[ok]):
            found[tuple(row) + (int(last),)] = None
        if depth == parts:
            break
        grown = []
        for row in open_rows:
            room = capacity - sum(row)
            fit = there[:np.searchsorted(there, min(row[-1], room - 1), side="right")]
            if len(fit):
                few = max(2, per_length >> (2 * (depth - 2)))
                picks = fit[np.unique(np.linspace(0, len(fit) - 1, few).astype(int))]
                grown += [row + (int(x),) for x in picks]
        open_rows = grown
        if not open_rows:
            break
    out = np.zeros((len(found), parts), int)
    for i, p in enumerate(found):
        out[i, :len(p)] = p
    return out


def repeat_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: patterns times repeats near ``counts``.

    An update keeps every repeat at zero or above and never raises the squared error.
    """
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    target = counts.astype(float)
    target[0] = 0

    def gathered(v: np.ndarray) -> np.ndarray:
        return (v[patterns] * used).sum(axis=1)

    aim = gathered(target)
    x = np.full(len(patterns), target.sum() / max(1, used.sum()))
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), len(counts))
        x *= aim / np.maximum(gathered(made), 1e-12)
    return x


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns with repeats that use exactly ``counts[length]`` pieces of every length.

    The index of the last count is the capacity. Work depends on the number of lengths alone.
    """
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    if left[capacity]:
        out.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    patterns = fill_patterns(left)
    repeats = repeat_counts(patterns, left)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 1:
            break
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        m = min(int(repeats[i]), int((left[lengths] // times).min()))
        if m > 0:
            out.append(([int(x) for x in patterns[i] if x], m))
            left[lengths] -= m * times
    while left.any():
        start = int(np.flatnonzero(left)[-1])
        pattern = [start]
        left[start] -= 1
        room = capacity - start
        while room > 0:
            fit = np.flatnonzero(left[:room + 1])
            if not len(fit):
                break
            best = int(fit[-1])
            if best < room:  # two that fill the room exactly beat the longest that fits
                pairs = fit[left[room - fit] > (fit * 2 == room)]
                if len(pairs):
                    best = int(pairs[-1])
            pattern.append(best)
            left[best] -= 1
            room -= best
        lengths, times = np.unique(pattern, return_counts=True)
        left[lengths] += times
        m = int((left[lengths] // times).min())
        left[lengths] -= m * times
        out.append((pattern, m))
    return out


def places(planned: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For runs of ranks of one length: where they begin, their first sequence, their offset."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for lengths, m in planned:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], sequence, offset))
            rank[x] += m
            offset += x
        sequence += m
    rows.sort()
    names = ("length", "rank", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """Each document's pieces with the sequence and the offset they go to."""
    found = materialise(document_pieces(docs, capacity, tokenizer, ranks), "pieces")
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_SLICES)))
    by_slice = materialise(sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")), "slices")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_slice.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    spots = places(plan(counts), capacity)
    # at most capacity * RANK_SLICES rows, so they may be broadcast at any input size
    before = by_slice.select("length", "_slice", (F.sum("_n").over(
        W.partitionBy("length").orderBy("_slice")) - F.col("_n")).alias("_before"))
    order = W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(order)).join(
        F.broadcast(before), ["length", "_slice"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(spots["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                runs = spots["rank"][first[x]:first[x + 1]]
                at[mine] = first[x] + np.searchsorted(runs, rank[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                batch.columns[:5] + [pa.array(spots["sequence"][at] + rank - spots["rank"][at]),
                                     pa.array(spots["offset"][at])],
                names=batch.schema.names[:5] + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = [op10_best_fit_packing]
ORACLES: dict[str, str] = {}
