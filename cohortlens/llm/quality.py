"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its own numbers and those of the lines beside it
speak for either, and a transition weight ties neighbours together. The model
is fitted to labelled documents, whose lines all take the document's label. A
document's score is the mean of its lines' probabilities of being good, from
the forward-backward pass, weighted by their lengths.

Defined cases: a null text counts as empty, and an empty document is one empty
line of weight one. Rows with a null ``doc_id`` are scored and never fitted.
A ``doc_id`` with several labels takes the smallest; one with several rows is
fitted once. Long documents are fitted whole, in segments. Without labelled rows
nothing speaks against a document and every score is 1. Repeated rows are
scored each; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.lines import NAMES, Lines, line_numbers
from cohortlens.llm.tables import pieces, table
from cohortlens.storage import materialise

#: Labelled documents the field is fitted to at most, those with the smallest hashes.
FIT_ROWS = 4000
#: Tasks that hold them, and bytes of line numbers a task works on at once.
FIT_PARTS, FIT_BYTES = 12, 8 << 20
#: Lines in a row that the fit chains together. Every line counts, in one segment or the next.
SEGMENT = 500
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


@dataclass
class Chain:
    """Scaling of the line numbers, weights of a good line, and transition weights [from, to]."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def with_neighbours(lines: Lines, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each line's scaled numbers, those of the line before and after, and a constant."""
    own = (lines.features - mean) / scale
    last = lines.first + lines.count - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[lines.first] = 0
    after[:-1] = own[1:]
    after[last] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1), own.dtype)])


def passes(good: np.ndarray, lines: Lines, moves: np.ndarray):
    """Forward and backward log sums for a bad and a good line, over all documents at once.

    Step t handles line t of every document that has one, so the work is the number of lines.
    """
    order = np.argsort(-lines.count, kind="stable")
    first, count = lines.first[order], lines.count[order]
    steps = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    fore, back = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    if not steps:
        return fore, back
    fore[first, 1] = good[first]
    for t in range(1, steps):
        at = first[:alive[t]] + t
        prev = fore[at - 1]
        fore[at, 0] = np.logaddexp(prev[:, 0] + moves[0, 0], prev[:, 1] + moves[1, 0])
        fore[at, 1] = np.logaddexp(prev[:, 0] + moves[0, 1], prev[:, 1] + moves[1, 1]) + good[at]
    for t in range(steps - 1, 0, -1):
        at = first[:alive[t]] + t
        bad_next, good_next = back[at, 0], back[at, 1] + good[at]
        back[at - 1, 0] = np.logaddexp(moves[0, 0] + bad_next, moves[0, 1] + good_next)
        back[at - 1, 1] = np.logaddexp(moves[1, 0] + bad_next, moves[1, 1] + good_next)
    return fore, back


def segments(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines and lengths of pieces of at most ``SEGMENT`` lines of documents that lie end to end."""
    parts = -(-count // SEGMENT)
    of = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return (np.cumsum(count) - count)[of] + nth * SEGMENT, np.minimum(SEGMENT, count[of] - nth * SEGMENT)


def slopes(blocks: list[np.ndarray], labels: np.ndarray, chain: Chain) -> np.ndarray:
    """Slope of the documents' summed log likelihood by all weights, all lines of all documents.

    Lines see their neighbours throughout; only moves from one segment to the next are left out, so
    that a document of any length takes a bounded number of steps.
    """
    count = np.array([len(b) for b in blocks])
    document = np.repeat(np.arange(len(blocks)), count)
    whole = Lines(document, np.cumsum(count) - count, count, np.zeros(0), np.vstack(blocks))
    x = with_neighbours(whole, chain.mean, chain.scale)
    y = labels[document]
    first, size = segments(count)
    part = Lines(np.repeat(np.arange(len(first)), size), first, size, np.zeros(0), whole.features)
    # each document weighs the same, however many lines it has
    weight = 1.0 / count[document]
    good = x @ chain.weights
    fore, back = passes(good, part, chain.moves)
    last = first + size - 1
    norm = np.logaddexp(fore[last, 0], fore[last, 1])[part.document]
    inner = np.ones(len(y), bool)
    inner[first] = False
    here = np.flatnonzero(inner)
    likely = np.exp(fore[:, 1] + back[:, 1] - norm)
    grad = np.empty(len(chain.weights) + 4)
    grad[:-4] = x.T @ ((y - likely) * weight)
    for a in (0, 1):
        for b in (0, 1):
            seen = ((y[here - 1] == a) & (y[here] == b)).astype(float)
            joint = np.exp(fore[here - 1, a] + chain.moves[a, b] + b * good[here] + back[here, b] - norm[here])
            grad[len(chain.weights) + 2 * a + b] = ((seen - joint) * weight[here]).sum()
    return grad


def summed(stored: DataFrame, work: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of what ``work`` makes of the stored documents; each task hands on one row of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in pieces(batch, "numbers", FIT_BYTES):
                blocks = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, len(NAMES))
                          for b in part.column("numbers")]
                made = work(blocks, part.column("y").to_numpy())
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum((np.frombuffer(r["sums"]) for r in stored.mapInArrow(add, "sums binary").collect()), np.zeros(()))


def fit(stored: DataFrame, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Chain | None:
    """Maximum conditional likelihood by Adam steps; the documents stay with the executors."""

    def moments(blocks: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        x = np.vstack(blocks).astype(float)
        return np.concatenate([[len(blocks), len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(stored, moments)
    if not sums.ndim:
        return None
    documents, lines = sums[:2]
    mean, square = np.split(sums[2:] / lines, 2)
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    chain = Chain(mean, scale, np.zeros(3 * len(NAMES) + 1), np.zeros((2, 2)))
    theta = np.zeros(3 * len(NAMES) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        chain = Chain(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
        grad = summed(stored, partial(slopes, chain=chain)) / documents - ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(mean.astype(np.float32), scale.astype(np.float32), theta[:-4].astype(np.float32),
                 theta[-4:].reshape(2, 2))


def line_scores(lines: Lines, chain: Chain) -> np.ndarray:
    """Each line's probability of being good, given the whole document."""
    good = (with_neighbours(lines, chain.mean, chain.scale) @ chain.weights).astype(float)
    fore, back = passes(good, lines, chain.moves)
    odds = fore[:, 1] + back[:, 1] - fore[:, 0] - back[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fold_of(doc_id: F.Column | str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, held_out: int) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out fold: the ``doc_id`` with the smallest hashes.

    A ``doc_id`` that many rows share counts once, with the text of the smallest hash.
    """
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("_y"))
              .where(fold_of("doc_id", folds) != held_out)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(picked), "doc_id")  # bounded by ``rows``
    first = F.min(F.struct(F.xxhash64("text").alias("_hash"), "text"))
    return found.groupBy("doc_id", "_y").agg(first.alias("_first")).select("doc_id", "_y", "_first.text")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = FOLDS,
          held_out: int = HELD_OUT) -> Chain | None:
    """Line numbers are worked out and stored by the executors, and every step sums slopes over them."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lines = line_numbers(part.column("text"))
                kept = [lines.features[f:f + c].tobytes() for f, c in zip(lines.first, lines.count)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_y"), pa.array(kept, pa.binary())], names=["y", "numbers"])

    sample = fit_rows(docs, labels, "quality", rows, folds, held_out).select("doc_id", "_y", "text")
    placed = sample.repartition(FIT_PARTS, "doc_id").sortWithinPartitions("doc_id")
    return fit(materialise(placed.mapInArrow(numbers, "y int, numbers binary"), "line-numbers"))


def scored(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``doc_id``, the score, and how many lines there are and are likelier bad."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lines = line_numbers(part.column("text"))
                likely = np.ones(len(lines.document)) if chain is None else line_scores(lines, chain)
                weight = np.maximum(lines.length, 1)
                n = len(lines.count)
                total = np.bincount(lines.document, weight, n)
                value = np.bincount(lines.document, likely * weight, n) / total
                bad = np.bincount(lines.document[likely < 0.5], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.clip(value, 0, 1)), pa.array(lines.count.astype(np.int64)),
                     pa.array(bad.astype(np.int64))], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(score, "doc_id long, score double, n_lines long, n_bad_lines long")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    result = scored(docs, train(docs, labels))
    return result.select(
        "doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns and unchanged.

    The score is worked out beside the row, so rows that share a ``doc_id`` are judged each.
    """
    chain = train(docs, labels)
    if chain is None:
        return docs
    names, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.schema.names[at]):
                lines = line_numbers(part.column(at))
                weight = np.maximum(lines.length, 1)
                n = len(lines.count)
                value = np.bincount(lines.document, line_scores(lines, chain) * weight, n)
                yield part.filter(pa.array(value / np.bincount(lines.document, weight, n) >= threshold))

    return docs.mapInArrow(keep, names)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = [op6_quality_classifier]
ORACLES: dict[str, str] = {}
