"""LM scoring: prediction by partial matching over bytes, beside a smoothed unigram base.

A trie holds byte contexts up to ``ORDER`` bytes with what followed them in the
training documents. A byte is predicted by its longest known context; a byte
that did not follow there costs an escape (method C: as many escapes as
different followers) and is looked up in the next shorter context, where the
followers of the longer one no longer count (exclusion). The end of a text is
a byte of its own. Text probabilities therefore sum to one or less.

Word counts and n-gram counts come from all training documents, and every
context that occurs there is known, however rare, so the model grows with the
input. Contexts of up to ``SHORT`` bytes are broadcast; the longer ones stay
distributed by their last bytes, and each group works out the costs of the
different keys (context and byte) of all texts that fall to it. Keys that make
up ``2 ** -KEY_BITS`` of all positions are then broadcast with their costs, at
most ``2 ** KEY_BITS`` of them; each piece of text asks the groups for the
others, in small blocks of sorted keys. Rare words are joined, the others
broadcast in the same way with ``WORD_BITS``. So these two bound what is sent to
every task and leave nothing out.

Defined cases: a null text counts as empty: one end token. A null ``doc_id``
is in no held-out part, so it trains. Repeated rows train and are scored each.
Without training documents all bytes are equally likely. Other columns of the
input are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.nearcopies import forget_shuffles
from cohortlens.llm.tables import pieces, table
from cohortlens.storage import materialise

ORDER = 6
KEY_BITS, WORD_BITS = 22, 20
#: Contexts of up to so many bytes are few enough to be broadcast with their followers.
SHORT = 2
#: With a number, a context longer than ``SHORT`` needs a share of ``2 ** -CONTEXT_BITS`` of all positions.
CONTEXT_BITS: int | None = None
FOLDS, HELD_OUT = 7, 2
#: Odd, so keys times it are different too (the golden ratio's bits).
MIX = 0x9E3779B97F4A7C15
#: Not a byte of any UTF-8 text.
END = 255
SYMBOLS = 256
SHORT_MASK = (1 << 8 * (SHORT + 1)) - 1
#: Distinct words, or a quarter of the n-grams, that a task holds before it hands them on.
HELD = 250_000
ROWS_AT_ONCE = 10_000
#: Groups that the contexts are dealt to by their last ``SHORT + 1`` bytes: one for so many positions, up to the most.
GROUP_POSITIONS, MOST_GROUPS = 1 << 19, 4096
#: Bytes of text that a task works on at once when it counts and when it scores.
PIECE, SCORED = 2 << 20, 3 << 20


def byte_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte with the ``ORDER`` before it, and each text's count."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    joined = bytes(ORDER) + (bytes([END]) + bytes(ORDER)).join(texts) + bytes([END])
    raw = np.frombuffer(joined, np.uint8).astype(np.uint64)
    key = raw[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= raw[ORDER - j:len(raw) - j] << np.uint64(8 * j)
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    real = np.ones(len(key), bool)
    for j in range(ORDER):
        real[starts[1:] - ORDER + j] = False
    return key[real], lengths


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread over all 64 bits, one for each; ``unmixed`` gives them back."""
    return keys * np.uint64(MIX)


def unmixed(spread: np.ndarray) -> np.ndarray:
    return spread * np.uint64(pow(MIX, -1, 1 << 64))


def distinct(spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and the place of each number among them.

    The leading bits are sorted with the place in the others, which is several times as fast as to sort places.
    Where two different numbers share them, the usual way is taken.
    """
    low = np.uint64(max(1, (len(spread) - 1).bit_length()))
    sort = spread >> low
    sort <<= low
    sort |= np.arange(len(spread), dtype=np.uint64)
    sort.sort()
    sort &= (np.uint64(1) << low) - np.uint64(1)
    at = sort.view(np.int64)
    each = spread[at]
    first = np.ones(len(each), bool)
    first[1:] = each[1:] != each[:-1]
    back = np.empty(len(each), np.int32)
    back[at] = np.cumsum(first, dtype=np.int32) - 1
    each = each[first]
    if (each[1:] < each[:-1]).any() or len(each) > 1 and (each[1:] >> low == each[:-1] >> low).any():
        each, back = np.unique(spread, return_inverse=True)
    return each, back


def batches_of(columns: list[pa.Array], names: list[str]) -> list[pa.RecordBatch]:
    """Rows in batches that the other side can hold beside its own work."""
    return pa.table(columns, names=names).to_batches(max_chunksize=ROWS_AT_ONCE)


def training_counts(docs: DataFrame) -> DataFrame:
    """``word`` or short ``key`` with its count ``n`` in all training documents; the end token is the empty word.

    A key is a byte with the ``SHORT`` bytes before it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _MODELS.clear()  # a model of an earlier query is of no use here
        words: Counter = Counter()
        short: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> list[pa.RecordBatch]:
            n = len(words)
            keys, times = merged(short)
            out = batches_of([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()),
                              pa.array(list(words.values()), pa.int64())], ["word", "key", "n"])
            out += batches_of([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)),
                               pa.array(times)], ["word", "key", "n"])
            words.clear()
            short.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                for t in texts:
                    words.update(t.lower().split())
                words[b""] += len(texts)
                short.append(np.unique(byte_keys(texts)[0] & np.uint64(SHORT_MASK), return_counts=True))
                if len(short) > 16:
                    short[:] = [merged(short)]
                if len(words) > HELD:
                    yield from rows()
        if words:
            yield from rows()

    own = docs.where(~F.coalesce(is_held_out(), F.lit(False))).select(F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(count, "word binary, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def turned(key: np.ndarray) -> np.ndarray:
    """The bytes before the last one in reverse, so that contexts with the same ending sort together; its own inverse."""
    out = key & np.uint64(255)
    for j in range(1, ORDER + 1):
        out |= (key >> np.uint64(8 * j) & np.uint64(255)) << np.uint64(8 * (ORDER + 1 - j))
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers of one type, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize)
    planes = np.empty((numbers.itemsize, len(raw)), np.uint8)
    for j in range(numbers.itemsize):  # several times as fast as a copy of the transposed bytes
        planes[j] = raw[:, j]
    return pa.Codec("zstd").compress(planes, asbytes=True)


def restored(block: bytes, kind: type, shape: tuple[int, int]) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(block, decompressed_size=width * shape[0] * shape[1], asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).reshape(shape)


def packed(grams: np.ndarray, beside: np.ndarray, among: int) -> tuple[list[int], list[int], list[bytes], np.ndarray]:
    """Sorted turned grams and the numbers beside them as one small block for each of ``among`` groups of contexts.

    Gives groups, sizes, blocks and the order in which the blocks have the grams. A block holds the steps from
    gram to gram and the numbers, byte plane by byte plane, compressed.
    """
    last = grams >> np.uint64(8 * (ORDER - SHORT))
    group = ((last * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(among) >> np.uint64(32)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    grams, group = grams[order], group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(grams) else np.zeros(0, np.int64)
    step = np.r_[grams[:1], grams[1:] - grams[:-1]]
    step[first] = grams[first]
    numbers = np.column_stack([step, beside[order].astype(np.uint64)])
    ends = np.r_[first[1:], len(grams)].astype(np.int64)
    blocks = [squeezed(numbers[a:b].T) for a, b in zip(first, ends)]
    return group[first].tolist(), (ends - first).tolist(), blocks, order


def unpacked(size: int, block: bytes, beside: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's turned grams and the ``beside`` numbers of each."""
    numbers = restored(block, np.uint64, (1 + beside, size))
    return np.cumsum(numbers[0], dtype=np.uint64), numbers[1:].T.astype(np.int64)


def gram_blocks(docs: DataFrame, among: int) -> DataFrame:
    """The grams of all documents with their counts in training and in all, packed by ``group`` of contexts.

    A gram that only held-out documents have counts 0 times in training.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []  # grams of all positions, and a last bit that tells training from held out
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add_up() -> None:
            held.append(np.unique(np.concatenate(waiting), return_counts=True))
            waiting.clear()
            held[:] = [merged(held)] if len(held) > 1 else held

        def rows() -> pa.RecordBatch:
            marked, n = held[0]
            grams = marked >> np.uint64(1)
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            trains = np.add.reduceat(n * (marked & np.uint64(1) == 0), first)
            groups, sizes, blocks, _ = packed(grams[first], np.stack([trains, np.add.reduceat(n, first)], axis=1), among)
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(sizes, pa.int64()),
                                               pa.array(blocks, pa.binary())], names=["group", "size", "block"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                out = part.column("held_out").to_pylist()
                keys, lengths = byte_keys(texts)
                marked = turned(keys) << np.uint64(1)
                marked |= np.repeat(np.array(out, np.uint64), lengths)
                waiting.append(marked)
                if sum(map(len, waiting)) > 16 * HELD:
                    add_up()
                    if len(held[0][0]) > 4 * HELD:
                        yield rows()
                        held.clear()
        if waiting:
            add_up()
        if held:
            yield rows()

    own = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(is_held_out(), F.lit(False)).alias("held_out"))
    return own.mapInArrow(count, "group int, size long, block binary")


def merged(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts, or rows of counts, by key of several sorted blocks."""
    keys, n = np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys[first], n
    if n.ndim == 1:
        return keys[first], np.add.reduceat(n, first)
    return keys[first], np.stack([np.add.reduceat(c, first) for c in n.T], axis=1)


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT


def short_trie(counts: DataFrame) -> Trie:
    """The contexts of up to ``SHORT`` bytes and their followers in all training documents."""
    found = counts.where("key is not null").select("key", "n").toArrow()  # 2 ** 24 kinds of three bytes at most
    return Trie(*followers(found.column("key").to_numpy(), found.column("n").to_numpy(), SHORT, -1))


def followers(key: np.ndarray, n: np.ndarray, high: int, low: int, least: int = 1) -> list[np.ndarray]:
    """k, key and count of what follows the contexts of k bytes, from ``high`` down to above ``low``."""
    keys, out = key.astype(np.uint64), []
    for k in range(high, low, -1):
        keys, n = merged([(keys & np.uint64((1 << 8 * (k + 1)) - 1), n)])
        kept = np.ones(len(keys), bool)
        if least > 1 and k > SHORT and len(keys):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            kept = np.repeat(np.add.reduceat(n, first) >= least, np.diff(np.r_[first, len(keys)]))
        out.append((np.full(kept.sum(), k, np.int32), keys[kept], n[kept]))
    return [np.concatenate(c) for c in zip(*out)]


def key_costs(docs: DataFrame, counts: DataFrame, common: int, among: int) -> DataFrame:
    """The ``cost`` of a gram's last byte after the others, for all grams of the documents.

    Grams that occur ``common`` times or more have a row each, the others are packed by ``group`` with the bits
    of their costs. Grams are dealt out by the ``SHORT + 1`` bytes before the last one, so a group has all
    positions of each of its longer contexts. The shorter ones are the same for all groups. A task takes its
    groups one after the other and adds their blocks up as they come: it holds the different grams of one group.
    """
    least = 1
    if CONTEXT_BITS is not None:
        total = counts.where("key is not null").agg(F.sum("n")).first()[0] or 0
        least = max(1, -(-total >> CONTEXT_BITS))
    shared = counts.sparkSession.sparkContext.broadcast(short_trie(counts))
    names = ["gram", "cost", "group", "size", "block"]

    def priced(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams, times = merged(held)
        gram, n = turned(grams), times[:, 0]
        trie = Trie(*followers(gram[n > 0], n[n > 0], ORDER, SHORT, least), shared.value)
        costs = trie.costs(gram)
        often = times[:, 1] >= common
        k = int(often.sum())
        yield from batches_of([pa.array(gram[often].astype(np.int64)), pa.array(costs[often]), pa.nulls(k, pa.int32()),
                               pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        bits = costs[~often].astype(np.float32).view(np.uint32)[:, None]
        for a in range(0, len(bits), 4 * HELD):
            groups, sizes, blocks, _ = packed(grams[~often][a:a + 4 * HELD], bits[a:a + 4 * HELD], among)
            k = len(groups)
            yield from batches_of([pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(groups, pa.int32()),
                                   pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, waiting = [], None, 0
        for batch in batches:
            for group, size, block in zip(*(batch.column(c) for c in ("group", "size", "block"))):
                if now is not None and group.as_py() != now:
                    yield from priced(held)
                    held, waiting = [], 0
                now = group.as_py()
                held.append(unpacked(size.as_py(), block.as_py(), 2))
                waiting += size.as_py()
                if waiting > max(HELD, len(held[0][0])):
                    held, waiting = [merged(held)], 0
        if held:
            yield from priced(held)

    blocks = gram_blocks(docs, among).repartition("group").sortWithinPartitions("group")
    return blocks.mapInArrow(cost, "gram long, cost double, group int, size long, block binary")


def answers(costs: DataFrame, asked: DataFrame) -> DataFrame:
    """For each block of grams that a piece of text asks for, the costs in the block's order.

    Costs of a group come before what is asked of it, so a task holds the grams of one group again.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, grams, cost = None, [], np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            piece, start, out = [], [], []
            for row in zip(*(batch.column(c) for c in ("group", "piece", "start", "size", "block"))):
                group, asker, at, size, block = (v.as_py() for v in row)
                if group != now:
                    now, known, grams = group, [], None
                if asker is None:
                    known.append(unpacked(size, block, 1))
                    continue
                if grams is None:
                    grams = np.concatenate([g for g, _ in known])
                    order = np.argsort(grams)
                    grams = grams[order]
                    cost = np.concatenate([c[:, 0] for _, c in known])[order].astype(np.uint32).view(np.float32)
                    known = []
                piece.append(asker)
                start.append(at)
                out.append(cost[np.searchsorted(grams, unpacked(size, block, 0)[0])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(start, pa.int64()),
                                              pa.array(out, pa.binary())], names=["piece", "start", "costs"])

    both = costs.where("block is not null").select(
        "group", F.lit(None).cast("long").alias("piece"), F.lit(None).cast("long").alias("start"), "size", "block").unionByName(
        asked.select("group", "piece", "start", "size", "block"))
    sorted_ = both.repartition("group").sortWithinPartitions("group", F.col("piece").asc_nulls_first())
    return sorted_.mapInArrow(answer, "piece long, start long, costs binary")


def added(_key, piece: pa.Table, found: pa.Table) -> pa.Table:
    """``row`` and the sum of its grams' costs, for the texts of one piece and the answers to it."""
    order = np.argsort(found.column("start").to_numpy())
    blocks = found.column("costs").to_pylist()
    costs = np.frombuffer(b"".join([blocks[i] for i in order]), np.float32).astype(float)
    n = np.array(piece.column("n_grams")[0].as_py(), np.int64)
    step, times = restored(piece.column("grams")[0].as_py(), np.uint32, (2, int(n.sum())))
    some = np.flatnonzero(n)
    sums = np.add.reduceat(costs[np.cumsum(step, dtype=np.uint32)] * times, (np.cumsum(n) - n)[some])
    return pa.table([pa.array(piece.column("piece")[0].as_py() + some), pa.array(sums)], names=["row", "_score"])


class Trie:
    """Contexts and followers by order, with the costs that escape and exclusion give them.

    A follower of a context also follows its shorter ones, as those count the same positions. So when a
    byte is escaped from a context, what is excluded in the next shorter one is just the followers of
    that context, and both denominators there depend on the longer context alone.
    """

    def __init__(self, k: np.ndarray, key: np.ndarray, n: np.ndarray, short: Trie | None = None):
        """With ``short``, contexts of up to ``SHORT`` bytes are taken from there."""
        self.keys, self.hit, self.log_n = [], [], []
        self.contexts, self.escape, self.below, self.escape_below = [], [], [], []
        before = self.before = None
        if short is not None:
            for name in ("keys", "hit", "log_n", "contexts", "escape", "below", "escape_below"):
                setattr(self, name, getattr(short, name)[:SHORT + 1])
            before = short.before
        for order in range(len(self.keys), ORDER + 1):
            at = k == order
            keys, count = key[at].astype(np.uint64), n[at].astype(float)
            sort = np.argsort(keys)
            keys, count = keys[sort], count[sort]
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(keys)]).astype(float)
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            self.keys.append(keys)
            self.contexts.append(context[first])
            self.log_n.append(np.log10(count).astype(np.float32))
            self.hit.append((np.log10(count) - np.repeat(np.log10(total + size), size.astype(int))).astype(np.float32))
            self.escape.append(np.log10(size) - np.log10(total + size))
            if order and len(first):
                keys_below, count_below, contexts_below, total_below, size_below = before
                same = count_below[np.searchsorted(keys_below, keys & np.uint64((1 << 8 * order) - 1))]
                parent = np.searchsorted(contexts_below, context[first] & np.uint64((1 << 8 * (order - 1)) - 1))
                more = size_below[parent] - size
                rest = total_below[parent] - np.add.reduceat(same, first) + more
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.below.append(np.where(more > 0, np.log10(rest), 0))
                    self.escape_below.append(np.where(more > 0, np.log10(more) - np.log10(rest), 0))
            else:
                self.below.append(np.zeros(0))
                self.escape_below.append(np.zeros(0))
            before = keys, count, context[first], total, size
            if order == SHORT:
                self.before = before
        self.unseen = SYMBOLS - len(self.keys[0])

    def costs(self, key: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's last byte after the bytes before it."""
        out = np.zeros(len(key))
        open_ = np.arange(len(key))
        above = np.full(len(key), -1)  # the context escaped from, one order up
        for order in range(ORDER, -1, -1):
            if not len(open_):
                return out
            mine = key[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            keys, contexts = self.keys[order], self.contexts[order]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            found = keys[at] == mine
            came = above[open_]
            top = came < 0
            one, two = found & top, found & ~top
            out[open_[one]] += self.hit[order][at[one]]
            if two.any():
                out[open_[two]] += self.log_n[order][at[two]] - self.below[order + 1][came[two]]
            miss = ~found
            open_, mine, came = open_[miss], mine[miss], came[miss]
            context = mine >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            enter = known & (came < 0)
            out[open_[enter]] += self.escape[order][at[enter]]
            if (came >= 0).any():
                out[open_[came >= 0]] += self.escape_below[order + 1][came[came >= 0]]
            above[open_] = np.where(known, at, -1)
        out[open_] -= math.log10(self.unseen if self.unseen and len(self.keys[0]) else SYMBOLS)
        return out


_MODELS: dict[str, tuple] = {}


def scored(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` scored by both models; ``counts`` is the stored table of ``training_counts``."""
    spark = docs.sparkSession
    words = counts.where("word is not null").select("word", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = totals["n"] or 0, totals["v"]
    forget_shuffles(spark)
    positions = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)) + F.lit(1))).first()[0] or 0
    common = max(1, -(-positions >> KEY_BITS))
    among = min(MOST_GROUPS, max(1, positions // GROUP_POSITIONS))
    costs = materialise(key_costs(docs, counts, common, among), "costs")
    forget_shuffles(spark)
    found = costs.where("gram is not null").select("gram", "cost").toArrow()  # 2 ** KEY_BITS rows at most
    spread = mixed(found.column("gram").to_numpy().astype(np.uint64))
    order = np.argsort(spread)
    frequent = spread[order], found.column("cost").to_numpy()[order]
    often = words.where(F.col("n") * (1 << WORD_BITS) >= tokens).toArrow()  # 2 ** WORD_BITS rows at most
    logs = dict(zip(often.column("word").to_pylist(), np.log10(often.column("n").to_numpy() + 1.0).tolist()))
    ends = next((r["n"] for r in words.where(F.length("word") == 0).collect()), 0)
    logs.pop(b"", None)
    shared = spark.sparkContext.broadcast((frequent, logs))
    forget_shuffles(spark)
    name, one_end, spread = uuid.uuid4().hex, math.log10(ends + 1), math.log10(tokens + kinds + 1)

    layout = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
        ("piece", pa.int64()), ("n_grams", pa.list_(pa.int64())), ("grams", pa.binary()), ("group", pa.int32()),
        ("start", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])

    def only(n: int, **own: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(n, f.type)) for f in layout], schema=layout)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:  # once per worker process
            _MODELS.clear()
            _MODELS[name] = shared.value
        (often, cost), known = _MODELS[name]
        number, none = TaskContext.get().partitionId() << 36, float("nan")
        for batch in batches:
            for part in pieces(batch, "text", SCORED):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                keys, lengths = byte_keys(texts)
                each, back = distinct(mixed(keys))
                del keys
                n, at = len(texts), np.searchsorted(often, each)
                here = np.zeros(len(each), bool)
                here[at < len(often)] = often[at[at < len(often)]] == each[at < len(often)]
                own = np.zeros(len(each))
                own[here] = cost[at[here]]
                value = np.add.reduceat(own[back], np.cumsum(lengths) - lengths)
                grams = turned(unmixed(each[~here]))
                sort = np.argsort(grams)
                groups, sizes, blocks, deal = packed(grams[sort], np.zeros((len(grams), 0), np.uint64), among)
                place = np.zeros(len(each), np.int32)
                place[np.flatnonzero(~here)[sort[deal]]] = np.arange(len(grams))
                lack = np.flatnonzero(~here[back])
                which, gram_times = np.unique((np.repeat(np.arange(n), lengths)[lack] << 32) + place[back[lack]], return_counts=True)
                ends_at = np.searchsorted(which, np.arange(n + 1) << 32)
                starts = (np.cumsum(sizes) - sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
                yield only(len(groups), piece=pa.array(np.full(len(groups), number)), group=pa.array(groups, pa.int32()),
                           start=pa.array(starts), size=pa.array(sizes, pa.int64()), block=pa.array(blocks, pa.binary()))
                if len(which):
                    # places from text to text go down, so steps and their sums are taken modulo 2 ** 32
                    step = np.diff((which & 0xFFFFFFFF).astype(np.uint32), prepend=np.uint32(0))
                    yield only(1, piece=pa.array([number]), n_grams=pa.array([np.diff(ends_at)], pa.list_(pa.int64())),
                               grams=pa.array([squeezed(np.stack([step, gram_times.astype(np.uint32)]))], pa.binary()))
                count, base, seen, rare, times = [], [], [], [], []
                for t in texts:
                    every = t.lower().split()
                    logs = np.fromiter(map(known.get, every, repeat(none)), float, len(every))
                    lost = np.flatnonzero(np.isnan(logs))
                    odd = Counter([every[i] for i in lost])
                    count.append(len(every) + 1)
                    base.append(float(np.nansum(logs)) + one_end - spread * (len(every) + 1))
                    seen.append(len(every) - len(lost) + (ends > 0))
                    rare.append(list(odd))
                    times.append(list(odd.values()))
                yield only(n, doc_id=part.column("doc_id"), held_out=part.column("held_out"),
                           row=pa.array(np.arange(number, number + n)), n_tokens=pa.array(count, pa.int64()),
                           n_known=pa.array(seen, pa.int64()), base_score=pa.array(base, pa.float64()), score=pa.array(value),
                           rare=pa.array(rare, pa.list_(pa.binary())), times=pa.array(times, pa.list_(pa.int64())))
                number += n

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                      F.coalesce(is_held_out(), F.lit(False)).alias("held_out"))
    stored = materialise(own.mapInArrow(
        score, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, "
        "score double, rare array<binary>, times array<bigint>, piece long, n_grams array<bigint>, grams binary, "
        "group int, start long, size long, block binary"), "scores")
    part = stored.where("row is not null").drop("piece", "n_grams", "grams", "group", "start", "size", "block")
    each = part.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    # none of these words is frequent, so no key of this join is hot; its shuffles go before those of the grams come
    rare = materialise(each.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known")), "rare")
    forget_shuffles(spark)
    replies = answers(costs, stored.where("block is not null"))
    asking = stored.where("grams is not null").select("piece", "n_grams", "grams")
    lacked = asking.groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(added, "row long, _score double")
    return part.drop("rare", "times").join(rare, "row", "left").join(lacked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, materialise(training_counts(docs), "counts"))


QUERIES = [op3_lm_scoring]
ORACLES: dict[str, str] = {}
