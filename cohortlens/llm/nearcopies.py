"""N-gram Jaccard join: documents whose sets of word shingles are similar, by PartEnum signatures.

Sets of similar size fall into bands. Within a band, a similarity bound means
that two sets differ in at most *k* items. The domain of items is cut into more
partitions than *k* differences can spoil: one of them holds few differences,
so leaving out some of its parts in every possible way leaves one choice in
which the two sets agree. A signature is what a set holds in such a choice, and
similar sets share one. Candidates are then checked exactly.

What is compared: equal sets count once. In a first round, each set is compared
with the nearest of four pivots of each of its signatures; sets linked so far
form components. A second round looks at the pairs with a common signature that are
in different components, and only those become rows whose parity sketches do
not already prove them too different. So no link between different texts that
matters for a component is lost, and no group is expanded into all its pairs.

Defined cases: a null or empty text and one without words have an empty set
and are linked with nothing. Fewer words than a shingle has make one shingle.
Rows that share a ``doc_id`` count as one document with several sets. A null
``doc_id`` is linked with nothing and its component is null. Set numbers and
items are 64-bit hashes. Other columns of the input are not read.
"""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.shingles import (SKETCH_WORDS, long_parities, mixed, parities, set_number,
                                      shingle_sets)
from cohortlens.llm.tables import pieces, table
from cohortlens.storage import materialise

#: Items that the sparsest choice of parts should hold on average.
LEAST_ITEMS, LEAST_ITEMS_SMALL = 2.0, 4.5
#: Bits of the filter that tells which sets a check needs; its size is fixed, whatever the input.
FILTER_BITS = 1 << 25
#: In so many turns ``keep_one`` has the signatures shuffled; each makes them anew and holds its share of them on disk.
TURNS = 2
#: Words of the sketch that pairs of the second round are compared by; it is shorter for small sets.
WIDE_WORDS = 16
#: Pivots that a set is checked against in the first round, those whose sketches look nearest.
NEAREST = 2


class Scheme(NamedTuple):
    """How the sets of one band are cut: partitions, parts of each, parts left out, spare partitions."""
    partitions: int
    parts: int
    left_out: int
    spare: int


class Bands:
    """Bands of sizes for a similarity of ``percent`` hundredths, and the scheme of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1, 2]

    def edge(self, band: int) -> int:
        while len(self.edges) <= band + 1:
            e = self.edges[-1]
            self.edges.append(max(e + 1, e * 100 // self.percent + 1))
        return self.edges[band]

    def of(self, size: int) -> range:
        """The bands that sets similar to one of this size may fall in, its own and larger ones."""
        band = 0
        while self.edge(band + 1) <= size:
            band += 1
        last = band
        while self.edge(last + 1) * self.percent <= size * 100:
            last += 1
        return range(band, last + 1)

    @lru_cache(maxsize=None)  # noqa: B019  (one object per task)
    def scheme(self, band: int) -> Scheme | None:
        """The cheapest scheme whose choices hold enough items. None: only equal sets are similar."""
        low, high = self.edge(band), self.edge(band + 1) - 1
        smallest = max(1, -(-low * self.percent // 100))
        most = (100 - self.percent) * 2 * high // (100 + self.percent)
        if most == 0:
            return None
        best, best_rank = None, None
        for left_out in range(0, min(most, 5) + 1):
            for parts in range(left_out + 1, left_out + 5):
                n, ways = most // (left_out + 1) + 1, math.comb(parts, left_out)
                held = (parts - left_out) / parts * smallest / n
                spare = 0
                if n >= 8:
                    poor = n * min(1.0, ways * math.exp(-held))
                    spare = math.ceil(poor + 3 * math.sqrt(poor))
                n += spare
                held = (parts - left_out) / parts * smallest / n
                enough = held >= (LEAST_ITEMS if n >= 8 else LEAST_ITEMS_SMALL)
                rank = (not enough, n * ways if enough else -held)
                if best is None or rank < best_rank:
                    best, best_rank = Scheme(n, parts, left_out, spare), rank
        return best


def signatures(items: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures in all its bands.

    A choice that holds no item says little. Spare partitions make up for leaving such choices out: as
    long as no more partitions than the spare ones have one, some agreeing partition has none.
    """
    out = []
    for band in bands.of(len(items)) if len(items) else ():
        scheme = bands.scheme(band)
        if scheme is None:
            continue
        n, parts, left_out, spare = scheme
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        own = mixed(items + salt)
        part = ((own >> np.uint64(32)) * np.uint64(n * parts) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(n * parts, np.uint64)
        np.add.at(total, part, mixed(own))
        held = np.bincount(part, minlength=n * parts).reshape(n, parts)
        total = total.reshape(n, parts)
        chosen = list(combinations(range(parts), parts - left_out))
        sums = np.stack([total[:, c].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1)
        empty = np.stack([held[:, c].sum(axis=1) for c in chosen], axis=1) == 0
        place = np.arange(n * len(chosen), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt
        made = mixed(sums.ravel() + mixed(place))
        if empty.any() and empty.any(axis=1).sum() <= spare:
            made = made[~empty.ravel()]
        out.append(made)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, the set's size ``n``, its ``node`` number and its parity sketches, a short and a long one."""
    names = [f"p{i}" for i in range(SKETCH_WORDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                sketch = np.stack([parities(x) for x in sets])
                bits = [long_parities(x) for x in sets]
                ends = np.cumsum([0] + [len(x) for x in bits])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array([len(x) for x in sets], np.int64)),
                     pa.array(np.array([set_number(x) for x in sets], np.int64))]
                    + [pa.array(sketch[:, i].copy()) for i in range(SKETCH_WORDS)]
                    + [pa.LargeListArray.from_arrays(ends, pa.array(np.concatenate(bits))).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "n", "node"] + names + ["bits"])

    return _texts(docs).mapInArrow(describe, "doc_id long, n long, node long, " + ", ".join(f"{c} long" for c in names)
                                   + ", bits array<bigint>")


def signature_rows(docs: DataFrame, words: int, percent: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """``sig`` and ``node``, once for each different set of a task. A signature has its turn, one of ``turns``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, done = Bands(percent), set()
        for batch in batches:
            for part in pieces(batch, "text"):
                sigs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for doc, items in zip(part.column("doc_id").is_valid().to_pylist(), shingle_sets(part.column("text"), words)):
                    if not doc or not len(items):
                        continue
                    node = set_number(items)
                    if node not in done:
                        done.add(node)
                        own = signatures(items, bands)
                        sigs.append(own[own % turns == turn])
                        nodes.append(np.full(len(sigs[-1]), node))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))],
                                                 names=["sig", "node"])

    return _texts(docs).mapInArrow(sign, "sig long, node long")


def sketches_agree(percent: int) -> Column:
    """False where the long sketches prove the sets ``l`` and ``r`` too different."""
    x, y = F.col("l.bits"), F.col("r.bits")
    words = F.least(F.size(x), F.size(y))

    def word(bits: Column, i: Column) -> Column:
        # sizes of similar sets differ too little for more than one fold
        return F.when(F.size(bits) > words, F.get(bits, i).bitwiseXOR(F.get(bits, i + words))).otherwise(F.get(bits, i))

    differ = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0),
                         lambda n, i: n + F.bit_count(word(x, i).bitwiseXOR(word(y, i))))
    most = F.floor((100 - percent) * (F.col("l.n") + F.col("r.n")) / (100 + percent))
    return (F.greatest(F.size(x), F.size(y)) > 2 * words) | (differ <= most)


def forget_shuffles(spark: SparkSession) -> None:
    """Let the shuffles of finished steps go.

    Spark deletes a shuffle's files once the driver's collector finds it unreachable, which may be long
    after its table was written. Between two large steps it is worth asking for that. The last query
    is held until its listeners have heard of its end, hence the pause.
    """
    gc.collect()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def filter_bit(number: Column) -> tuple[Column, Column]:
    """The word of the filter that a whole number falls to, and its bit there."""
    place = F.pmod(number, F.lit(FILTER_BITS))
    return (F.shiftright(place, 6).cast("int"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")))


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets are similar, checked item by item.

    A set is read from the document that stands for it (``doc`` in ``nodes``), and only when the long
    sketches leave its pair open.
    """
    side = nodes.select("node", "n", "bits")
    pairs = pairs.join(side.select(F.col("node").alias("a"), F.struct("n", "bits").alias("l")), "a") \
        .join(side.select(F.col("node").alias("b"), F.struct("n", "bits").alias("r")), "b")
    pairs = materialise(pairs.where(sketches_agree(percent)).select("a", "b"), "open-pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                         .join(nodes.select("node", "doc"), "node"), "wanted")
    bits = FILTER_BITS
    word, bit = filter_bit(F.col("node").bitwiseXOR(F.col("doc")))
    found = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # at most FILTER_BITS / 64 rows
    held = np.zeros(bits // 64, np.int64)
    for r in found:
        held[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(held.view(np.uint8))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, done = shared.value, set()
        for batch in batches:
            for part in pieces(batch, "text"):
                nodes, ids, sets = [], [], []
                for doc, items in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), words)):
                    if doc is None or not len(items):
                        continue
                    node = int(set_number(items))
                    at = (node ^ doc) % bits
                    # a copy that the filter lets through by accident must not hide the document that stands
                    if bitmap[at >> 3] >> (at & 7) & 1 and (node, doc) not in done:
                        done.add((node, doc))
                        nodes.append(node)
                        ids.append(doc)
                        sets.append(items.astype(np.int64))
                ends = np.cumsum([0] + [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(ids, pa.int64()), pa.LargeListArray.from_arrays(ends, pa.array(
                        np.concatenate(sets) if sets else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))],
                    names=["node", "doc", "items"])

    sets = materialise(_texts(docs).mapInArrow(collect, "node long, doc long, items array<bigint>")
                       .join(wanted, ["node", "doc"], "left_semi").dropDuplicates(["node", "doc"]).drop("doc"), "sets")
    forget_shuffles(docs.sparkSession)
    common = F.size(F.array_intersect("x", "y"))
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
    return joined.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s")) \
        .where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def folded(bits: Column, words: int = WIDE_WORDS) -> Column:
    """A long sketch of at most ``words`` words; folded sketches of two sets differ in no more bits than the sets do."""
    def word(i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(bits) - 1, F.lit(words)), F.lit(0).cast("long"),
                           lambda x, j: x.bitwiseXOR(F.get(bits, j)))

    return F.when(F.size(bits) <= words, bits).otherwise(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word))


def differing() -> Column:
    """Items in which the sets ``l`` and ``r`` differ at least, by their parity sketches."""
    return sum((F.bit_count(F.col(f"l.p{i}").bitwiseXOR(F.col(f"r.p{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))


def may_link(percent: int) -> Column:
    """False where sizes or parity sketches prove the sets ``l`` and ``r`` too different."""
    most = F.floor((100 - percent) * (F.col("l.n") + F.col("r.n")) / (100 + percent))
    return (differing() <= most) & (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n"))


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80, turns: int = 1) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row.

    More ``turns`` need less disk at a time and more CPU time; the rows are the same.
    """
    every = materialise(document_sets(docs, words), "document-sets")
    rows = every.drop("bits")
    sketch = [f"p{i}" for i in range(SKETCH_WORDS)]
    nodes = materialise(every.where("n > 0 and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in sketch], F.max("bits").alias("bits")), "nodes")
    same = W.partitionBy("sig")
    turned = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"))
    parts = []
    for turn in range(turns):
        signed = signature_rows(docs, words, percent, turn, turns).select(
            "sig", "node", F.min("node").over(same).alias("pivot0"), F.max("node").over(same).alias("pivot1"),
            F.min(turned).over(same)["pivot"].alias("pivot2"), F.max(turned).over(same)["pivot"].alias("pivot3"))
        parts.append(materialise(signed.where("pivot0 != pivot1").distinct(), "signatures"))
        del signed  # or its shuffle stays
        forget_shuffles(docs.sparkSession)
    shared = reduce(DataFrame.unionByName, parts)

    known = nodes.select("node", "n", *sketch)
    stars = [shared.select("node", F.col(p).alias("pivot")).where("node != pivot")
             for p in ("pivot0", "pivot1", "pivot2", "pivot3")]
    pairs = reduce(DataFrame.unionByName, stars).distinct()
    pairs = pairs.join(known.select(F.struct("n", *sketch).alias("l"), "node"), "node") \
        .join(known.select(F.struct("n", *sketch).alias("r"), F.col("node").alias("pivot")), "pivot")
    # the pivots that look nearest; the others come up again in the second round
    nearest = W.partitionBy("node").orderBy(differing(), "pivot")
    tried = materialise(pairs.where(may_link(percent)).withColumn("_r", F.row_number().over(nearest))
                        .where(F.col("_r") <= NEAREST)
                        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
    forget_shuffles(docs.sparkSession)
    # sets of one document belong together, whatever they hold
    twins = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    kin = rows.join(twins.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("n > 0 and a != node")
    first = components(similar(tried, docs, nodes, words, percent).unionByName(kin))
    first = materialise(first, "components")
    forget_shuffles(docs.sparkSession)

    placed = shared.select("sig", "node").join(first, "node", "left").select(
        "sig", "node", F.coalesce("component", "node").alias("component"))
    mixed_sigs = placed.groupBy("sig").agg(F.min("component").alias("_x"), F.max("component").alias("_y")) \
        .where("_x != _y").select("sig")
    # large sets differ in more items than the short sketch has bits, so here they bring a wider one
    wide = nodes.select("node", "n", *sketch, folded(F.col("bits")).alias("bits"))
    open_rows = materialise(placed.join(mixed_sigs, "sig", "left_semi").join(wide, "node"), "open")
    left, right = open_rows.alias("l"), open_rows.alias("r")
    cross = left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.node") < F.col("r.node"))
                      & (F.col("l.component") != F.col("r.component")) & may_link(percent) & sketches_agree(percent)).select(
        F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    cross = materialise(cross.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = similar(cross, docs, nodes, words, percent)
    of = first.select(F.col("node"), F.col("component"))
    more = (more.join(of.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("_final"))

    final = (nodes.select("node", "doc").join(first, "node", "left")
             .select("node", "doc", F.coalesce("component", "node").alias("component"))
             .join(second, "component", "left")
             .select("node", "doc", F.coalesce("_final", "component").alias("component")))
    least = final.groupBy("component").agg(F.min("doc").alias("component_id"))
    final = final.join(least, "component").select("node", "component_id")
    linked = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return linked.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, unchanged; null ids stay.

    Of several rows with a kept id, the one with the smallest text stays.
    """
    linked = materialise(link_documents(docs, words, percent, TURNS).where("doc_id is not null").groupBy("doc_id").agg(
        F.count_if(F.col("doc_id") == F.col("component_id")).alias("_rows")), "kept")
    forget_shuffles(docs.sparkSession)
    at = F.col("doc_id").cast("long")
    # a filter of fixed size holds the ids that go or come repeatedly: only rows that it catches are joined, the others stay
    word, bit = filter_bit(F.xxhash64(at))
    caught = linked.where("_rows != 1").select(word.alias("__word"), bit.alias("__bit")) \
        .groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))  # at most FILTER_BITS / 64 rows
    marked = docs.join(F.broadcast(caught), word == F.col("__word"), "left")
    hit = F.coalesce("__bits", F.lit(0)).bitwiseAND(bit) != 0
    sure = marked.where(F.col("doc_id").isNull() | (at.isNotNull() & ~hit)).drop("__word", "__bits")
    doubtful = marked.where(at.isNotNull() & hit).drop("__word", "__bits")
    ids = linked.select(F.col("doc_id").alias("__kept_id"), "_rows")
    kept = sure.unionByName(doubtful.join(ids.where("_rows = 1"), at == F.col("__kept_id"), "left_semi"))
    repeated = ids.where("_rows > 1")
    if repeated.head(1):
        order = W.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
        several = doubtful.join(repeated, at == F.col("__kept_id"), "left_semi").withColumn("__first", F.row_number().over(order))
        kept = kept.unionByName(several.where("__first = 1").drop("__first"))
    return kept


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


QUERIES = [op8_jaccard_join]
ORACLES: dict[str, str] = {}
