"""Conversation prefix trie: what conversations share, summed up by time-forward processing.

Conversations are rebuilt (the first turns of a block's first conversation, then
their own), and every distinct sequence of first turns is a node. A sequence is
known by the exclusive or of hashes of its turns with their places, 128 bits in
all, so the keys of all prefixes are running sums. Turns are ordered by ranges
over all rows, and ranges are joined up by their totals: no task holds a whole
conversation.

A node with one member begins a tail whose numbers are plain. The other nodes
are processed in reverse level order, deepest first and by conversation within
a level. A node sends its subtree's totals forward to its parent through a
priority queue in that same order, so they lie on top when the parent's turn
comes; a queue over its limit sorts what it holds and spills it. A node with at
most ``SHARD_ROWS`` rows (or ``1 / TOP_SHARE`` of all) at or below it, whose parent has
more, is the root of a shard. Shards are processed side by side, and what their
roots send is summed by parent. Then the nodes above all shards are processed in
the same way: at most ``TOP_SHARE`` a level.

Defined cases: rows without a ``conv_id`` belong to no conversation. A null role
or text counts as empty, a null turn comes first. Turns with one number stand by
role and text (the first ``HEAD`` characters, then the hash); repeated rows are
turns each. A conversation whose turns are all replaced by none is a member of
the root only. An empty table has no nodes. A very long text is only hashed and
measured. The list of ids behind ``ends_sha256`` is hashed as a stream in the
order of ids, one node after another, and never held. Other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.tables import table
from cohortlens.storage import broadcast_if_small, materialise

#: Conversations in a block, and how many different numbers of turns they may share (0 to one less).
BLOCK, SHARES = 5, 9
#: Characters of a role or text that turns with the same number are ordered by.
HEAD = 32
#: Rows at or below the root of a shard, or a share of all rows if that is more.
SHARD_ROWS, TOP_SHARE = 50_000, 4096
#: Rows of a range of turns.
RANGE_ROWS = 500_000
#: Messages that a queue holds in memory.
QUEUE = 200_000
#: Ids that are hashed at once.
IDS = 10_000
KEY = ["k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn's number in its conversation, two hashes and its bytes; ``part`` is the range it lies in."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, HEAD).alias("role"),
        F.substring(text, 1, HEAD).alias("head"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("again"), text, role).alias("h2"), F.octet_length(text).alias("bytes"),
        F.monotonically_increasing_id().alias("row"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(conversations.count() / RANGE_ROWS))
    order = ["turn", "role", "head", "h1", "h2", "row"]
    ranged = materialise(own.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    here = Window.partitionBy("conv_id", "part")
    return ranged.select("conv_id", "part", "h1", "h2", "bytes", F.row_number().over(here.orderBy(*order)).alias("number"))


def joined_up(parts: DataFrame, totals: list[Column]) -> DataFrame:
    """For each range of a conversation, the ``totals`` (of names ``_before...``) of the ranges before it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv_id", "part", *[t.over(before).alias(f"_before{i}") for i, t in enumerate(totals)])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the conversations with their ``length``, and the key of each of their prefixes.

    ``k1, k2`` are the prefix's key, ``p1, p2`` that of the prefix one turn shorter.
    """
    local = turns(conversations)
    sizes = materialise(local.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "sizes")
    numbered = local.join(joined_up(sizes, [F.sum("n")]), ["conv_id", "part"]).withColumn(
        "number", F.col("number") + F.coalesce("_before0", F.lit(0))).drop("_before0")
    numbered = materialise(numbered, "numbered")
    counts = sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARES
    convs = counts.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    first = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = materialise(convs.select("conv_id", "base", "h", "taken", (
        F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")

    facts = broadcast_if_small(convs.select("conv_id", "h", "taken", "length"))
    own = numbered.join(facts, "conv_id").where("number > h").select(
        "conv_id", "part", "length", (F.col("number") - F.col("h") + F.col("taken")).alias("depth"), "h1", "h2", "bytes")
    lent = numbered.where(F.col("number") < SHARES).select(F.col("conv_id").alias("base"), "number", "h1", "h2", "bytes")
    lent = convs.join(lent, "base").where("number <= taken").select(
        "conv_id", F.lit(-1).alias("part"), "length", F.col("number").alias("depth"), "h1", "h2", "bytes")
    marked = own.unionByName(lent).select(
        "conv_id", "part", "length", "depth", "bytes", F.xxhash64("depth", "h1", "h2").alias("x1"),
        F.xxhash64(F.lit("again"), "h2", "depth", "h1").alias("x2"))
    marked = materialise(marked, "marked")
    sums = marked.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    starts = joined_up(sums, [F.bit_xor("x1"), F.bit_xor("x2")])
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = marked.select("*", F.bit_xor("x1").over(so_far).alias("_k1"), F.bit_xor("x2").over(so_far).alias("_k2")) \
        .join(starts, ["conv_id", "part"])
    k1, k2 = (F.col(f"_k{i + 1}").bitwiseXOR(F.coalesce(f"_before{i}", F.lit(0).cast("long"))) for i in range(2))
    prefixes = keys.select("conv_id", "length", "depth", "bytes", k1.alias("k1"), k2.alias("k2"),
                           k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"))
    return convs, materialise(prefixes, "prefixes")


class Queue:
    """A priority queue of tuples that spills sorted runs to the executor's own spill folder."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            # deleted when the task lets it go; a lost executor's task begins anew elsewhere
            file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for i in range(0, len(self.heap), 1000):
                pickle.dump(self.heap[i:i + 1000], file)
            file.seek(0)
            self.heap = []
            self._next(self._read(file), len(self.runs))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple], number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def pop_while(self, key: tuple) -> Iterator[tuple]:
        """The messages whose first items are ``key``, which none on top precedes."""
        k = len(key)
        while self.heap and self.heap[0][:k] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:k] == key:
            head, number, run = heapq.heappop(self.runs)
            yield head
            self._next(run, number)


TOTALS = "conv_id long, depth long, parent_conv_id long, root boolean, n_children long, n_leaves long, saved_tokens long"


def time_forward(nodes: DataFrame) -> DataFrame:
    """Subtree totals of nodes that come in reverse level order within each partition.

    ``children, leaves, saved`` hold what nodes outside send. A ``root`` sends nothing inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Queue()
        for batch in batches:
            children, leaves, saved = [], [], []
            columns = [batch.column(c).to_pylist() for c in (
                "depth", "conv_id", "parent_conv_id", "root", "own", "children", "leaves", "saved")]
            for depth, conv, parent, root, own, child, leaf, below in zip(*columns):
                below += own
                for _, _, leaf_more, below_more in queue.pop_while((-depth, conv)):
                    child, leaf, below = child + 1, leaf + leaf_more, below + below_more
                leaf = leaf if child else 1
                if not root:
                    queue.push((1 - depth, parent, leaf, below))
                children.append(child)
                leaves.append(leaf)
                saved.append(below)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), batch.column("parent_conv_id"), batch.column("root"),
                 *(pa.array(c, pa.int64()) for c in (children, leaves, saved))],
                names=["conv_id", "depth", "parent_conv_id", "root", "n_children", "n_leaves", "saved_tokens"])

    return nodes.sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(run, TOTALS)


def digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the conversations that end at each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row(key, found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([found.hexdigest()])],
                names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
                if (k1, k2) == at:
                    digest.update(b",%d" % conv)
                    continue
                if at is not None:
                    yield row(at, digest)
                at, digest = (k1, k2), hashlib.sha256(b"%d" % conv)
        if at is not None:
            yield row(at, digest)

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(
        run, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    convs, prefixes = rebuilt(conversations)
    nodes = prefixes.groupBy("depth", *KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.max("bytes").alias("bytes"), F.max("length").alias("length"), F.sum(F.col("length") - F.col("depth") + 1).alias("rows"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("length").alias("length"),
                     F.sum(F.col("length") + 1).alias("rows")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", F.lit(None).cast("long").alias("p1"),
        F.lit(None).cast("long").alias("p2"), F.lit(0).alias("bytes"), "length", "rows")
    nodes = materialise(nodes.unionByName(root), "nodes")
    shared = nodes.where("n_convs > 1")
    found = nodes.where("depth = 0").first()
    first, most = (found["conv_id"], max(SHARD_ROWS, found["rows"] // TOP_SHARE)) if found else (None, SHARD_ROWS)

    # parents: that of a node below the first level is a shared one, or has the same single member
    parents = shared.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_parent"))
    deep = nodes.where("depth > 1").join(parents, ["p1", "p2"], "left").withColumn(
        "parent_conv_id", F.coalesce("_parent", "conv_id")).drop("_parent")
    flat = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first).cast("long")))
    nodes = materialise(deep.unionByName(flat.select(*deep.columns)), "nodes")
    shared = nodes.where("n_convs > 1")

    # shards: the first node on each conversation's way with few enough rows
    high = F.col("rows") > most
    top = broadcast_if_small(materialise(shared.where(high & (F.col("depth") > 0)).select("depth", *KEY), "top"))
    last = prefixes.join(top, ["depth", *KEY], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("_top"))
    heads = prefixes.join(broadcast_if_small(materialise(last, "last")), "conv_id", "left").where(
        F.col("depth") == F.coalesce("_top", zero) + 1).select("conv_id", F.col("k1").alias("shard"))
    counted = nodes.where("n_convs = 1 and depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("_tails"))
    counted = counted.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "_tails")
    tails = F.coalesce("_tails", zero)
    work = shared.join(counted, KEY, "left").join(heads, "conv_id", "left").select(
        "conv_id", "depth", "parent_conv_id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"),
        tails.alias("children"), tails.alias("leaves"), zero.alias("saved"), "shard", *KEY,
        (high | (F.col("depth") == 0)).alias("above"), (F.col("k1") == F.col("shard")).alias("root"))
    work = materialise(work, "work")
    below = materialise(time_forward(work.where("not above").repartition("shard")), "below")
    sent = below.where("root").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    above = work.where("above").join(sent, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "own", (F.col("depth") == 0).alias("root"),
        *[(F.col(c) + F.coalesce(m, zero)).alias(c) for c, m in (("children", "_c"), ("leaves", "_l"), ("saved", "_s"))])
    totals = below.unionByName(time_forward(above.repartition(1))).drop("parent_conv_id", "root")

    nothing = F.sha2(F.lit(""), 256)
    ended = prefixes.where("depth = length").select("conv_id", *KEY).unionByName(
        convs.where("length = 0").select("conv_id", zero.alias("k1"), zero.alias("k2")))
    ended = digests(ended.join(shared.select(*KEY), KEY, "left_semi"))
    many = shared.join(totals, ["conv_id", "depth"]).join(ended, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    one = nodes.where("n_convs = 1").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return many.unionByName(one)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = [op12_prefix_trie]
ORACLES: dict[str, str] = {}
