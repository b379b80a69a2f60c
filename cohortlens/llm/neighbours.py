"""Approximate nearest neighbours by collision counting on single-projection sorted arrays.

Vectors are turned by one random rotation; every coordinate has its own sorted
array. A query opens a window around its own coordinate in each array and
widens all of them step by step (virtual rehashing: the arrays stay as they
are). A vector that lies in enough windows is verified with the true measure.
The search of a block of vectors ends when a share of the block is verified, or
earlier when no vector outside can be near enough: one at distance d lies
outside at most d^2 / w^2 of the windows of half width w.

Largest inner product becomes smallest distance by one more coordinate that
gives all vectors of a band of lengths the same length. All rows are indexed, in blocks whose size
has a bound; each block meets the stated queries, in chunks, and its best go on
to a merge. Equal vectors are searched once.

Defined cases: a vector that is null, zero, of another length than most, or
holds a null or non-finite component takes no part, nor does a row without an
id. Rows with the same id and vector count once; a query's own id is never its
neighbour. Ties go to the smaller id. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.tables import table
from cohortlens.storage import materialise


class Search(NamedTuple):
    """Share of windows that make a collision count, share of a block verified, first half width, growth."""
    threshold: float = 0.75
    verified: float = 0.25
    width: float = 0.15
    growth: float = 1.3
    seed: int = 11


BLOCK, LEAST_BLOCKS, SMALL_BLOCK, CHUNK = 65_536, 8, 2048, 4096
#: Vectors searched together differ in length by this factor at most; this many are compared outright.
BAND, FEW = 1.2, 256
#: Queries whose window ends are found at once.
TOGETHER = 256


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def widened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors divided by ``longest``, with a coordinate that makes each of length one."""
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(axis=1)))
    return np.column_stack([scaled, rest])


def block_search(vectors: np.ndarray, queries: np.ndarray, k: int, how: Search):
    """For each query, the places in ``vectors`` that were verified best, and their inner products.

    Vectors of unlike lengths are searched apart, as a few long ones would make all others look alike.
    """
    length = np.linalg.norm(vectors, axis=1)
    band = np.floor(np.log(length / length.min()) / math.log(BAND) + 1e-9).astype(int)
    parts = [np.flatnonzero(band == b) for b in np.unique(band)]
    found = [band_search(vectors[p], queries, k, length[p].max() * (1 + 1e-12), how) if len(p) > FEW
             else compare_all(vectors[p], queries) for p in parts]
    for of_query in zip(*found):
        places = np.concatenate([p[x] for p, (x, _) in zip(parts, of_query)])
        scores = np.concatenate([y for _, y in of_query])
        best = np.lexsort((places, -scores))[:k]
        yield places[best], scores[best]


def compare_all(vectors: np.ndarray, queries: np.ndarray):
    for q in queries:
        yield np.arange(len(vectors)), (vectors * q).sum(axis=1)


def band_search(vectors: np.ndarray, queries: np.ndarray, k: int, longest: float, how: Search):
    """The same for vectors none of which is longer than ``longest``."""
    n, m = len(vectors), vectors.shape[1] + 1
    turn = np.linalg.qr(np.random.default_rng(how.seed).standard_normal((m, m)))[0]
    spread = widened(vectors, longest) @ turn
    aimed = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    lengths = np.linalg.norm(queries, axis=1) * longest
    at = np.column_stack([aimed, np.zeros(len(queries))]) @ turn
    order = np.argsort(spread, axis=0, kind="stable").T.copy()
    ranked = np.take_along_axis(spread.T, order, axis=1)
    needed, enough = math.ceil(how.threshold * m), k + math.ceil(how.verified * n)
    # a unit rotation spreads a distance of one evenly over its coordinates
    widths, w = [], how.width * 8 / math.sqrt(m)
    while w < 2:
        widths.append(w)
        w *= how.growth
    widths.append(2.1)  # covers everything: coordinates lie between -1 and 1
    for q in range(len(queries)):
        if q % TOGETHER == 0:  # window ends of a few hundred queries at once, one step when it is first needed
            mine, ends = at[q:q + TOGETHER], []
        count = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        low = high = None
        for step, width in enumerate(widths):
            if step == len(ends):
                ends.append((np.stack([np.searchsorted(ranked[j], mine[:, j] - width) for j in range(m)], axis=1),
                             np.stack([np.searchsorted(ranked[j], mine[:, j] + width, side="right") for j in range(m)], axis=1)))
            new_low, new_high = (e[q % TOGETHER].tolist() for e in ends[step])
            if low is None:
                parts = [order[j, new_low[j]:new_high[j]] for j in range(m)]
            else:
                parts = [order[j, a:b] for j in range(m)
                         for a, b in ((new_low[j], low[j]), (high[j], new_high[j])) if b > a]
            low, high = new_low, new_high
            if parts:
                count += np.bincount(np.concatenate(parts), minlength=n)
            fresh = np.flatnonzero((count >= needed) & ~done)
            if len(fresh) > enough - len(places):  # those in most windows first
                fresh = fresh[np.argsort(-count[fresh], kind="stable")[:enough - len(places)]]
            if len(fresh):
                done[fresh] = True
                places = np.concatenate([places, fresh])
                scores = np.concatenate([scores, vectors[fresh] @ queries[q]])
            if len(places) >= min(enough, n):
                break
            if len(places) >= k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                if 2 - 2 * worst / lengths[q] <= (m - needed) * width ** 2:
                    break
        # equal products must come out equal, whatever stood beside them
        best = np.argsort(-scores, kind="stable")[:2 * k]
        places, scores = places[best], (vectors[places[best]] * queries[q]).sum(axis=1)
        best = np.lexsort((places, -scores))[:k]
        yield places[best], scores[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, how: Search = Search()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each query row.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("_v")))
    usual = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("_v") == usual["d"]).distinct()
    # a query needs k others: the k + 1 smallest ids of equal vectors are enough
    few = rows.withColumn("_r", F.row_number().over(W.partitionBy("_v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    groups = materialise(few.groupBy("_v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = groups.count()
    asked = materialise(rows.where(is_query).join(
        groups.select("_v", F.element_at("ids", 1).alias("rep")), "_v").select("vec_id", "rep", "_v"), "queries")
    reps = asked.groupBy("rep").agg(F.first("_v").alias("_v"))
    blocks = max(-(-n // BLOCK), min(LEAST_BLOCKS, -(-n // SMALL_BLOCK)))
    chunks = max(1, -(-asked.count() // CHUNK))

    def spot(key: str, kinds: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(kinds)).cast("int")

    data = groups.select(F.element_at("ids", 1).alias("rep"), "ids", "_v").select(
        "*", spot("rep", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    wanted = reps.select("*", spot("rep", chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> np.ndarray:
            return np.array(t.column("_v").combine_chunks().flatten()).reshape(t.num_rows, -1)

        out = {"rep": [], "ids": [], "scores": []}
        if left.num_rows and right.num_rows:
            first = np.argsort(left.column("rep").to_numpy(), kind="stable")  # places in the order of ids
            left = left.take(pa.array(first))
            ids = left.column("ids").to_pylist()
            for rep, (places, scores) in zip(right.column("rep").to_pylist(),
                                             block_search(matrix(left), matrix(right), k + 1, how)):
                pairs = sorted((-s, i) for p, s in zip(places, scores.tolist()) for i in ids[p])[:k + 1]
                out["rep"].append(rep)
                out["ids"].append([i for _, i in pairs])
                out["scores"].append([-s for s, _ in pairs])
        return pa.table(out, schema=pa.schema([("rep", pa.int64()), ("ids", pa.list_(pa.int64())),
                                               ("scores", pa.list_(pa.float64()))]))

    found = data.groupBy("block", "chunk").cogroup(wanted.groupBy("block", "chunk")).applyInArrow(
        search, "rep long, ids array<bigint>, scores array<double>")
    each = found.select("rep", F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("vec_id"))))
    best = each.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))) \
        .where(F.col("_r") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("_best"))
    others = F.slice(F.filter("_best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (asked.select(F.col("vec_id").alias("query_id"), "rep").distinct().join(lists, "rep")
            .select("query_id", F.posexplode(others).alias("_at", "_b"))
            .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.col("_b.score").alias("score")))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = [op4_nearest_neighbours]
ORACLES: dict[str, str] = {}
