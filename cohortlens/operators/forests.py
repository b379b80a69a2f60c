"""Random forests whose small nodes are finished where their rows lie.

MLlib passes over all rows once for every group of nodes that fits its memory, and every partition
sends the full counts of each such node, however few rows it has; deep trees have as many nodes as
rows. Here the same growth (Poisson bootstrap, drawn features, binned cuts, Gini, pruning of equal
leaves) is cut in two. Nodes with more than ``LOCAL`` rows are split by counts that all partitions
add up, one pass for a depth of all trees. The rows of every other node are shuffled together once
and its subtree is grown by one task, which so holds ``LOCAL`` rows at most. The result is stored as MLlib's own
model, or (``grow``) as a table of trees that meets the rows to score in tasks, so the driver holds
no nodes. Only draws differ from MLlib's learner, which takes them in the order in which its driver
visits the nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import trees as G
from cohortlens.storage import materialise, scratch_path

# workers get these functions by value: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a node (bootstrap copies counted) that one task may hold.
LOCAL = 200_000
#: MLlib's own passes are as quick up to so many rows, so its learner fits them.
FEW = 10_000
#: Rows that the cuts of the features are taken from, as in MLlib.
CUT_ROWS = 10_000
#: Trees that one task scores rows with.
TOGETHER = 10
#: Parameters that settings fitted together may differ in.
APART = {"maxDepth", "minInstancesPerNode", "featureSubsetStrategy"}

_TREE = "tree int, nodes long, importance array<double>, feature binary, cut binary, left binary, right binary, share binary"
_BLOCK = "unit int, node int, part int, seq int, bins binary, y binary, weight binary, bag binary"
_GROWN = ("unit int, node int, local int, feature int, threshold double, left int, right int, "
          "stats array<double>, n long, gain double")
_CUT = ("unit int, node int, feature int, cut int, gain double, stats array<double>, n double, "
        "left array<double>, n_left double")


def features_per_node(strategy: str, width: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))),
             "onethird": math.ceil(width / 3)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), width) if strategy.isdigit() else math.ceil(float(strategy) * width)


class GroupedForest(RandomForestClassifier):
    """MLlib's classifier with the growth above; ``FEW`` rows and settings that it does not know go to MLlib's."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        if not _known(self) or dataset.count() <= FEW:
            return super()._fit(dataset)
        return next(iter(self.fitMultiple(dataset, [{}])))[1]

    def grow(self, dataset: DataFrame) -> GrownForest:
        """The forest as a table of trees, by the growth above whatever the number of rows."""
        if not _known(self):
            raise ValueError("impurity, subsampling rate or bins that the growth does not know")
        nodes, _, cuts = grown(dataset, [self])
        trees = materialise(nodes.groupBy("treeID").applyInArrow(_packed(cuts), _TREE), "trees")
        return GrownForest(trees, cuts, self.getFeaturesCol())

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """One model a setting; settings that differ in ``APART`` only are grown in the same passes."""
        if not _known(self) or any(p.name not in APART for m in paramMaps for p in m) or dataset.count() <= FEW:
            return super().fitMultiple(dataset, paramMaps)
        settings = [self.copy(m) for m in paramMaps]
        nodes, classes, cuts = grown(dataset, settings)
        width = len(cuts)
        rows = [(Vectors.dense([0.0] * width), y, 1.0) for y in classes]

        def model(i: int) -> RandomForestClassificationModel:
            """MLlib's model of the setting (from a row for each class) with the grown nodes in place of its own."""
            one, spark = settings[i], dataset.sparkSession
            names = [one.getFeaturesCol(), one.getLabelCol()] + ([one.getWeightCol()] if one.isSet("weightCol") else ["_weight"])
            frame = RandomForestClassifier._fit(one, spark.createDataFrame(rows, names).coalesce(1))
            path = scratch_path(spark, "forest")
            frame.write().save(path)
            nodes.where(F.col("setting") == i).select("treeID", "nodeData").write.mode("overwrite").parquet(f"{path}/data")
            return RandomForestClassificationModel.load(path)

        return _FitMultipleIterator(model, len(settings))


class GrownForest:
    """A forest whose trees are rows of a stored table; its trees and the rows to score meet in tasks.

    Stored and loaded in the way of MLlib's models, so ``models.fit_or_load`` takes it.
    """

    def __init__(self, trees: DataFrame, cuts: list[np.ndarray], features: str):
        self.trees, self.cuts, self.features = trees, cuts, features

    def write(self) -> GrownForest:
        return self

    def overwrite(self) -> GrownForest:
        return self

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        cuts = [[float(c) for c in points] for points in self.cuts]
        self.trees.sparkSession.createDataFrame([(self.features, cuts)], "features string, cuts array<array<double>>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/metadata")  # the last: it tells that all is there

    @classmethod
    def load(cls, path: str) -> GrownForest:
        spark = SparkSession.active()
        known = spark.read.parquet(f"{path}/metadata").first()
        return cls(spark.read.parquet(f"{path}/trees"), [np.array(c, float) for c in known["cuts"]], known["features"])

    @property
    def totalNumNodes(self) -> int:
        return self.trees.agg(F.sum("nodes")).first()[0]

    @property
    def featureImportances(self) -> DenseVector:
        """Each tree's gains, weighted by rows, add up to one; then the trees' are added up, to one again."""
        each = self.trees.orderBy("tree").select("importance").toArrow().column("importance")  # a row a tree
        total = sum(np.array(v) for v in each.to_pylist())
        return DenseVector(total / total.sum() if total.sum() else total)

    def with_scores(self, df: DataFrame, score: str, predicted: str) -> DataFrame:
        """The rows without their vector, with the probability of class 1 and the decision.

        Rows are stored as bins and dealt in slices of ``LOCAL`` rows; a slice meets ``TOGETHER`` trees in a task, whose
        votes are then added up in the trees' order.
        """
        cuts, width, own = self.cuts, len(self.cuts), [c for c in df.columns if c != self.features]
        kind = _kind(cuts)

        def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = G.binned(_matrix(batch.column("_v"), width), cuts) if batch.num_rows else ()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in bins], pa.binary())],
                                                 names=[*own, "_bins"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slice_, row = batch.column("_slice").to_numpy(), batch.column("_row").to_numpy()
                bins = np.frombuffer(b"".join(batch.column("_bins").to_pylist()), kind).reshape(-1, width)
                for k in np.unique(slice_).tolist():
                    mine = slice_ == k
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row[mine].tobytes()], pa.binary()),
                                                      pa.array([bins[mine].tobytes()], pa.binary())], names=["slice", "row", "bins"])

        def vote(key: tuple[pa.Scalar, ...], trees: pa.Table, rows: pa.Table) -> pa.Table:
            row, bins = _joined(rows, "row", np.int64), _joined(rows, "bins", kind).reshape(-1, width)
            order = np.argsort(row)
            row, bins, votes = row[order], bins[order], 0.0
            for tree in trees.sort_by("tree").to_pylist():
                top = {c: np.frombuffer(tree[c], np.int32) for c in ("feature", "cut", "left", "right")}
                share = np.frombuffer(tree["share"]).reshape(len(top["cut"]), -1)
                votes = votes + share[G.routed(bins, top)]
            some = [[key[0].as_py()], [key[1].as_py()], [row.tobytes()], [votes.tobytes()]] if len(row) else [[]] * 4
            return pa.table([pa.array(v, k) for v, k in zip(some, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])],
                            names=["some", "slice", "row", "votes"])

        def decide(group: pa.Table) -> pa.Table:
            group = group.sort_by("some")
            row = np.frombuffer(group.column("row")[0].as_py(), np.int64)
            votes = sum(np.frombuffer(v.as_py()).reshape(len(row), -1) for v in group.column("votes"))
            total = votes.sum(1)
            return pa.table([pa.array(row), pa.array(np.divide(votes[:, 1], total, out=np.zeros(len(row)), where=total > 0)),
                             pa.array(votes.argmax(1), pa.int32())], names=["_row", score, predicted])

        binned = df.select(*own, vector_to_array(self.features).alias("_v"))
        schema = T.StructType([*binned.schema.fields[:-1], T.StructField("_bins", T.BinaryType())])
        stored = materialise(binned.mapInArrow(bin_, schema).withColumn("_row", F.monotonically_increasing_id()), "binned")
        slices, groups = max(1, -(-stored.count() // LOCAL)), -(-self.trees.count() // TOGETHER)
        blocks = stored.select("_bins", "_row", (F.col("_row") % slices).cast("int").alias("_slice")).mapInArrow(
            pack, "slice int, row binary, bins binary").select("*", _each(groups, "some"))
        trees = self.trees.select("*", (F.col("tree") / TOGETHER).cast("int").alias("some"), _each(slices, "slice"))
        votes = trees.groupBy("some", "slice").cogroup(blocks.groupBy("some", "slice")).applyInArrow(
            vote, "some int, slice int, row binary, votes binary")
        said = votes.groupBy("slice").applyInArrow(decide, T.StructType([
            T.StructField("_row", T.LongType()), T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))
        return stored.drop("_bins").join(said, "_row").drop("_row")


def _each(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def _kind(cuts: list[np.ndarray]) -> type:
    """Of a bin's number."""
    return np.uint8 if max(map(len, cuts)) < 256 else np.uint16


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _packed(cuts: list[np.ndarray]):
    """One row of a tree's nodes, in the order of their ids, with each leaf's shares of the classes."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        node = group.column("nodeData").combine_chunks()
        order = np.argsort(node.field("id").to_numpy())
        number = {c: node.field(f).to_numpy()[order] for c, f in (("left", "leftChild"), ("right", "rightChild"), ("gain", "gain"))}
        split = node.field("split")
        feature = split.field("featureIndex").to_numpy()[order]
        threshold = np.full(len(order), np.nan)
        ends = split.field("leftCategoriesOrThreshold")
        threshold[split.field("featureIndex").to_numpy() >= 0] = ends.flatten().to_numpy()  # a leaf has none
        threshold, cut = threshold[order], np.full(len(order), -1)
        for f in np.unique(feature[feature >= 0]):
            cut[feature == f] = np.searchsorted(cuts[f], threshold[feature == f])
        stats = node.field("impurityStats").flatten().to_numpy().reshape(len(order), -1)[order]
        whole = stats.sum(1)
        inner = feature >= 0
        gains = np.bincount(feature[inner], (number["gain"] * whole)[inner], len(cuts))
        gains = gains / gains.sum() if gains.sum() else gains
        share = np.divide(stats, whole[:, None], out=np.zeros_like(stats), where=whole[:, None] > 0)
        few = [feature, cut, number["left"], number["right"]]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(order)], pa.int64()), pa.array([gains.tolist()])]
                        + [pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in few]
                        + [pa.array([share.tobytes()], pa.binary())],
                        names=["tree", "nodes", "importance", "feature", "cut", "left", "right", "share"])

    return pack


def _known(est: RandomForestClassifier) -> bool:
    return est.getImpurity() == "gini" and est.getSubsamplingRate() == 1.0 and est.getMaxBins() <= 1 << 16


def grown(dataset: DataFrame, settings: list[GroupedForest]) -> tuple[DataFrame, list[float], list[np.ndarray]]:
    """The stored nodes of all settings' trees as MLlib keeps them, the classes, and the cuts of every feature."""
    one, spark = settings[0], dataset.sparkSession
    trees, seed = one.getNumTrees(), one.getSeed()
    weight = F.col(one.getWeightCol()).cast("double") if one.isSet("weightCol") else F.lit(1.0)
    rows = dataset.select(vector_to_array(one.getFeaturesCol()).alias("v"), F.col(one.getLabelCol()).cast("double").alias("y"),
                          weight.alias("w"))
    seen = (rows.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.xxhash64("v", "_at"), "_at")
            .limit(CUT_ROWS).select("v", "w").toArrow())  # CUT_ROWS rows at most
    if not seen.num_rows:
        raise ValueError("no rows to fit")
    width = len(seen.column("v")[0])
    sample = _matrix(seen.column("v").combine_chunks(), width)
    cuts = [G.cut_points(sample[:, j], seen.column("w").to_numpy(), one.getMaxBins()) for j in range(width)]
    stored = materialise(_bagged(rows, cuts, trees, seed, trees > 1 and one.getBootstrap()), "bagged")
    facts = stored.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.collect_set("y").alias("y"),
                       F.count_if(F.col("y").isNull() | F.col("w").isNull() | ~(F.col("w") >= 0)).alias("odd")).first()
    classes = sorted(facts["y"])
    if facts["odd"] or classes[0] < 0 or any(y != int(y) for y in classes):
        raise ValueError("a class must be a whole number from 0, a weight must not be null or negative")
    rules = [G.Rules(s.getMaxDepth(), s.getMinInstancesPerNode(), features_per_node(s.getFeatureSubsetStrategy(), width, trees),
                     s.getMinInfoGain(), s.getMinWeightFractionPerNode() * facts["w"], max(map(len, cuts)) + 1,
                     max(int(classes[-1]) + 1, 2), seed) for s in settings]
    tops = _tops(stored, facts["n"], rules, trees, width)
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
    groups = sum(int(t["open"].sum()) for t in tops)
    blocks = stored.mapInArrow(_dealt(tops, trees, width, kind), _BLOCK)
    tasks = max(1, min(groups, 8 * spark.sparkContext.defaultParallelism))
    below = materialise(blocks.repartition(tasks, "unit", "node").groupBy("unit", "node").applyInArrow(
        _finished(tops, rules, trees, width, kind, cuts), _GROWN), "grown")
    return materialise(_numbered(below, tops, cuts, trees), "nodes"), classes, cuts


def held_out_scores(dataset: DataFrame, held: DataFrame, settings: list[GroupedForest]) -> DataFrame:
    """``setting``, ``y`` and ``score`` (probability of class 1) of the ``held`` rows under a forest of each setting.

    The forests are grown on ``dataset`` in the same passes (so the settings differ in ``APART`` only) and no model
    of MLlib's is built of them: the trees of a setting meet the rows, ``LOCAL`` at a time, in one task.
    """
    nodes, _, cuts = grown(dataset, settings)
    one, width = settings[0], len(cuts)
    slices = max(1, -(-held.count() // LOCAL))
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = G.binned(_matrix(batch.column("v"), width), cuts), batch.column("y").to_numpy(zero_copy_only=False)
            slice_ = batch.column("slice").to_numpy()
            for k in np.unique(slice_).tolist():
                mine = slice_ == k
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bins[mine].tobytes()], pa.binary()),
                                                  pa.array([y[mine].tobytes()], pa.binary())], names=["slice", "bins", "y"])

    def score(key: tuple[pa.Scalar, ...], trees: pa.Table, rows: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), kind).reshape(-1, width)
        y = np.frombuffer(b"".join(rows.column("y").to_pylist()))
        tree, id_, feature, threshold, left, right, says, share = (c.to_numpy() for c in trees.sort_by(
            [("tree", "ascending"), ("id", "ascending")]).columns[2:])
        ends = np.flatnonzero(np.r_[id_ == 0, True])
        total, votes = np.zeros(len(y)), np.zeros(len(y))
        for a, b in zip(ends, ends[1:]):  # ids count up from 0 in each tree
            cut = np.array([np.searchsorted(cuts[f], t) if f >= 0 else -1 for f, t in zip(feature[a:b], threshold[a:b])])
            at = a + G.routed(bins, {"feature": feature[a:b], "cut": cut, "left": left[a:b], "right": right[a:b]})
            total += share[at]
            votes += says[at]
        value = np.divide(total, votes, out=np.zeros(len(y)), where=votes > 0)
        return pa.table([pa.array(np.full(len(y), key[0].as_py()), pa.int32()), pa.array(y, from_pandas=True), pa.array(value)],
                        names=["setting", "y", "score"])

    rows = held.select(vector_to_array(one.getFeaturesCol()).alias("v"), F.col(one.getLabelCol()).cast("double").alias("y"),
                       (F.monotonically_increasing_id() % slices).cast("int").alias("slice"))
    blocks = rows.mapInArrow(pack, "slice int, bins binary, y binary").select(
        F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("setting"), "*")
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    whole = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    each = nodes.select(
        "setting", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("treeID").alias("tree"), node["id"].alias("id"),
        node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)), F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), (whole > 0).cast("double").alias("says"),
        F.when(whole > 0, stats[1] / whole).otherwise(0.0).alias("share"))
    return each.groupBy("setting", "slice").cogroup(blocks.groupBy("setting", "slice")).applyInArrow(
        score, "setting int, y double, score double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(values) != len(column) * width:
        raise ValueError("vectors must have the same number of features")
    return values.reshape(-1, width)


def _bagged(rows: DataFrame, cuts: list[np.ndarray], trees: int, seed: int, bootstrap: bool) -> DataFrame:
    """Every row's bins and how often each tree draws it; draws follow the rows' order in their partition."""
    width = len(cuts)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed & (1 << 63) - 1, TaskContext.get().partitionId()])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = G.binned(_matrix(batch.column("v"), width), cuts)
            times = np.minimum(rng.poisson(1.0, (n, trees)), 255).astype(np.uint8) if bootstrap else np.ones((n, trees), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"), batch.column("w"),
                 pa.array([r.tobytes() for r in times], pa.binary())], names=["bins", "y", "w", "bag"])

    return rows.mapInArrow(bag, "bins binary, y double, w double, bag binary")


def _read(batch: pa.RecordBatch, width: int, trees: int, kind: type) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), kind).reshape(-1, width)
    bag = np.frombuffer(b"".join(batch.column("bag").to_pylist()), np.uint8).reshape(-1, trees)
    return bins, batch.column("y").to_numpy().astype(np.int64), batch.column("w").to_numpy(), bag


def _tops(stored: DataFrame, n: int, rules: list[G.Rules], trees: int, width: int) -> list[dict[str, np.ndarray]]:
    """The upper part of every tree: nodes of more than ``LOCAL`` rows and the nodes below them.

    ``open`` nodes are for one task to finish. One pass over the rows splits a depth of all trees.
    """
    tops = [{"feature": np.array([-1]), "cut": np.array([-1]), "left": np.array([-1]), "right": np.array([-1]),
             "stats": np.zeros((1, rules[0].classes)), "n": np.array([float(n)]), "gain": np.array([-1.0]),
             "open": np.array([True]), "level": np.array([0]),
             "path": np.array([G.root_path(u % trees, rules[0].seed)], np.uint64)} for u in range(len(rules) * trees)]
    big = {u: [0] for u in range(len(tops))} if 2 * n > LOCAL else {}  # a bootstrap has some n rows, counted in the pass
    while big:
        found = _split(stored, tops, big, rules, trees, width)
        big = {}
        for r in found:  # as many as nodes of this depth with more than LOCAL rows
            u, at = r["unit"], r["node"]
            top, rule = tops[u], rules[u // trees]
            top["stats"][at], top["n"][at] = r["stats"], r["n"]
            if r["n"] <= LOCAL:
                continue
            top["open"][at] = False
            if r["gain"] <= 0:
                continue
            first, level = len(top["n"]), int(top["level"][at]) + 1
            top["feature"][at], top["cut"][at], top["gain"][at] = r["feature"], r["cut"], r["gain"]
            top["left"][at], top["right"][at] = first, first + 1
            left = np.array(r["left"])
            stats = np.stack([left, np.maximum(top["stats"][at] - left, 0)])
            sizes = np.array([r["n_left"], r["n"] - r["n_left"]])
            ends = (level >= rule.depth) | (G.impurity(stats) <= G.PURE)
            new = {"feature": [-1, -1], "cut": [-1, -1], "left": [-1, -1], "right": [-1, -1], "stats": stats, "n": sizes,
                   "gain": [-1.0, -1.0], "open": ~ends, "level": [level, level],
                   "path": G.child_paths(top["path"][at:at + 1])[0]}
            for c, v in new.items():
                top[c] = np.concatenate([top[c], np.asarray(v, top[c].dtype)])
            more = [first + k for k in range(2) if sizes[k] > LOCAL and not ends[k]]
            if more:
                big.setdefault(u, []).extend(more)
    return tops


def _split(stored: DataFrame, tops: list[dict], big: dict[int, list[int]], rules: list[G.Rules], trees: int, width: int) -> list:
    """The best cut of every node in ``big``, by counts that the partitions add up."""
    kind = np.uint8 if rules[0].bins <= 256 else np.uint16
    shared = stored.sparkSession.sparkContext.broadcast({u: tops[u] for u in big})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            bins, y, w, bag = _read(batch, width, trees, kind)
            for u, nodes in big.items():
                rows = np.flatnonzero(bag[:, u % trees])
                node = G.routed(bins[rows], shared.value[u])
                for at in nodes:
                    mine = rows[node == at]
                    features = G.drawn(shared.value[u]["path"][at:at + 1], width, rules[u // trees].features)
                    times = bag[mine, u % trees].astype(float)
                    here = G.tallies(bins[mine], y[mine], w[mine] * times, times, np.zeros(len(mine), np.int64),
                                     features, rules[u // trees])
                    old = found.setdefault((u, at), [np.zeros_like(x) for x in here])
                    for a, b in zip(old, here):
                        a += b
        part = TaskContext.get().partitionId()
        for (u, at), (weights, counts) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([at], pa.int32()), pa.array([part], pa.int32()),
                                              pa.array([weights.tobytes()]), pa.array([counts.tobytes()])],
                                             names=["unit", "node", "part", "weights", "counts"])

    def choose(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        u, at = (k.as_py() for k in key)
        rule = rules[u // trees]
        group = group.sort_by("part")  # sums of fractions depend on their order
        shape = (1, min(rule.features, width), rule.bins, rule.classes)
        weights = sum(np.frombuffer(b) for b in group.column("weights").to_pylist()).reshape(shape)
        counts = sum(np.frombuffer(b) for b in group.column("counts").to_pylist()).reshape(shape[:3])
        j, cut, gain, left, n_left = G.best_cuts(weights, counts, rule)
        features = G.drawn(shared.value[u]["path"][at:at + 1], width, rule.features)
        return pa.Table.from_pylist([{
            "unit": u, "node": at, "feature": int(features[0, j[0]]), "cut": int(cut[0]), "gain": float(gain[0]),
            "stats": weights[0, 0].sum(0).tolist(), "n": float(counts[0, 0].sum()), "left": left[0].tolist(),
            "n_left": float(n_left[0])}], schema=_schema_of_cut())

    def _schema_of_cut() -> pa.Schema:
        many = pa.list_(pa.float64())
        return pa.schema([("unit", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
                          ("gain", pa.float64()), ("stats", many), ("n", pa.float64()), ("left", many), ("n_left", pa.float64())])

    counts = stored.mapInArrow(count, "unit int, node int, part int, weights binary, counts binary")
    return counts.groupBy("unit", "node").applyInArrow(choose, _CUT).orderBy("unit", "node").collect()


def _dealt(tops: list[dict], trees: int, width: int, kind: type):
    """Sends the rows of every open node off in blocks, one for each batch of rows."""
    # a tree without an upper part has the root alone
    upper = {u: {c: t[c] for c in ("feature", "cut", "left", "right")} for u, t in enumerate(tops) if len(t["n"]) > 1}
    shut = {u: set(np.flatnonzero(~t["open"]).tolist()) for u, t in enumerate(tops)}
    units = len(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            bins, y, w, bag = _read(batch, width, trees, kind)
            y = y.astype(np.uint8)
            for u in range(units):
                rows = np.flatnonzero(bag[:, u % trees])
                node = G.routed(bins[rows], upper[u]) if u in upper else np.zeros(len(rows), np.int64)
                order = np.argsort(node, kind="stable")
                rows, node = rows[order], node[order]
                out = []
                for at in np.unique(node).tolist():
                    if at in shut[u]:
                        continue
                    mine = rows[slice(*np.searchsorted(node, [at, at + 1]))]
                    out.append((u, at, part, seq, bins[mine].tobytes(), y[mine].tobytes(), w[mine].tobytes(),
                                bag[mine, u % trees].tobytes()))
                if out:
                    kinds = [pa.int32()] * 4 + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                     names=["unit", "node", "part", "seq", "bins", "y", "weight", "bag"])

    return deal


def _finished(tops: list[dict], rules: list[G.Rules], trees: int, width: int, kind: type, cuts: list[np.ndarray]):
    """Grows the subtree of one open node from its rows."""
    starts = {(u, int(at)): (int(t["path"][at]), int(t["level"][at])) for u, t in enumerate(tops) for at in np.flatnonzero(t["open"])}

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        u, at = (k.as_py() for k in key)
        group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
        bins, y, weight, bag = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (
            ("bins", kind), ("y", np.uint8), ("weight", np.float64), ("bag", np.uint8)))
        times = bag.astype(float)
        path, level = starts[u, at]
        tree = G.grow(bins.reshape(-1, width), y.astype(np.int64), weight * times, times, path, level, rules[u // trees])
        size = len(tree["n"])
        threshold = np.array([cuts[f][c] if f >= 0 else np.nan for f, c in zip(tree["feature"], tree["cut"])])
        stats = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * tree["stats"].shape[1], pa.int32()),
                                         pa.array(tree["stats"].ravel()))
        number = [pa.array(np.full(size, u), pa.int32()), pa.array(np.full(size, at), pa.int32()), pa.array(np.arange(size), pa.int32())]
        return pa.table(number + [pa.array(tree["feature"], pa.int32()), pa.array(threshold), pa.array(tree["left"], pa.int32()),
                                  pa.array(tree["right"], pa.int32()), stats, pa.array(tree["n"]), pa.array(tree["gain"])],
                        names=["unit", "node", "local", "feature", "threshold", "left", "right", "stats", "n", "gain"])

    return finish


def _numbered(below: DataFrame, tops: list[dict], cuts: list[np.ndarray], trees: int) -> DataFrame:
    """Nodes in MLlib's layout, numbered from 0 in their tree, parents first.

    A node of the upper part keeps its number among those that pruning leaves; each subtree's other nodes follow.
    """
    spark = below.sparkSession
    ends = below.groupBy("unit", "node").agg(  # a row for each subtree: rows times trees / LOCAL, or as many as trees
        F.max("local").alias("more"), F.max(F.when(F.col("local") == 0, F.struct("feature", "stats"))).alias("root")).collect()
    sizes = {(r["unit"], r["node"]): r for r in ends}
    places, upper = [], []
    for u, top in enumerate(tops):
        feature, n = top["feature"].copy(), len(top["n"])
        stats = [sizes[u, i]["root"]["stats"] if (u, i) in sizes else top["stats"][i].tolist() for i in range(n)]
        leaf = [(u, i) not in sizes and feature[i] < 0 or (u, i) in sizes and sizes[u, i]["root"]["feature"] < 0 for i in range(n)]
        for i in range(n - 1, -1, -1):
            a, b = top["left"][i], top["right"][i]
            if feature[i] >= 0 and leaf[a] and leaf[b] and np.argmax(stats[a]) == np.argmax(stats[b]):
                leaf[i], feature[i] = True, -1
        kept = [0]
        for i in kept:
            if feature[i] >= 0:
                kept += [int(top["left"][i]), int(top["right"][i])]
        number, base = {i: k for k, i in enumerate(kept)}, len(kept)
        for i in kept:
            if (u, i) in sizes and feature[i] < 0 and top["feature"][i] < 0:
                places.append((u, i, number[i], base))
                base += sizes[u, i]["more"]
            else:
                cut = feature[i] >= 0
                upper.append((u, number[i], int(feature[i]), float(cuts[feature[i]][top["cut"][i]]) if cut else None,
                              number[int(top["left"][i])] if cut else -1, number[int(top["right"][i])] if cut else -1,
                              [float(s) for s in stats[i]], int(top["n"][i]), float(top["gain"][i]) if cut else -1.0))
    start = spark.createDataFrame(places, "unit int, node int, top int, base int")
    moved = lambda c: F.when(F.col(c) > 0, F.col("base") + F.col(c) - 1).otherwise(-1).alias(c)
    nodes = below.join(F.broadcast(start), ["unit", "node"]).select(
        "unit", F.when(F.col("local") == 0, F.col("top")).otherwise(F.col("base") + F.col("local") - 1).alias("id"),
        "feature", "threshold", moved("left"), moved("right"), "stats", "n", "gain")
    if upper:
        nodes = nodes.unionByName(spark.createDataFrame(
            upper, "unit int, id int, feature int, threshold double, left int, right int, stats array<double>, n long, gain double"))
    total = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    gini = F.when(total > 0, 1 - F.aggregate("stats", F.lit(0.0), lambda a, x: a + (x / total) * (x / total))).otherwise(0.0)
    none = F.array().cast("array<double>")
    return nodes.select((F.col("unit") / trees).cast("int").alias("setting"), (F.col("unit") % trees).alias("treeID"), F.struct(
        F.col("id"), (F.array_position("stats", F.array_max("stats")) - 1).cast("double").alias("prediction"),
        F.greatest(gini, F.lit(0.0)).alias("impurity"), F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(none)
                 .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData"))
