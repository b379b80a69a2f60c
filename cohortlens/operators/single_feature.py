"""A shallow decision tree on one feature, grown exactly from its distinct values.

A general learner bins a feature before it looks for cuts. With one feature no
bins are needed: rows are counted by value and class once, and running totals
over the values give the weighted Gini impurity of every possible cut. A level
is one pass over the counts, all of its nodes together. Null values and labels
take no part; ties go to the smallest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import POINTS, running_totals
from cohortlens.storage import materialise


def class_counts(df: DataFrame, value: str, label: str = "y") -> DataFrame:
    """``value, n_0, n_1``: rows of either class by distinct value."""
    return (df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(value).cast("double").alias("value"))
            .agg(F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1")))


def _leaf_of(value: Column, cuts: list[float]) -> Column:
    """How many of the few cuts lie below the value."""
    return sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _mixture(zero: Column, one: Column) -> Column:
    """Half the weight times the Gini impurity of a node with these class weights."""
    return zero * one / (zero + one)


def best_cuts(counts: DataFrame, cuts: list[float], weights: tuple[float, float],
              points: int = POINTS) -> list[float]:
    """The best cut of every node that holds both classes and two values, midway between values.

    At most one row a node comes to the driver.
    """
    placed = counts.withColumn("_node", _leaf_of(F.col("value"), cuts))
    totals = running_totals(placed, "value", ["n_0", "n_1"], ["_node"], points=points)
    left = [F.col(f"cum_n_{c}") * F.lit(weights[c]) for c in (0, 1)]
    right = [(F.col(f"total_n_{c}") - F.col(f"cum_n_{c}")) * F.lit(weights[c]) for c in (0, 1)]
    inner = totals.where((F.col("total_n_0") > 0) & (F.col("total_n_1") > 0)
                         & (F.col("cum_n_0") + F.col("cum_n_1") < F.col("total_n_0") + F.col("total_n_1")))
    best = inner.groupBy("_node").agg(
        F.min(F.struct((_mixture(*left) + _mixture(*right)).alias("cost"), "value"))["value"].alias("_below"))
    tops = {r["_node"]: r["_below"] for r in best.collect()}
    if not tops:
        return []
    below = F.create_map(*[F.lit(x) for kv in tops.items() for x in kv])[F.col("_node")]
    following = (placed.where(F.col("value") > below).groupBy("_node")
                 .agg(F.min("value").alias("_above")).collect())
    return [(tops[r["_node"]] + r["_above"]) / 2 for r in following]


def grow(df: DataFrame, value: str, label: str = "y", depth: int = 3, points: int = POINTS) -> DataFrame:
    """The leaves in order: ``leaf, low, high, n_0, n_1, score``; a leaf holds ``low < value <= high``.

    ``score`` is the share of class 1 with both classes weighed alike. A table without both classes
    stays one leaf, and an empty one has none.
    """
    counts = materialise(class_counts(df, value, label), "class-counts")
    sums = counts.agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1")).first()
    weights = tuple((sums["n_0"] + sums["n_1"]) / (2.0 * n) if n else 1.0 for n in (sums["n_0"], sums["n_1"]))
    cuts: list[float] = []
    for _ in range(depth):
        cuts = sorted(cuts + best_cuts(counts, cuts, weights, points))
    leaf = _leaf_of(F.col("value"), cuts)
    bounds = F.array(*[F.lit(c) for c in [None, *cuts, None]]).cast("array<double>")
    leaves = counts.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))
    one, zero = F.col("n_1") * F.lit(weights[1]), F.col("n_0") * F.lit(weights[0])
    return leaves.select("leaf", bounds[F.col("leaf")].alias("low"), bounds[F.col("leaf") + 1].alias("high"),
                         "n_0", "n_1", (one / (zero + one)).alias("score"))


def with_leaf_scores(df: DataFrame, leaves: DataFrame, value: str) -> DataFrame:
    """Add ``leaf``, ``score`` and ``predicted`` (1 above one half); a null value has none of them.

    ``leaves`` is what ``grow`` gives, two to the depth rows, and travels as one literal row.
    """
    table = leaves.agg(F.sort_array(F.collect_list(F.struct("leaf", "high", "score")))).scalar()
    x = F.col(value).cast("double")
    hit = F.filter("_leaves", lambda e: e["high"].isNull() | (x <= e["high"]))[0]
    return (df.withColumn("_leaves", table).withColumn("_hit", F.when(x.isNotNull(), hit))
            .select(*df.columns, F.col("_hit.leaf").alias("leaf"), F.col("_hit.score").alias("score"),
                    (F.col("_hit.score") > 0.5).cast("int").alias("predicted")))
