"""Composition reports: frequencies, cross-tabulations, describes, densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.rates import percent, ratio
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.storage import broadcast_if_small, materialise


def frequency_table(df: DataFrame, column: str, digits: int = 2,
                    keep_null: bool = False) -> DataFrame:
    """``column, n, pct``; the percentage is of all rows, nulls included.

    The total is a count of rows, which on a stored table reads no column.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    table = counts.withColumn("pct", percent(F.col("n"), total, digits))
    return table if keep_null else table.where(F.col(column).isNotNull())


def imbalance_summary(df: DataFrame, label: str, minority, majority) -> DataFrame:
    """One row: total, both class counts and percents, majority per minority."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == minority).alias("n_minority"),
        F.count_if(F.col(label) == majority).alias("n_majority"))
    both = (F.col("n_minority") > 0) & (F.col("n_majority") > 0)
    return counts.select(
        "*",
        percent("n_minority", "total").alias("pct_minority"),
        percent("n_majority", "total").alias("pct_majority"),
        F.when(both, F.round(ratio("n_majority", "n_minority"), 4)).alias("ratio"))


def crosstab_long(df: DataFrame, row: str, col: str, margin: str = "All") -> DataFrame:
    """Every cell, row margin, column margin and the grand total, one per row.

    Rows are first counted by both keys, so the cube expands counts, not rows.
    """
    pairs = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(row, col).agg(F.count("*").alias("_n")))
    cube = pairs.cube(row, col).agg(F.sum("_n").alias("n"),
                                    F.grouping(row).alias("_g_row"),
                                    F.grouping(col).alias("_g_col"))

    def named(key: str, grouped: str) -> Column:
        return F.when(F.col(grouped) == 1, F.lit(margin)).otherwise(
            F.col(key).cast("string")).alias(key)

    return cube.select(named(row, "_g_row"), named(col, "_g_col"), "n")


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence,
                  margin: str | None = "All") -> DataFrame:
    """One row per ``row`` key, one count column per listed ``col`` value.

    With ``margin``, a total column and a total row of that name are added.
    """
    pairs = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(row, col).agg(F.count("*").alias("_n")))
    cells = [F.coalesce(F.sum(F.when(F.col(col) == v, F.col("_n"))), F.lit(0))
             .alias(str(v)) for v in values]
    if margin is None:
        return pairs.groupBy(row).agg(*cells)
    table = pairs.rollup(row).agg(*cells, F.sum("_n").alias(margin),
                                  F.grouping(row).alias("_g"))
    key = F.when(F.col("_g") == 1, F.lit(margin)).otherwise(F.col(row).cast("string"))
    return table.select(key.alias(row), *[str(v) for v in values], margin)


def describe(df: DataFrame, value: str, by: Sequence[str] = (),
             fractions: Sequence[float] = (0.25, 0.5, 0.75),
             digits: int | None = 4, approximate: bool = False) -> DataFrame:
    """Count, mean, sample std, min, quantiles and max, per group or overall.

    Null and NaN values do not count. Quantiles are exact by default;
    ``approximate`` swaps them for a sketch in the same single pass.
    """
    by = list(by)
    names = [f"p{round(100 * p):02d}" for p in fractions]
    valid = df
    for key in (*by, value):
        valid = valid.where(F.col(key).isNotNull())
    if df.schema[value].dataType.typeName() in ("double", "float"):
        valid = valid.where(~F.isnan(value))
    sketch = ([F.percentile_approx(value, list(map(float, fractions)), 10000)
               .alias("quantiles")] if approximate else [])
    base = valid.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), *sketch)
    if not approximate:
        cuts = exact_quantiles(valid, value, fractions, by)
        base = (base.join(cuts, by) if by
                else base.withColumn("quantiles", cuts.scalar()))

    def shown(column: Column, name: str) -> Column:
        column = column.cast("double")
        return (column if digits is None else F.round(column, digits)).alias(name)

    return base.select(
        *by, "count", shown(F.col("mean"), "mean"), shown(F.col("std"), "std"),
        shown(F.col("min"), "min"),
        *[shown(F.col("quantiles")[i], n) for i, n in enumerate(names)],
        shown(F.col("max"), "max"))


def mean_and_median(df: DataFrame, value: str, condition: Column | None = None) -> DataFrame:
    """Count, mean and median of the rows that meet ``condition``."""
    rows = df if condition is None else df.where(condition)
    return describe(rows, value, fractions=(0.5,), digits=None).select(
        "count", "mean", F.col("p50").alias("median"))


def mutual_implication(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Whether two predicates hold for exactly the same rows, with the counts."""
    left, right = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    return df.agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        F.count_if(left & right).alias("n_both"),
        F.coalesce(F.bool_and(~left | right), F.lit(True)).alias("left_implies_right"),
        F.coalesce(F.bool_and(~right | left), F.lit(True)).alias("right_implies_left"),
        F.coalesce(F.bool_and(left == right), F.lit(True)).alias("equivalent"))


def membership_summary(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """How many rows hold one of ``values``, and what percent that is."""
    inside = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(inside).alias("n"),
                  F.round(100 * F.avg(inside.cast("int")), 2).alias("pct"))


def density_histogram(df: DataFrame, value: str, by: str,
                      bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width density per class over the class's own range.

    Every bin of a class is present, empty ones with count 0. A class with a
    single value gets a range of one unit centred on it.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    spans = rows.groupBy(by).agg(
        F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"),
        F.count("*").alias("_n"))
    flat = F.col("_lo") == F.col("_hi")
    spans = spans.select(
        by, "_n", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    spans = materialise(spans, "spans")
    counts = (rows.select(by, value).join(broadcast_if_small(spans), by)
              .withColumn("bin", F.least(F.width_bucket(
                  F.col(value).cast("double"), F.col("_lo"), F.col("_hi"), F.lit(bins)),
                  F.lit(bins)).cast("int"))
              .groupBy(by, "bin").agg(F.count("*").alias("n")))
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, [by, "bin"], "left").select(
        by, "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("_n") * width)).alias("density"))


def top_k(df: DataFrame, column: Column | str, k: int = 10, name: str = "value") -> DataFrame:
    """The most common values with count and share of all rows."""
    col = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(col.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.withColumn("pct", percent(F.col("n"), total))
            .orderBy(F.desc("n"), F.asc(name)).limit(k))


def in_report_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Sort by a fixed order of keys; unknown keys follow, alphabetically."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(key))
    known = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    return df.withColumn("ordinal", known.cast("int")).orderBy("ordinal", key)
