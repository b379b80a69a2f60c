"""Pearson and Spearman matrices, kept long: ``method, a, b, r``."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators.ordering import average_ranks
from cohortlens.storage import BROADCAST_ROWS, scratch_path


PAIRS_PER_PASS = 15


def _matrix(df: DataFrame, columns: Sequence[str], method: str,
            values: DataFrame) -> DataFrame:
    """Every pair in one aggregate, unpivoted afterwards.

    More pairs than ``PAIRS_PER_PASS`` take several aggregates: a wider one
    would outgrow what the JVM compiles, and run an order of magnitude slower.
    The diagonal is 1 for each column of ``values`` that varies.
    """
    pairs = list(combinations(range(len(columns)), 2))
    blocks = [pairs[i:i + PAIRS_PER_PASS] for i in range(0, len(pairs), PAIRS_PER_PASS)]

    def cell(i: int, j: int, r: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), F.lit(columns[i]).alias("a"),
                        F.lit(columns[j]).alias("b"), F.lit(i).alias("a_idx"),
                        F.lit(j).alias("b_idx"), r.alias("r"))

    varies = values.agg(*[(F.min(c) < F.max(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    out = varies.select(F.inline(F.array(*[
        cell(i, i, F.when(F.col(f"_{i}"), 1.0)) for i in range(len(columns))])))
    for block in blocks:
        one_row = df.agg(*[F.corr(F.col(columns[i]).cast("double"),
                                  F.col(columns[j]).cast("double")).alias(f"_{i}_{j}")
                           for i, j in block])
        out = out.unionByName(one_row.select(F.inline(F.array(*[
            cell(x, y, F.col(f"_{i}_{j}")) for i, j in block for x, y in ((i, j), (j, i))]))))
    return out


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _matrix(df, columns, "pearson", df)


def with_average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its average ranks.

    The ranks of all columns are written once, one folder per column, with one
    row per distinct value. A column whose ranks are few is joined by
    broadcast; otherwise by shuffle, where adaptive execution splits a value
    that holds many rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranks")
    average_ranks(df, columns).write.partitionBy("column").parquet(path)
    stored = spark.read.schema("value double, rank double, column string").parquet(path)
    sizes = {r["column"]: r["count"] for r in stored.groupBy("column").count().collect()}
    ranked = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        ranks = stored.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"))
        if sizes.get(c, 0) <= BROADCAST_ROWS:
            ranks = F.broadcast(ranks)
        ranked = ranked.join(ranks, c).drop(c)
    return ranked.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson on average ranks, over the rows where all columns are present."""
    complete = df.select(*columns).dropna()
    return _matrix(with_average_ranks(complete, columns), columns, "spearman", complete)


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pearson_matrix(df, columns).unionByName(spearman_matrix(df, columns))


def strong_pairs(matrix: DataFrame, limit: float = K.STRONG_CORRELATION) -> DataFrame:
    """Pairs above the diagonal whose correlation exceeds the limit in size."""
    return (matrix.where((F.col("a_idx") < F.col("b_idx")) & (F.abs("r") > limit))
            .select("method", "a", "b", "r"))


def wide_matrix(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per method and row name, one column per variable."""
    return matrix.groupBy("method", "a_idx", F.col("a").alias("row")).pivot(
        "b", list(columns)).agg(F.first("r")).orderBy("method", "a_idx").drop("a_idx")
