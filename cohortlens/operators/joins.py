"""Joins that notice lost or multiplied rows, and set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_loss(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left rows with no partner, and right keys that occur twice.

    Both must be zero for an inner join to return each left row exactly once.
    Looking at both means a lost row and a doubled row cannot cancel out.
    """
    lost = left.select(key).join(right.select(key), key, "left_anti")
    doubled = (right.groupBy(key).agg(F.count("*").alias("_n"))
               .where(F.col("_n") > 1))
    return left.agg(F.count("*").alias("n_left")).select(
        "n_left",
        lost.agg(F.count("*")).scalar().alias("n_lost"),
        doubled.agg(F.count("*")).scalar().alias("n_doubled_keys"))


def guarded_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises unless it keeps every left row exactly once."""
    found = join_loss(left, right, key).first()
    if found["n_lost"] or found["n_doubled_keys"]:
        raise ValueError(
            f"join on '{key}' would lose {found['n_lost']} of {found['n_left']} rows "
            f"and meets {found['n_doubled_keys']} repeated right keys")
    return left.join(right, key, "inner")


def with_lookup(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """Left outer join that brings in a few columns."""
    return left.join(right.select(key, *columns), key, "left")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no entry in ``done`` yet."""
    return todo.join(done.select(key), key, "left_anti")


def known_to(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(key), key, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return left.select(key).subtract(right.select(key))
