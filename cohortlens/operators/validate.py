"""Checks on loaded tables: as reports (lazy) and as guards (they raise)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K

#: Values that a guard's message names.
SHOWN = 20


def id_report(df: DataFrame, column: str, pattern: str = K.ID_PATTERN) -> DataFrame:
    """One row: rows, ids that miss the pattern (null ids miss it), verdict."""
    fits = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(~fits).alias("n_bad"),
                  F.coalesce(F.bool_and(fits), F.lit(True)).alias("all_match"))


def unexpected_values(df: DataFrame, column: str, domain: Sequence[str],
                      ignore_case: bool = True) -> DataFrame:
    """Distinct values outside the domain; empty when the column is clean."""
    value = F.lower(column) if ignore_case else F.col(column)
    return (df.select(value.alias("value")).distinct()
            .where(~F.coalesce(F.col("value").isin(list(domain)), F.lit(False))))


def is_subset(left: DataFrame, right: DataFrame) -> bool:
    return left.subtract(right).isEmpty()


def require_ids(df: DataFrame, column: str, pattern: str = K.ID_PATTERN) -> DataFrame:
    found = id_report(df, column, pattern).first()
    if not found["all_match"]:
        raise ValueError(
            f"{found['n_bad']} of {found['n']} values of '{column}' do not match "
            f"{pattern}; preview the raw file to check its columns")
    return df


def require_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    found = unexpected_values(df, column, domain)
    extra = [r["value"] for r in found.orderBy("value").take(SHOWN)]
    if extra:
        total = len(extra) if len(extra) < SHOWN else found.count()
        first = f", the first {SHOWN} of them" if total > SHOWN else ""
        raise ValueError(f"{total} unexpected values in '{column}'{first}: {extra}")
    return df


def require_proportions(parts: Sequence[tuple[str, float]]) -> None:
    if any(p < 0 for _, p in parts):
        raise ValueError("proportions must not be negative")
    total = sum(p for _, p in parts)
    if abs(total - 1.0) >= K.SPLIT_TOLERANCE:
        raise ValueError(f"proportions must add up to 1, got {total}")
