"""Metrics that follow from the four cells of a binary confusion matrix.

All take a prefix-free cell naming: ``tn, fp, fn, tp`` (actual 0/1 by rows,
predicted 0/1 by columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.rates import ratio


def _zero_if_undefined(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def precision(hit: Column, false_alarm: Column) -> Column:
    return _zero_if_undefined(hit, hit + false_alarm)


def recall(hit: Column, miss: Column) -> Column:
    return _zero_if_undefined(hit, hit + miss)


def f1(hit: Column, false_alarm: Column, miss: Column) -> Column:
    return _zero_if_undefined(2 * hit, 2 * hit + false_alarm + miss)


def macro_f1(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Mean F1 of the classes that occur in the truth or in the predictions."""
    has_0 = (tn + fp + fn > 0).cast("int")
    has_1 = (tp + fp + fn > 0).cast("int")
    return _zero_if_undefined(
        f1(tn, fn, fp) * has_0 + f1(tp, fp, fn) * has_1, has_0 + has_1)


def with_metrics(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    base = ratio(tp + fn, n)
    return cells.select(
        "*",
        ratio(tn + tp, n).alias("accuracy"),
        precision(tp, fp).alias("precision_1"),
        recall(tp, fn).alias("recall_1"),
        f1(tp, fp, fn).alias("f1_1"),
        precision(tn, fn).alias("precision_0"),
        recall(tn, fp).alias("recall_0"),
        f1(tn, fn, fp).alias("f1_0"),
        macro_f1(tn, fp, fn, tp).alias("f1_macro"),
        base.alias("baseline_accuracy"),
        (ratio(tn + tp, n) - base).alias("gain_over_baseline"),
    )
