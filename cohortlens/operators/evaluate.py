"""Evaluation of scored rows: confusion cells, curves, error rates, sweeps.

Everything on scores starts from a histogram ``(by, score, pos, neg)``: a
partial aggregate that shrinks the rows to their distinct scores before the
first shuffle. Curves are running totals over it (see ``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions import decisions as D
from cohortlens.functions.rates import ratio
from cohortlens.operators.ordering import POINTS, running_totals


# ---- decisions --------------------------------------------------------------

def cells(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells per group: rows actual, columns predicted."""
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_metrics(df: DataFrame, label: str, predicted: str,
                      by: Sequence[str] = ()) -> DataFrame:
    return D.with_metrics(cells(df, label, predicted, by))


def confusion_rows(cell_row: DataFrame) -> DataFrame:
    """Long form with the share of each actual class, in percent."""
    def row(actual: int, predicted: int, n: str, total: Column) -> Column:
        return F.struct(F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"),
                        F.col(n).alias("n"),
                        F.round(100 * ratio(F.col(n), total), 2).alias("pct_of_actual"))
    zero, one = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return cell_row.select(F.inline(F.array(
        row(0, 0, "tn", zero), row(0, 1, "fp", zero),
        row(1, 0, "fn", one), row(1, 1, "tp", one))))


def decide(score: str, threshold: float | Column) -> Column:
    """1 when the score reaches the threshold, ties included."""
    return (F.col(score) >= threshold).cast("int")


# ---- curves -----------------------------------------------------------------

def score_histogram(df: DataFrame, label: str, score: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Rows per score and class. Rows without a class 0 or 1, or without a score (null, NaN), are left out."""
    rows = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    if df.schema[score].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan(score))
    return rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"))


def _curve(hist: DataFrame, by: Sequence[str], points: int, follow: bool) -> DataFrame:
    """Histogram rows with cumulative counts at or above each score."""
    return running_totals(hist, "score", ["pos", "neg"], by, descending=True,
                          points=points, follow=follow)


def _is_first() -> Column:
    return (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))


def _bends() -> Column:
    """Not on a straight line between its two neighbours; ends always count.

    A point lies on the line exactly when its own step (pos, neg) equals the
    next one.
    """
    same = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    return _is_first() | F.col("next_pos").isNull() | ~same


def roc_points(hist: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True,
               points: int = POINTS) -> DataFrame:
    """``threshold, fpr, tpr`` with an anchor at (0, 0) whose threshold is null.

    The null stands for "above every score". Rates of a class that does not
    occur are null.
    """
    curve = _curve(hist, by, points, follow=drop_intermediate)
    if drop_intermediate:
        curve = curve.where(_bends())
    here = F.struct(F.col("score").alias("threshold"), F.col("cum_neg").alias("fp"),
                    F.col("cum_pos").alias("tp"))
    zero = F.lit(0).cast("bigint")
    anchor = F.struct(F.lit(None).cast(hist.schema["score"].dataType).alias("threshold"),
                      zero.alias("fp"), zero.alias("tp"))
    steps = F.when(_is_first(), F.array(anchor, here)).otherwise(F.array(here))
    return (curve.select(*by, "total_pos", "total_neg", F.explode(steps).alias("_s"))
            .select(*by, "_s.threshold", "_s.fp", "_s.tp",
                    ratio(F.col("_s.fp"), "total_neg").alias("fpr"),
                    ratio(F.col("_s.tp"), "total_pos").alias("tpr")))


def pick_eer(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ROC point where both error rates are closest; the first one on ties."""
    fnr = 1 - F.col("tpr")
    gap = F.abs(fnr - F.col("fpr"))
    usable = F.when(gap.isNotNull(), F.struct(
        ((F.col("fpr") + fnr) / 2).alias("eer"), F.col("threshold").alias("at")))
    rank = F.struct(gap.alias("gap"), F.coalesce(
        -F.col("threshold"), F.lit(float("-inf"))).alias("place"))
    best = roc.groupBy(*by).agg(F.min_by(usable, F.when(gap.isNotNull(), rank)).alias("_b"))
    return best.select(*by, F.col("_b.eer").alias("eer"),
                       F.col("_b.at").alias("eer_threshold"))


def equal_error_rate(hist: DataFrame, by: Sequence[str] = (),
                     drop_intermediate: bool = True, points: int = POINTS) -> DataFrame:
    return pick_eer(roc_points(hist, by, drop_intermediate, points), by)


def roc_auc(hist: DataFrame, by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Trapezoid area; each step needs only its own counts and the totals."""
    curve = _curve(hist, by, points, follow=False)
    strip = F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")) / 2
    return curve.groupBy(*by).agg(F.try_divide(
        F.sum(strip), F.max("total_pos").cast("double") * F.max("total_neg"))
        .alias("auc_roc"))


def _precision(tp: Column, fp: Column) -> Column:
    """1 before anything is accepted: the curve's anchor at recall 0."""
    return F.coalesce(ratio(tp, tp + fp), F.lit(1.0))


def pr_points(hist: DataFrame, by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """``threshold, precision, recall``; the anchor (recall 0) has no threshold."""
    curve = _curve(hist, by, points, follow=False)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    here = F.struct(F.col("score").alias("threshold"), _precision(tp, fp).alias("precision"),
                    ratio(tp, "total_pos").alias("recall"))
    anchor = F.struct(F.lit(None).cast(hist.schema["score"].dataType).alias("threshold"),
                      F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    steps = F.when(_is_first(), F.array(anchor, here)).otherwise(F.array(here))
    return curve.select(*by, F.explode(steps).alias("_s")).select(*by, "_s.*")


def pr_auc(hist: DataFrame, by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Trapezoid area under precision over recall, with the class-1 prevalence."""
    curve = _curve(hist, by, points, follow=False)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    before = _precision(tp - F.col("pos"), fp - F.col("neg"))
    strip = F.col("pos") * (_precision(tp, fp) + before) / 2
    all_pos, all_neg = F.max("total_pos"), F.max("total_neg")
    return curve.groupBy(*by).agg(
        F.try_divide(F.sum(strip), all_pos.cast("double")).alias("auc_pr"),
        F.try_divide(all_pos.cast("double"), all_pos + all_neg).alias("prevalence"))


def score_granularity(df: DataFrame, score: str, approximate: bool = False) -> DataFrame:
    distinct = (F.approx_count_distinct(score) if approximate
                else F.countDistinct(score))
    return df.agg(F.count(score).alias("n"), distinct.alias("n_distinct"))


# ---- thresholds -------------------------------------------------------------

def threshold_sweep(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
                    thresholds: Sequence[float] = tuple(K.THRESHOLDS)) -> DataFrame:
    """Metrics of ``score >= t`` for every threshold, from one aggregate.

    A row only matters by how many thresholds it reaches, so rows shrink to at
    most ``len(thresholds) + 1`` counts per group before anything is multiplied.
    """
    ordered = sorted(thresholds)
    reached = sum(((F.col(score) >= t).cast("int") for t in ordered), F.lit(0))
    levels = (df.where(F.col(score).isNotNull())
              .groupBy(*by, reached.alias("_reached")).agg(
                  F.count_if(F.col(label) == 1).alias("pos"),
                  F.count_if(F.col(label) == 0).alias("neg")))
    wide = levels.select("*", F.posexplode(F.array(*[F.lit(t) for t in ordered]))
                         .alias("_i", "threshold"))
    hit = F.col("_reached") > F.col("_i")

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).alias(
            {("pos", True): "tp", ("pos", False): "fn",
             ("neg", True): "fp", ("neg", False): "tn"}[(column, when is hit)])

    counted = wide.groupBy(*by, "threshold").agg(
        total("neg", ~hit), total("neg", hit), total("pos", ~hit), total("pos", hit))
    return D.with_metrics(counted)


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), metric: str = "f1_macro") -> DataFrame:
    """The sweep row with the highest metric, the lowest threshold on ties."""
    columns = [c for c in sweep.columns if c not in by]
    best = F.max_by(F.struct(*columns), F.struct(F.col(metric), -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


# ---- groups -----------------------------------------------------------------

def metrics_by_group(df: DataFrame, group: str, label: str, predicted: str, score: str,
                     drop_intermediate: bool = True) -> DataFrame:
    """Confusion metrics and equal error rate of every group, in one job."""
    known = df.where(F.col(group).isNotNull())
    table = confusion_metrics(known, label, predicted, [group])
    rates = equal_error_rate(score_histogram(known, label, score, [group]), [group],
                             drop_intermediate)
    return table.join(rates, group, "left").select(
        group, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        (F.col("tn") + F.col("fp")).alias("n_0"),
        "f1_macro", "recall_0", "recall_1", "eer", "eer_threshold")


def band_means(by_group: DataFrame, band: str, metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean of the groups' metrics per band (a mean of means)."""
    return by_group.groupBy(band).agg(*[F.avg(m).alias(m) for m in metrics])


def band_contrast(by_group: DataFrame, band: str, first, second,
                  metrics: Sequence[str]) -> DataFrame:
    """``second - first`` of the band means, one row per metric."""
    means = by_group.agg(*[
        F.struct(F.avg(F.when(F.col(band) == first, F.col(m))).alias("first"),
                 F.avg(F.when(F.col(band) == second, F.col(m))).alias("second")).alias(m)
        for m in metrics])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m)["first"].alias("first_mean"),
                 F.col(m)["second"].alias("second_mean"),
                 (F.col(m)["second"] - F.col(m)["first"]).alias("difference"))
        for m in metrics])))


def hardest_and_easiest(by_group: DataFrame, group: str, error: str = "eer") -> DataFrame:
    """The groups with the highest and the lowest error, first name on ties."""
    low = F.struct(F.col(error).alias("v"), F.col(group).alias("g"))
    high = F.struct((-F.col(error)).alias("v"), F.col(group).alias("g"))
    return by_group.where(F.col(error).isNotNull()).agg(
        F.min(high).alias("_high"), F.min(low).alias("_low")).select(
        F.col("_high.g").alias("hardest"), (-F.col("_high.v")).alias("hardest_value"),
        F.col("_low.g").alias("easiest"), F.col("_low.v").alias("easiest_value"))


def saturation_point(curve: DataFrame, size: str = "n_train", metric: str = "f1_macro",
                     tolerance: float = K.SATURATION_TOLERANCE) -> DataFrame:
    """The smallest size within ``tolerance`` of the best metric.

    ``saturated`` tells whether a larger size was tried at all: at the largest
    size the rule is met trivially.
    """
    best = curve.agg(F.max(metric)).scalar()
    top = curve.agg(F.max(size)).scalar()
    return (curve.where(F.col(metric) >= best - tolerance)
            .agg(F.min(size).alias("saturates_at"))
            .select("saturates_at", best.alias("best_metric"),
                    (F.col("saturates_at") < top).alias("saturated")))
