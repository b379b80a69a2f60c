"""Queries on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.rates import code_to_name
from cohortlens.operators import evaluate as E
from cohortlens.operators import profile as P
from cohortlens.operators import shared as H
from cohortlens.plans.data import FINE, STEPPED, fine_scores, six, stepped_scores, table

METRICS = ["accuracy", "precision_1", "recall_1", "f1_1", "precision_0", "recall_0",
           "f1_0", "f1_macro", "baseline_accuracy", "gain_over_baseline"]
BANDS = {"1-URGENT": "narrow", "2-HIGH": "narrow"}
PRIORITIES = ["5-LOW", "3-MEDIUM", "1-URGENT"]


def _rounded(df, *plain):
    return df.select(*plain, *[six(c) for c in df.columns if c not in plain])


def confusion_metrics(spark, sf):
    out = E.confusion_metrics(stepped_scores(spark, sf), "y", "predicted")
    return _rounded(out, "tn", "fp", "fn", "tp")


def confusion_rows(spark, sf):
    return E.confusion_rows(E.cells(stepped_scores(spark, sf), "y", "predicted"))


def _stepped_hist(spark, sf):
    return E.score_histogram(stepped_scores(spark, sf), "y", "score")


def _fine_hist(spark, sf):
    return E.score_histogram(fine_scores(spark, sf), "y", "score")


def _shown_roc(points):
    return points.select(F.round(F.coalesce("threshold", F.lit(-1.0)), 6).alias("threshold"),
                         "fp", "tp", six("fpr"), six("tpr"))


def roc_points(spark, sf):
    return _shown_roc(E.roc_points(_stepped_hist(spark, sf)))


def roc_points_continuous(spark, sf):
    return _shown_roc(E.roc_points(_fine_hist(spark, sf)))


def roc_points_all(spark, sf):
    return _shown_roc(E.roc_points(_fine_hist(spark, sf), drop_intermediate=False))


def _partly_labelled(spark, sf):
    """Every third order has no class."""
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderstatus") == "F").cast("int")).alias("y"),
        F.col("o_totalprice").alias("score"))
    return E.score_histogram(rows, "y", "score")


def roc_points_partly_labelled(spark, sf):
    return _shown_roc(E.roc_points(_partly_labelled(spark, sf)))


def auc_pr_partly_labelled(spark, sf):
    return _rounded(E.pr_auc(_partly_labelled(spark, sf)))


def equal_error_rate(spark, sf):
    return _rounded(E.equal_error_rate(_stepped_hist(spark, sf)))


def equal_error_rate_continuous(spark, sf):
    return _rounded(E.equal_error_rate(_fine_hist(spark, sf)))


def auc_roc(spark, sf):
    return _rounded(E.roc_auc(_fine_hist(spark, sf)))


def pr_curve(spark, sf):
    return E.pr_points(_fine_hist(spark, sf)).select(
        F.round(F.coalesce("threshold", F.lit(-1.0)), 6).alias("threshold"),
        six("precision"), six("recall"))


def auc_pr(spark, sf):
    return _rounded(E.pr_auc(_fine_hist(spark, sf)))


def threshold_sweep(spark, sf):
    sweep = E.threshold_sweep(stepped_scores(spark, sf), "y", "score")
    return _rounded(sweep, "threshold", "tn", "fp", "fn", "tp")


def best_threshold(spark, sf):
    sweep = E.threshold_sweep(stepped_scores(spark, sf), "y", "score")
    return _rounded(E.best_threshold(sweep), "threshold", "tn", "fp", "fn", "tp")


def score_granularity(spark, sf):
    return E.score_granularity(fine_scores(spark, sf), "score")


def _by_priority(spark, sf):
    return E.metrics_by_group(fine_scores(spark, sf), "priority", "y", "predicted", "score")


def metrics_by_group(spark, sf):
    return _rounded(_by_priority(spark, sf), "priority", "n", "n_0")


def _bands(spark, sf):
    return _by_priority(spark, sf).withColumn("band", code_to_name("priority", BANDS, "wide"))


def band_means(spark, sf):
    return _rounded(E.band_means(_bands(spark, sf), "band", ["f1_macro", "recall_0", "eer"]),
                    "band")


def band_contrast(spark, sf):
    return _rounded(E.band_contrast(_bands(spark, sf), "band", "narrow", "wide",
                                    ["f1_macro", "recall_0", "eer"]), "metric")


def hardest_and_easiest(spark, sf):
    return _rounded(E.hardest_and_easiest(_by_priority(spark, sf), "priority", "eer"),
                    "hardest", "easiest")


def report_order(spark, sf):
    counts = fine_scores(spark, sf).groupBy("priority").agg(F.count("*").alias("n"))
    return P.in_report_order(counts, "priority", PRIORITIES)


def _attacks(spark, sf, score: str, cut: float):
    """Line items: not returned is the shared class 0, the rest are groups."""
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("attack"),
        (F.col("l_returnflag") != "N").cast("int").alias("y"), F.col(score).alias("score"),
        (F.col(score) >= cut).cast("int").alias("predicted"))


def metrics_vs_shared_negatives(spark, sf):
    rows = _attacks(spark, sf, "l_discount", 0.05)
    return _rounded(H.shared_negative_report(rows, "attack", "y", "predicted", "score"),
                    "attack", "n")


def metrics_vs_shared_negatives_continuous(spark, sf):
    rows = _attacks(spark, sf, "l_extendedprice", 50000.0)
    return _rounded(H.shared_negative_report(rows, "attack", "y", "predicted", "score"),
                    "attack", "n")


QUERIES = [roc_points_partly_labelled, auc_pr_partly_labelled, confusion_metrics, confusion_rows, roc_points, roc_points_continuous,
           roc_points_all, equal_error_rate, equal_error_rate_continuous, auc_roc, pr_curve,
           auc_pr, threshold_sweep, best_threshold, score_granularity, metrics_by_group,
           band_means, band_contrast, hardest_and_easiest, report_order,
           metrics_vs_shared_negatives, metrics_vs_shared_negatives_continuous]

# ---- SQL ---------------------------------------------------------------------------

_LABELLED_PART = """scored AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS score
  FROM orders WHERE o_orderkey % 3 <> 0)"""
_CELLS = """count(*) FILTER (y = 0 AND predicted = 0) AS tn,
       count(*) FILTER (y = 0 AND predicted = 1) AS fp,
       count(*) FILTER (y = 1 AND predicted = 0) AS fn,
       count(*) FILTER (y = 1 AND predicted = 1) AS tp"""


def _div(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 0.0)"


_EXPR = {
    "accuracy": "CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp)",
    "precision_1": _div("tp", "tp + fp"), "recall_1": _div("tp", "tp + fn"),
    "f1_1": _div("2 * tp", "2 * tp + fp + fn"),
    "precision_0": _div("tn", "tn + fn"), "recall_0": _div("tn", "tn + fp"),
    "f1_0": _div("2 * tn", "2 * tn + fp + fn"),
    "baseline_accuracy": "CAST(tp + fn AS DOUBLE) / (tn + fp + fn + tp)",
}
_EXPR["f1_macro"] = f"({_EXPR['f1_0']} + {_EXPR['f1_1']}) / 2"
_EXPR["gain_over_baseline"] = f"{_EXPR['accuracy']} - {_EXPR['baseline_accuracy']}"
_ALL = ", ".join(f"round({_EXPR[m]}, 6) AS {m}" for m in METRICS)


def _roc(drop: bool, by: str = "", source: str = "scored") -> str:
    """``roc``: points by group, anchor included (place 0, no threshold)."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    keep = ("WHERE place = 1 OR np IS NULL OR NOT (np = pos AND nn = neg)" if drop else "")
    return f"""hist AS (
      SELECT {key}score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
      FROM {source} GROUP BY {key}score),
    curve AS (
      SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
             row_number() OVER w AS place, lead(pos) OVER w AS np, lead(neg) OVER w AS nn,
             sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n
      FROM hist WINDOW w AS ({part} ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    roc AS (
      SELECT {key}score AS threshold, place, fp, tp, CAST(fp AS DOUBLE) / n AS fpr,
             CAST(tp AS DOUBLE) / p AS tpr FROM curve {keep}
      UNION ALL
      SELECT DISTINCT {key}CAST(NULL AS DOUBLE), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT),
             0.0, 0.0 FROM curve)"""


def _best(by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""eer AS (
      SELECT {key}(fpr + (1 - tpr)) / 2 AS eer, threshold AS eer_threshold
      FROM (SELECT *, row_number() OVER ({part} ORDER BY abs((1 - tpr) - fpr), place) AS r
            FROM roc) WHERE r = 1)"""


_SHOW_ROC = """SELECT round(coalesce(threshold, -1.0), 6) AS threshold, fp, tp,
                      round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc"""
_SWEEP = f"""sweep AS (
      SELECT t AS threshold, count(*) FILTER (y = 0 AND score < t) AS tn,
             count(*) FILTER (y = 0 AND score >= t) AS fp,
             count(*) FILTER (y = 1 AND score < t) AS fn,
             count(*) FILTER (y = 1 AND score >= t) AS tp
      FROM scored, unnest(CAST({K.THRESHOLDS} AS DOUBLE[])) AS u(t) GROUP BY t)"""
_GROUPS = f"""{FINE}, {_roc(True, 'priority')}, {_best('priority')},
    cells AS (SELECT priority, {_CELLS} FROM scored GROUP BY priority),
    grouped AS (
      SELECT cells.priority, tn + fp + fn + tp AS n, tn + fp AS n_0,
             {_EXPR['f1_macro']} AS f1_macro, {_EXPR['recall_0']} AS recall_0,
             {_EXPR['recall_1']} AS recall_1, eer, eer_threshold
      FROM cells JOIN eer USING (priority)),
    banded AS (SELECT *, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'narrow'
                         ELSE 'wide' END AS band FROM grouped)"""


def _shared(score: str, cut: str) -> str:
    return f"""
    WITH base AS (
      SELECT l_returnflag || l_linestatus AS attack, {score} AS score,
             CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS y,
             CASE WHEN {score} >= {cut} THEN 1 ELSE 0 END AS predicted FROM lineitem),
    names AS (SELECT DISTINCT attack FROM base WHERE y = 1),
    paired AS (
      SELECT attack, score, y, predicted FROM base WHERE y = 1
      UNION ALL
      SELECT names.attack, score, y, predicted FROM base, names WHERE y = 0),
    {_roc(True, 'attack', 'paired')}, {_best('attack')},
    cells AS (SELECT attack, {_CELLS} FROM paired GROUP BY attack),
    means AS (SELECT attack, avg(score) AS mean_score FROM base WHERE y = 1 GROUP BY attack)
    SELECT attack, tp + fn AS n, round({_EXPR['recall_1']}, 6) AS recall,
           round({_EXPR['f1_1']}, 6) AS f1_shared, round(mean_score, 6) AS mean_score,
           round(eer, 6) AS eer_shared
    FROM cells JOIN eer USING (attack) JOIN means USING (attack)
    UNION ALL
    SELECT 'bonafide', count(*), round(avg(1 - predicted), 6), NULL,
           round(avg(score), 6), NULL FROM base WHERE y = 0"""


ORACLES = {
    "confusion_metrics": f"""
        WITH {STEPPED}, c AS (SELECT {_CELLS} FROM scored)
        SELECT tn, fp, fn, tp, {_ALL} FROM c""",
    "confusion_rows": f"""
        WITH {STEPPED}
        SELECT y AS actual, predicted, count(*) AS n,
               round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 2) AS pct_of_actual
        FROM scored GROUP BY y, predicted""",
    "roc_points": f"WITH {STEPPED}, {_roc(True)} {_SHOW_ROC}",
    "roc_points_continuous": f"WITH {FINE}, {_roc(True)} {_SHOW_ROC}",
    "roc_points_partly_labelled": f"WITH {_LABELLED_PART}, {_roc(True)} {_SHOW_ROC}",
    "roc_points_all": f"WITH {FINE}, {_roc(False)} {_SHOW_ROC}",
    "equal_error_rate": f"""
        WITH {STEPPED}, {_roc(True)}, {_best()}
        SELECT round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM eer""",
    "equal_error_rate_continuous": f"""
        WITH {FINE}, {_roc(True)}, {_best()}
        SELECT round(eer, 6) AS eer, round(eer_threshold, 6) AS eer_threshold FROM eer""",
    "auc_roc": f"""
        WITH {FINE}, {_roc(True)},
        step AS (SELECT fpr - lag(fpr) OVER w AS dx, tpr + lag(tpr) OVER w AS yy
                 FROM roc WINDOW w AS (ORDER BY place))
        SELECT round(sum(dx * yy / 2), 6) AS auc_roc FROM step""",
    "pr_curve": f"""
        WITH {FINE}, {_roc(False)}
        SELECT round(coalesce(threshold, -1.0), 6) AS threshold,
               round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0), 6) AS precision,
               round(tpr, 6) AS recall FROM roc""",
    "auc_pr_partly_labelled": f"""
        WITH {_LABELLED_PART}, {_roc(False)},
        pr AS (SELECT place, tpr AS r,
                      coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0) AS pre FROM roc),
        step AS (SELECT r - lag(r) OVER w AS dx, pre + lag(pre) OVER w AS yy
                 FROM pr WINDOW w AS (ORDER BY place))
        SELECT round(sum(dx * yy / 2), 6) AS auc_pr,
               (SELECT round(avg(y), 6) FROM scored) AS prevalence FROM step""",
    "auc_pr": f"""
        WITH {FINE}, {_roc(False)},
        pr AS (SELECT place, tpr AS r,
                      coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0) AS pre FROM roc),
        step AS (SELECT r - lag(r) OVER w AS dx, pre + lag(pre) OVER w AS yy
                 FROM pr WINDOW w AS (ORDER BY place))
        SELECT round(sum(dx * yy / 2), 6) AS auc_pr,
               (SELECT round(avg(y), 6) FROM scored) AS prevalence FROM step""",
    "threshold_sweep": f"""
        WITH {STEPPED}, {_SWEEP}
        SELECT threshold, tn, fp, fn, tp, {_ALL} FROM sweep""",
    "best_threshold": f"""
        WITH {STEPPED}, {_SWEEP}
        SELECT threshold, tn, fp, fn, tp, {_ALL} FROM sweep
        ORDER BY {_EXPR['f1_macro']} DESC, threshold LIMIT 1""",
    "score_granularity": f"""
        WITH {FINE} SELECT count(score) AS n, count(DISTINCT score) AS n_distinct FROM scored""",
    "metrics_by_group": f"""
        WITH {_GROUPS}
        SELECT priority, n, n_0, round(f1_macro, 6) AS f1_macro, round(recall_0, 6) AS recall_0,
               round(recall_1, 6) AS recall_1, round(eer, 6) AS eer,
               round(eer_threshold, 6) AS eer_threshold FROM grouped""",
    "band_means": f"""
        WITH {_GROUPS}
        SELECT band, round(avg(f1_macro), 6) AS f1_macro, round(avg(recall_0), 6) AS recall_0,
               round(avg(eer), 6) AS eer FROM banded GROUP BY band""",
    "band_contrast": f"WITH {_GROUPS} " + " UNION ALL ".join(f"""
        SELECT '{m}' AS metric, round(avg({m}) FILTER (band = 'narrow'), 6) AS first_mean,
               round(avg({m}) FILTER (band = 'wide'), 6) AS second_mean,
               round(avg({m}) FILTER (band = 'wide') - avg({m}) FILTER (band = 'narrow'), 6)
               AS difference FROM banded""" for m in ["f1_macro", "recall_0", "eer"]),
    "hardest_and_easiest": f"""
        WITH {_GROUPS}
        SELECT (SELECT priority FROM grouped ORDER BY eer DESC, priority LIMIT 1) AS hardest,
               (SELECT round(max(eer), 6) FROM grouped) AS hardest_value,
               (SELECT priority FROM grouped ORDER BY eer, priority LIMIT 1) AS easiest,
               (SELECT round(min(eer), 6) FROM grouped) AS easiest_value""",
    "report_order": f"""
        WITH {FINE}
        SELECT priority, count(*) AS n,
               CAST(coalesce(list_position({PRIORITIES}, priority), 4) AS INTEGER) AS ordinal
        FROM scored GROUP BY priority ORDER BY ordinal, priority""",
    "metrics_vs_shared_negatives": _shared("l_discount", "0.05"),
    "metrics_vs_shared_negatives_continuous": _shared("l_extendedprice", "50000"),
}
