"""Audits of an extraction run: failures, bias, inventory, health, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.rates import percent, ratio
from cohortlens.operators.profile import top_k


def error_type(column: str) -> Column:
    """What stands before the first bracket of an exception's text."""
    return F.substring_index(F.col(column), "(", 1)


def error_excerpt(column: str, chars: int = K.ERROR_TEXT_CHARS) -> Column:
    return F.substring(F.col(column), 1, chars)


def common_errors(errors: DataFrame, column: str = "erro", k: int = 10) -> DataFrame:
    return top_k(errors, error_type(column), k, "error_type")


def example_errors(errors: DataFrame, id_col: str, column: str = "erro",
                   n: int = 3) -> DataFrame:
    return (errors.orderBy(id_col).limit(n)
            .select(id_col, error_excerpt(column).alias("excerpt")))


def failure_bias(labels: DataFrame, failed: DataFrame, survived: DataFrame,
                 key: str, label: str, minority, majority,
                 limit: float = K.BIAS_PERCENT) -> DataFrame:
    """Class shares before, among failures and after, and the ratio's shift.

    One row per class; the run-level ratios and verdict repeat on each row.
    ``failed`` and ``survived`` need only the key; the label comes from
    ``labels``.
    """
    state = (labels.select(key, F.col(label).alias("label"))
             .join(failed.select(key).distinct().withColumn("_failed", F.lit(True)),
                   key, "left")
             .join(survived.select(key).distinct().withColumn("_kept", F.lit(True)),
                   key, "left"))
    per_class = state.groupBy("label").agg(
        F.count("*").alias("n_original"), F.count("_failed").alias("n_failed"),
        F.count("_kept").alias("n_survived"))

    def of(value, column: str) -> Column:
        return F.sum(F.when(F.col("label") == value, F.col(column)))

    totals = per_class.agg(
        F.sum("n_original").alias("_o"), F.sum("n_failed").alias("_f"),
        F.sum("n_survived").alias("_s"),
        ratio(of(majority, "n_original"), of(minority, "n_original")).alias("ratio_before"),
        ratio(of(majority, "n_survived"), of(minority, "n_survived")).alias("ratio_after"))
    run = F.col("_run")
    shift = 100 * ratio(F.abs(run["ratio_after"] - run["ratio_before"]), run["ratio_before"])
    return (per_class
            .withColumn("_run", totals.select(F.struct("*")).scalar())
            .select(
                "label", "n_original", percent("n_original", run["_o"]).alias("pct_original"),
                "n_failed", percent("n_failed", run["_f"]).alias("pct_failed"),
                "n_survived", percent("n_survived", run["_s"]).alias("pct_survived"),
                F.round(run["ratio_before"], 4).alias("ratio_before"),
                F.round(run["ratio_after"], 4).alias("ratio_after"),
                F.round(shift, 4).alias("shift_pct"),
                F.when(shift < limit, "uniform").when(shift >= limit, "biased")
                .alias("verdict")))


def inventory_check(labels: DataFrame, features: DataFrame, errors: DataFrame,
                    key: str) -> DataFrame:
    """Counts of the three tables, whether they add up, and stray or missing ids."""
    listed = labels.select(key).distinct().withColumn("_listed", F.lit(1))
    handled = (features.select(key).unionByName(errors.select(key))
               .groupBy(key).agg(F.count("*").alias("_times")))
    ids = listed.join(handled, key, "full_outer").agg(
        F.count_if(F.col("_times").isNull()).alias("n_missing"),
        F.count_if(F.col("_listed").isNull()).alias("n_stray"),
        F.count_if(F.col("_times") > 1).alias("n_repeated"))
    rows = labels.agg(F.count("*").alias("n_labels")).select(
        "n_labels", features.agg(F.count("*")).scalar().alias("n_features"),
        errors.agg(F.count("*")).scalar().alias("n_errors"),
        ids.select(F.struct("*")).scalar().alias("_ids"))
    return rows.select(
        "n_labels", "n_features", "n_errors",
        (F.col("n_labels") == F.col("n_features") + F.col("n_errors")).alias("adds_up"),
        "_ids.n_missing", "_ids.n_stray", "_ids.n_repeated")


def share_health(df: DataFrame, share: str, low: float = K.LOW_SHARE_MEAN) -> DataFrame:
    """How many kept-shares are zero, their mean, and whether it is too low."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(share) == 0).alias("n_zero"),
        F.avg(share).alias("_mean")).select(
        "n", "n_zero", percent("n_zero", "n").alias("pct_zero"),
        F.round("_mean", 6).alias("mean_share"),
        (F.col("_mean") < low).alias("too_aggressive"))


def split_overlap(df: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    """Per key column: how many of its values occur in more than one part."""
    long = df.select(part, F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
        for k in keys])).alias("_kv")).select(part, "_kv.key", "_kv.value")
    seen = (long.where(F.col("value").isNotNull()).groupBy("key", "value", part).count()
            .groupBy("key", "value").agg(F.count("*").alias("_parts")))
    return seen.groupBy("key").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("_parts") > 1).alias("n_shared"),
        F.max("_parts").alias("most_parts"))
