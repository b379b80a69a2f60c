"""Time the headline queries and print one JSON line.

Every query runs once to warm up and then three times; the median counts. The
result is computed in full and thrown away, so no time goes into fetching it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.plans import modelling
from cohortlens.plans.registry import QUERIES
from cohortlens.storage import drop_scratch, materialise

HEADLINE = [
    "frequency_table", "crosstab_wide", "describe_by_group", "pearson_matrix",
    "spearman_matrix", "density_histogram", "label_ingest", "guarded_join",
    "stratified_split_many", "fold_assignment", "sized_samples", "confusion_metrics",
    "threshold_sweep", "equal_error_rate_continuous", "auc_roc", "metrics_by_group",
    "metrics_vs_shared_negatives_continuous", "feature_vector", "prepared_waveform",
    "series_summary", "sign_changes",
]
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def published_size(spark: SparkSession, sf_dir: str):
    """127,096 rows of 44 columns from the embeddings, each copy turned by its number."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    copies = -(-127_096 // rows.count())
    wide = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    wide = wide.select(
        (F.col("vec_id") * copies + F.col("copy")).alias("id"), (F.col("label") != 0).cast("int").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(43)), lambda i: F.get("embedding", i) + F.col("copy") * 0.001 * F.get(
            "embedding", (i + F.col("copy")) % 64)).alias("v")).orderBy("id").limit(127_096)
    return materialise(M.with_class_weights(M.from_array(wide, "v"), "y"), "published-size")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def discard(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    actions = {name: (lambda q=QUERIES[name]: discard(q(spark, sf_dir))) for name in HEADLINE}
    train = modelling._train(spark, sf_dir)
    valid = modelling._valid(spark, sf_dir)
    model = modelling._forest(spark, sf_dir)
    actions["forest_fit"] = lambda: M.forest().fit(M.placed(train, "vec_id"))
    actions["forest_score"] = lambda: discard(M.with_scores(model, valid))
    # the published size: as many rows as the table has, repeated with small shifts to 127,096 x 44
    if os.environ.get("BENCH_FULL_FOREST"):
        big = published_size(spark, sf_dir)
        actions["forest_fit_127096x44"] = lambda: M.forest().fit(M.placed(big, "id"))

    medians, spread = {}, {}
    for name, action in actions.items():
        action()
        times = [timed(action) for _ in range(RUNS)]
        medians[name] = round(statistics.median(times), 3)
        spread[name] = [round(min(times), 3), round(max(times), 3)]
    drop_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(medians.values()), 3),
        "unit": "sec", "queries": medians, "min_max": spread,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
