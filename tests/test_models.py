"""Weights, projections and model experiments on small tables."""

import pytest
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    """One telling column, one that is noise; class 0 is a tenth."""
    return spark.range(500).select(
        "id", (F.col("id") >= 50).cast("int").alias("y"),
        (F.when(F.col("id") < 50, 0.0).otherwise(1.0) + F.rand(3) * 0.5).alias("good"),
        F.rand(4).alias("noise"))


def test_weights(table):
    got = {r["y"]: r["weight"] for r in M.class_weights(table, "y").collect()}
    assert got == {0: 5.0, 1: pytest.approx(0.5556, abs=1e-4)}
    total = M.with_class_weights(table, "y").groupBy("y").agg(F.sum("weight").alias("w"))
    assert {r["y"]: pytest.approx(r["w"]) for r in total.collect()} == {0: 250.0, 1: 250.0}


def test_only_numbers_are_features(table):
    assert M.feature_columns(table, ["id", "y"]) == ["good", "noise"]
    with pytest.raises(ValueError, match="codec"):
        M.feature_columns(table.withColumn("codec", F.lit("gsm")), ["id", "y"])


def test_leak_is_found_and_noise_is_not(table):
    assert M.leak_test(table, table, "good").first()["shortcut"] is True
    assert M.leak_test(table, table, "noise").first()["shortcut"] is False


def test_a_tie_is_class_zero(table):
    """Rows that cannot be told apart, as many of each class, score one half."""
    even = table.where("id < 100").withColumn("one", F.lit(1.0))
    flat = M.with_class_weights(M.assembled(even, ["one"]), "y")
    scored = M.with_scores(M.shallow_tree().fit(flat), flat)
    row = scored.select("score", "predicted").distinct().collect()
    assert len(row) == 1 and row[0]["score"] == 0.5 and row[0]["predicted"] == 0


def test_importances_and_permutation(spark, table):
    vec = M.from_array(table.withColumn("arr", F.array("good", "noise")), "arr")
    model = M.forest(trees=10, depth=4).fit(M.with_class_weights(vec, "y"))
    top = M.feature_importance(spark, model, ["good", "noise"]).first()
    assert top["feature"] == "good" and top["importance"] > 0.5
    loss = {r["feature"]: r["f1_loss"] for r in M.permutation_importance(
        model, vec, "id", "arr", ["good", "noise"]).collect()}
    assert loss["good"] > 0.2 > loss["noise"]
    took = M.scoring_time(model, vec)
    assert took["seconds"] > 0 and took["ms_per_row"] > 0


def test_model_is_fitted_once(spark, table):
    data = M.with_class_weights(M.assembled(table, ["good"]), "y")
    path, calls = storage.scratch_path(spark, "model"), []

    def fit():
        calls.append(1)
        return M.shallow_tree().fit(data)

    for _ in range(2):
        model = M.fit_or_load(spark, path, fit, DecisionTreeClassificationModel)
    assert len(calls) == 1 and model.depth <= 3


def test_scaled_machine_and_report(table):
    data = M.with_class_weights(M.assembled(table, ["good", "noise"]), "y")
    row = M.report(M.with_scores(M.scaled_svm(maxIter=20).fit(data), data)).first()
    assert row["f1_macro"] > 0.95 and row["eer"] < 0.05
    assert sum(map(sum, row["matrix"])) == 500


def test_search_draws_distinct_settings(table):
    data = M.with_class_weights(M.assembled(table, ["good", "noise"]), "y").withColumn(
        "fold", (F.xxhash64("id") % 2 == 0).cast("int"))
    out = M.random_search(data, "fold", 2, 3, {"maxDepth": [1, 2], "minInstancesPerNode": [1, 5]},
                          trees=3).collect()
    assert len({tuple(sorted(r["params"].items())) for r in out}) == 3
