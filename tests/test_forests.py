"""The forest whose small nodes are finished in tasks: against MLlib's tree, and whole whatever the cut."""

import functools

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.functions import trees as G
from cohortlens.operators import forests as FO
from cohortlens.operators import models as M
from cohortlens.plans import modelling as PM
from cohortlens.storage import materialise, scratch_path


@pytest.fixture(autouse=True)
def grouped(monkeypatch):
    monkeypatch.setattr(FO, "FEW", -1)


@pytest.fixture(scope="module")
def examples(spark):
    """Weights are powers of two, so sums do not depend on their order."""
    values = [F.floor(F.rand(s) * 25).cast("double") for s in range(1, 6)]
    rows = materialise(spark.range(1200).select("id", F.array(*values).alias("v"), F.rand(9).alias("r")))
    y = ((F.col("v")[0] + F.col("v")[1] * 0.5 + F.col("r") * 12) > 24).cast("int")
    return M.placed(M.from_array(rows.withColumn("y", y).withColumn("weight", F.when(y == 1, 1.0).otherwise(0.25)), "v"), "id", 4)


def scores(model, rows):
    found = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()
    return {r["id"]: r["p"] for r in found}


def test_one_tree_equals_mllib(examples):
    model = M.forest(trees=1, depth=5).setFeatureSubsetStrategy("all")
    theirs = DecisionTreeClassifier(labelCol="y", weightCol="weight", maxDepth=5).fit(examples)
    ours = model.fit(examples)
    assert ours.totalNumNodes == theirs.numNodes and ours.trees[0].depth == theirs.depth
    assert scores(ours, examples) == pytest.approx(scores(theirs, examples))
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())


def test_upper_part_changes_nothing(examples, monkeypatch):
    whole = M.forest(trees=6, depth=12).fit(examples)
    monkeypatch.setattr(FO, "LOCAL", 60)
    cut = M.forest(trees=6, depth=12).fit(examples)
    assert cut.totalNumNodes == whole.totalNumNodes > 300
    assert scores(cut, examples) == pytest.approx(scores(whole, examples))


def test_no_task_gets_more_than_its_bound(examples, monkeypatch):
    monkeypatch.setattr(FO, "LOCAL", 100)
    width, trees, seen = 5, 3, []
    tops = FO._tops
    monkeypatch.setattr(FO, "_tops", lambda *a: seen.extend(tops(*a)) or seen)
    M.forest(trees=trees, depth=20).fit(examples)
    assert len(seen) == trees and all(t["n"][t["open"]].max() <= 100 and len(t["n"]) > 10 for t in seen)
    assert all(len(G.drawn(t["path"], width, 3)[0]) == 3 for t in seen)


def test_settings_fitted_together_equal_those_alone(examples):
    forest = M.forest(trees=4, depth=6)
    maps = [{forest.maxDepth: 2}, {forest.maxDepth: 6, forest.minInstancesPerNode: 20}, {forest.featureSubsetStrategy: "onethird"}]
    together = dict(forest.fitMultiple(examples, maps))
    for i, setting in enumerate(maps):
        assert scores(together[i], examples) == scores(forest.fit(examples, setting), examples)
    assert max(t.depth for t in together[0].trees) <= 2


def test_table_of_trees_equals_mllibs_model_of_the_same_nodes(spark, examples, monkeypatch):
    """Also where the rows come in several slices, the trees in several groups, and after it was stored."""
    forest, columns = M.forest(trees=7, depth=9, seed=3), ["id", "score", "predicted"]
    theirs = forest.fit(examples)
    monkeypatch.setattr(FO, "LOCAL", 500)
    monkeypatch.setattr(FO, "TOGETHER", 3)
    path = scratch_path(spark, "trees")
    ours = M.fit_or_load(spark, path, lambda: forest.grow(examples), FO.GrownForest)
    assert M.fit_or_load(spark, path, lambda: pytest.fail("a second fit"), FO.GrownForest).totalNumNodes == theirs.totalNumNodes
    wanted = M.with_scores(theirs, examples).select(*columns).orderBy("id").collect()
    found = M.with_scores(ours, examples).select(*columns).orderBy("id").collect()
    assert [r["score"] for r in found] == pytest.approx([r["score"] for r in wanted], abs=1e-12)
    assert [(r["id"], r["predicted"]) for r in found] == [(r["id"], r["predicted"]) for r in wanted]
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())
    assert M.with_scores(ours, examples.limit(0)).count() == 0
    with pytest.raises(ValueError, match="does not know"):
        M.forest(trees=2, subsamplingRate=0.5).grow(examples)


def _vectors(spark, tmp_path, n=300):
    """A table of ``n`` vectors of 64 values, the first tells the class."""
    values = [F.floor(F.rand(s) * 20).cast("float") for s in range(64)]
    rows = materialise(spark.range(n).select(F.col("id").alias("vec_id"), F.array(*values).alias("embedding")))
    rows.withColumn("label", F.when(F.col("embedding")[0] > 5, 1 + F.col("vec_id") % 3).otherwise(0).cast("int")).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_forest_queries_learn_from_every_training_row(spark, tmp_path, monkeypatch):
    """Whatever bound the input passes: a fit that samples 100 rows above 100 has not seen the 210 of the training part."""
    if hasattr(M, "bounded"):
        monkeypatch.setattr(M, "bounded", functools.partial(M.bounded, rows=100))
    monkeypatch.setattr(M, "forest", functools.partial(M.forest, trees=3))
    sf = _vectors(spark, tmp_path)
    assert PM.forest_record(spark, sf).first()["n_train"] == 210
    assert PM.permutation_importance(spark, sf).count() == 64


def test_forest_queries_have_one_learner_at_any_size(spark, tmp_path, monkeypatch):
    """The bound below which MLlib's learner fits must not tell in their rows."""
    monkeypatch.setattr(M, "forest", functools.partial(M.forest, trees=5))
    scored = {}
    for few in (0, 1000):
        monkeypatch.setattr(FO, "FEW", few)
        (tmp_path / str(few)).mkdir()
        found = PM.forest_scores(spark, _vectors(spark, tmp_path / str(few))).orderBy("vec_id").collect()
        scored[few] = [(r["vec_id"], r["predicted"], r["score"]) for r in found]
    assert scored[0] == scored[1000] and len(scored[0]) == 45


def test_few_rows_are_fitted_by_mllib(examples, monkeypatch):
    monkeypatch.setattr(FO, "FEW", 1200)
    monkeypatch.setattr(FO, "grown", None)
    assert M.forest(trees=2, depth=2).fit(examples).getNumTrees == 2


def test_odd_rows(spark, examples):
    one = M.forest(trees=3).fit(examples.where("y = 1"))
    assert set(scores(one, examples.limit(5)).values()) == {1.0}
    with pytest.raises(ValueError, match="no rows"):
        M.forest(trees=3).fit(examples.limit(0))
    with pytest.raises(ValueError, match="weight"):
        M.forest(trees=3).fit(examples.withColumn("weight", F.when(F.col("id") > 0, 1.0)))


def test_draws_and_cuts():
    drawn = G.drawn(np.arange(4000, dtype=np.uint64), 10, 3)
    assert (np.diff(drawn, axis=1) > 0).all() and np.bincount(drawn.ravel()).min() > 1000
    assert G.cut_points(np.array([1.0, 2.0, np.nan, 2.0, 4.0]), np.ones(5), 32).tolist() == [1.5, 3.0]
    assert len(G.cut_points(np.arange(1000.0), np.ones(1000), 32)) == 31
    assert len(G.cut_points(np.ones(5), np.ones(5), 32)) == 0


def test_search_scores_every_setting_without_a_model_each(examples, monkeypatch):
    """With few rows at a time: trees have an upper part, and the held-out rows come in several slices."""
    monkeypatch.setattr(FO, "LOCAL", 300)
    rows = examples.withColumn("fold", (F.col("id") % 2).cast("int")).persist()
    area = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="probability", numBins=0)
    forest, wanted = M.forest(trees=2), {"2": [], "7": []}
    for k in range(2):
        maps = [{forest.maxDepth: int(d)} for d in wanted]
        for i, model in forest.fitMultiple(rows.where(F.col("fold") != k), maps):
            wanted[str(maps[i][forest.maxDepth])].append(area.evaluate(model.transform(rows.where(F.col("fold") == k))))
    monkeypatch.setattr(FO, "FEW", 10_000)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *_: pytest.fail("a fit a setting"))
    found = M.random_search(rows, "fold", 2, 2, {"maxDepth": [2, 7]}, trees=2).collect()
    assert {r["params"]["maxDepth"]: r["mean_auc"] for r in found} == pytest.approx({d: np.mean(a) for d, a in wanted.items()})
    assert found[0]["mean_auc"] > 0.6


def test_search_with_odd_folds(examples):
    space = {"maxDepth": [2, 3]}
    ones = examples.withColumn("fold", (F.col("y") == 1).cast("int"))  # each fold has one class: areas of 0 and 1
    assert [r["mean_auc"] for r in M.random_search(ones, "fold", 2, 2, space, trees=2).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError, match="no rows"):
        M.random_search(examples.withColumn("fold", F.lit(0)), "fold", 2, 2, space, trees=2)
    with pytest.raises(ValueError, match="range"):
        M.random_search(examples.withColumn("fold", (F.col("id") % 3).cast("int")), "fold", 2, 2, space, trees=2)
