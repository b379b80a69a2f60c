"""Faults that went unseen before: each has its own test."""

import pytest
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import evaluate as E
from cohortlens.operators import models as M
from cohortlens.operators import ordering as O
from cohortlens.operators import validate as V


def test_curves_ignore_rows_without_class_or_score(rows):
    table = rows([(None, 0.9), (1, 0.8), (0, 0.6), (1, 0.5), (0, 0.1), (1, float("nan")), (0, None), (2, 0.7)], "y int, s double")
    hist = E.score_histogram(table, "y", "s")
    roc = [(r["threshold"], r["fp"], r["tp"]) for r in E.roc_points(hist, drop_intermediate=False).collect()]
    assert sorted(roc, key=lambda r: (r[1], r[2])) == [(None, 0, 0), (0.8, 0, 1), (0.6, 1, 1), (0.5, 1, 2), (0.1, 2, 2)]
    assert E.pr_points(hist).where("threshold is null").count() == 1


def test_rows_without_an_order_key_come_first(rows):
    table = rows([("g", None, 1), ("g", 2, 5), ("g", 1, 3)], "g string, t int, v int")
    got = {r["v"]: r["previous"] for r in O.previous_in_order(table, ["g"], ["t"], F.col("v")).collect()}
    assert got == {1: None, 3: 1, 5: 3}


def test_guard_tells_how_many_values_are_wrong(rows):
    table = rows([(f"x{i:03d}",) for i in range(35)], "v string")
    with pytest.raises(ValueError, match="35 unexpected values in 'v', the first 20"):
        V.require_domain(table, "v", ["a"])


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


@pytest.fixture(scope="module")
def examples(spark):
    return storage.materialise(spark.range(300).select(
        "id", (F.col("id") % 7 > 0).cast("int").alias("y"),
        F.array(F.rand(1) + (F.col("id") % 7 > 0).cast("int") * 0.4, F.rand(2), F.rand(3)).alias("v")))


def test_forest_does_not_depend_on_files_or_partitions(examples):
    found = []
    for parts in (2, 4, 8):
        data = M.with_class_weights(M.from_array(examples.repartition(parts), "v"), "y")
        model = M.forest(trees=8, depth=6).fit(M.placed(data, "id", 5))
        found.append(sorted(map(tuple, M.with_scores(model, data).select("id", "score").collect())))
    assert found[0] == found[1] == found[2]


def test_fit_rows_have_a_bound(examples):
    few = M.bounded(examples, "id", "y", 100)
    assert few.count() == 100 and M.bounded(examples, "id", "y", 300).count() == 300
    assert few.where("y = 0").count() == pytest.approx(100 / 7, abs=1)


def test_quantiles_of_few_slots_equal_all(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 50).cast("double").alias("v"))
    few, many = (O.exact_quantiles(table, "v", (0.0, 0.25, 0.5, 1.0), ["g"], points=p).orderBy("g").collect() for p in (1, 1023))
    assert few == many
