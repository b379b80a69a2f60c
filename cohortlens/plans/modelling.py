"""Model queries. One forest is fitted per session and table, stored, and reused."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import evaluate as E
from cohortlens.operators import forests as FO
from cohortlens.operators import models as M
from cohortlens.operators import shared as SN
from cohortlens.operators import single_feature as SF
from cohortlens.operators import split as S
from cohortlens.plans.data import six, table
from cohortlens.plans.splitting import _split_sql
from cohortlens.sources.tables import fingerprint, read_or_build, run_record
from cohortlens.storage import materialise, session_dir

NAMES = [f"x{i}" for i in range(1, 65)]
CURVE = [100, 200, None]
#: Trees of each candidate that the search compares; a chosen setting is then fitted with all 100.
SEARCH_TREES = 10


def _session_path(spark, sf, name):
    tag = hashlib.md5(sf.encode()).hexdigest()[:12]
    return f"{session_dir(spark)}/{name}-{tag}"


def _examples(spark, sf):
    """Vectors with a class weight of the training part, split by class."""
    def build():
        rows = table(spark, sf, "embeddings").select(
            "vec_id", "embedding", "label", (F.col("label") != 0).cast("int").alias("y"))
        return S.stratified_split(rows, "vec_id", ["y"])
    stored = read_or_build(spark, _session_path(spark, sf, "examples"), build,
                           partition_by=["conjunto"])
    return M.from_array(stored, "embedding")


def _train(spark, sf):
    rows = _examples(spark, sf).where(F.col("conjunto") == "treino")
    return M.with_class_weights(rows, "y")


def _valid(spark, sf):
    return _examples(spark, sf).where(F.col("conjunto") == "validacao")


def _forest(spark, sf):
    return M.fit_or_load(spark, _session_path(spark, sf, "forest"),
                         lambda: _timed_fit(spark, sf), FO.GrownForest)


def _timed_fit(spark, sf):
    """The model, and beside it how long the fit took and on how many rows."""
    train = materialise(_train(spark, sf).select("vec_id", "y", "features", "weight"), "train")
    rows = M.placed(train, "vec_id")
    took, model = M.seconds(lambda: M.forest().grow(rows))
    facts = spark.createDataFrame([(took, train.count())], "fit_seconds double, n_train long")
    facts.write.mode("overwrite").parquet(_session_path(spark, sf, "forest-facts"))
    return model


def _scored(spark, sf):
    """The validation rows with their scores, worked out once per session."""
    return read_or_build(spark, _session_path(spark, sf, "forest-scores"), lambda: M.with_scores(
        _forest(spark, sf), _valid(spark, sf).select("vec_id", "label", "y", "features")).select(
            "vec_id", "label", "y", "predicted", "score"))


def forest_scores(spark, sf):
    return _scored(spark, sf).select("vec_id", "y", "predicted", "score")


def forest_report(spark, sf):
    return M.report(_scored(spark, sf))


def forest_by_group(spark, sf):
    """The forest's metrics within groups of rows (here by id, as a stand-in for the codec)."""
    rows = _scored(spark, sf).withColumn("group", F.concat(F.lit("g"), (F.col("vec_id") % 3).cast("string")))
    return E.metrics_by_group(rows, "group", "y", "predicted", "score")


def forest_by_attack(spark, sf):
    """Each positive class against all negatives, on the forest's scores."""
    rows = _scored(spark, sf).withColumn("attack", F.concat(F.lit("c"), F.col("label").cast("string")))
    return SN.shared_negative_report(rows, "attack", "y", "predicted", "score")


def forest_thresholds(spark, sf):
    """Metrics of the forest's scores over the decision thresholds."""
    return E.threshold_sweep(_scored(spark, sf), "y", "score")


def forest_record(spark, sf):
    """Every published field of a run: parameters, rows, times, metrics, matrix, top features."""
    model, valid = _forest(spark, sf), _valid(spark, sf)
    times = M.scoring_time(model, valid)
    facts = spark.read.parquet(_session_path(spark, sf, "forest-facts")).first()
    report = M.report(_scored(spark, sf)).select(F.struct("*")).scalar()
    top = M.feature_importance(spark, model, NAMES).agg(F.map_from_entries(
        F.collect_list(F.struct("feature", "importance")))).scalar()
    made_on = fingerprint(_examples(spark, sf), ["vec_id", "y", "conjunto"]).select(F.struct("*")).scalar()
    return run_record(spark, {
        "split_rows": made_on["n"], "split_hash": made_on["content_hash"], "model": "forest", "trees": 100, "depth": 30, "seed": K.SEED, "stratification": "y",
        "n_train": facts["n_train"], "n_valid": valid.count(), "n_features": len(NAMES),
        "fit_seconds": facts["fit_seconds"], "metrics": report, "top_features": top,
        "score_seconds": times["seconds"], "score_ms_per_row": times["ms_per_row"]})


def forest_identities(spark, sf):
    """What must hold whatever the model: the cells are the rows of each class, importances sum to one."""
    whole = M.feature_importance(spark, _forest(spark, sf), NAMES, k=None).agg(
        F.count("*").alias("n_features"), F.round(F.sum("importance"), 3).alias("importance"))
    cells = M.report(_scored(spark, sf)).select(
        (F.col("tn") + F.col("fp")).alias("n_0"), (F.col("fn") + F.col("tp")).alias("n_1"),
        F.struct(*[F.col(c) for c in ("tn", "fp", "fn", "tp")]).alias("_c"))
    table_ = _scored(spark, sf).agg(
        F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
        F.bool_and((F.col("score") > 0.5).cast("int") <= F.col("predicted")).alias("decisions_fit"))
    one = F.lit(1).alias("_one")
    return (cells.select("n_0", "n_1", one).join(whole.select("*", one), "_one")
            .join(table_.select("*", one), "_one").drop("_one"))


def feature_importance(spark, sf):
    return M.feature_importance(spark, _forest(spark, sf), NAMES)


def permutation_importance(spark, sf):
    return M.permutation_importance(_forest(spark, sf), _valid(spark, sf), "vec_id",
                                    "embedding", NAMES)


def _priced(spark, sf):
    """Orders by price, split by class; the price is the one feature."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return materialise(S.stratified_split(rows, "o_orderkey", ["y"]), "leak")


def exact_leak_tree(spark, sf):
    """Leaves of the exact tree on one feature, with the held-out rows of each class that fall in them."""
    split = _priced(spark, sf)
    leaves = materialise(SF.grow(split.where(F.col("conjunto") == "treino"), "o_totalprice"), "leaves")
    held = SF.with_leaf_scores(split.where(F.col("conjunto") == "validacao"), leaves, "o_totalprice")
    falls = held.groupBy("leaf").agg(F.count_if(F.col("y") == 0).alias("valid_0"),
                                     F.count_if(F.col("y") == 1).alias("valid_1"))
    return leaves.join(falls, "leaf", "left").select(
        "leaf", six("low"), six("high"), "n_0", "n_1", six("score"),
        F.coalesce("valid_0", F.lit(0)).alias("valid_0"), F.coalesce("valid_1", F.lit(0)).alias("valid_1"))


def one_feature_leak_test(spark, sf):
    split = _priced(spark, sf)
    return M.leak_test(split.where(F.col("conjunto") == "treino"),
                       split.where(F.col("conjunto") == "validacao"), "o_totalprice")


def _curve(spark, sf):
    def build():
        train = _examples(spark, sf).where(F.col("conjunto") == "treino")
        samples = materialise(S.sized_samples(train, "vec_id", ["y"], CURVE), "samples")
        return M.learning_curve(samples, _valid(spark, sf), CURVE, "vec_id")
    return read_or_build(spark, _session_path(spark, sf, "curve"), build)


def learning_curve(spark, sf):
    return _curve(spark, sf)


def saturation_point(spark, sf):
    return E.saturation_point(_curve(spark, sf))


def linear_svm(spark, sf):
    model = M.scaled_svm().fit(_train(spark, sf))
    return M.report(M.with_scores(model, _valid(spark, sf)))


def svm_scaling(spark, sf):
    """What the linear machine scales by: mean and deviation of every feature over the training rows."""
    stage = M.scaled_svm(maxIter=1).fit(_train(spark, sf)).stages[0]
    rows = [(n, float(m), float(d)) for n, m, d in zip(NAMES, stage.mean, stage.std)]
    return spark.createDataFrame(rows, "feature string, mean double, std double").select(
        "feature", six("mean"), six("std"))


def random_search(spark, sf):
    folds = K.FOLDS
    rows = S.stratified_folds(_examples(spark, sf).where(F.col("conjunto") == "treino"),
                              "vec_id", ["y"], folds)
    train = M.placed(M.with_class_weights(materialise(rows, "folds"), "y"), "vec_id")
    return M.random_search(train, "fold", folds, draws=30, trees=SEARCH_TREES, space={
        "maxDepth": [5, 10, 20, 30], "minInstancesPerNode": [1, 2, 5],
        "featureSubsetStrategy": ["sqrt", "log2", "onethird"]})


QUERIES = [forest_identities, forest_by_group, forest_by_attack, forest_thresholds, forest_scores, forest_report, forest_record, feature_importance,
           permutation_importance, one_feature_leak_test, exact_leak_tree, svm_scaling, learning_curve,
           saturation_point, linear_svm, random_search]
_FOREST_ROWS = _split_sql(
    "(SELECT vec_id, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y FROM embeddings)", "vec_id",
    "CAST(y AS VARCHAR)", False)


def _tree_level(k: int) -> str:
    """SQL of one level: nodes of the cuts so far, the best cut of each, and the cuts with them."""
    return f"""node{k} AS (
      SELECT h.*, (SELECT count(*) FROM edges{k} c WHERE c.edge < h.value) AS node FROM hist h),
    run{k} AS (
      SELECT node, value, sum(n_0) OVER upto AS l0, sum(n_1) OVER upto AS l1,
             sum(n_0) OVER whole AS t0, sum(n_1) OVER whole AS t1, lead(value) OVER seq AS above
      FROM node{k} WINDOW seq AS (PARTITION BY node ORDER BY value), whole AS (PARTITION BY node),
        upto AS (PARTITION BY node ORDER BY value ROWS UNBOUNDED PRECEDING)),
    best{k} AS (
      SELECT node, value, above FROM run{k}, w WHERE t0 > 0 AND t1 > 0 AND above IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY
        (l0 * w0) * (l1 * w1) / (l0 * w0 + l1 * w1)
        + ((t0 - l0) * w0) * ((t1 - l1) * w1) / ((t0 - l0) * w0 + (t1 - l1) * w1), value) = 1),
    edges{k + 1} AS (SELECT edge FROM edges{k} UNION ALL SELECT (value + above) / 2 FROM best{k})"""


_PRICE_ROWS = _split_sql(
    """(SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS value,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)""", "o_orderkey", "CAST(y AS VARCHAR)", False)

ORACLES = {
    "exact_leak_tree": f"""{_PRICE_ROWS},
        hist AS (SELECT value, count(*) FILTER (y = 0)::DOUBLE AS n_0, count(*) FILTER (y = 1)::DOUBLE AS n_1
                 FROM split WHERE conjunto = 'treino' AND value IS NOT NULL GROUP BY value),
        w AS (SELECT sum(n_0 + n_1) / (2.0::DOUBLE * sum(n_0)) AS w0,
                     sum(n_0 + n_1) / (2.0::DOUBLE * sum(n_1)) AS w1 FROM hist),
        edges0 AS (SELECT 0.0::DOUBLE AS edge WHERE false),
        {", ".join(_tree_level(k) for k in range(3))},
        bounds AS (SELECT CAST(row_number() OVER (ORDER BY edge NULLS FIRST) - 1 AS INTEGER) AS leaf, edge AS low,
                        lead(edge) OVER (ORDER BY edge NULLS FIRST) AS high
                 FROM (SELECT edge FROM edges3 UNION ALL SELECT NULL)),
        leaves AS (
          SELECT leaf, low, high, sum(n_0) AS n_0, sum(n_1) AS n_1,
                 sum(n_1) * any_value(w1) / (sum(n_0) * any_value(w0) + sum(n_1) * any_value(w1)) AS score
          FROM hist, w, bounds WHERE (low IS NULL OR value > low) AND (high IS NULL OR value <= high)
          GROUP BY leaf, low, high),
        held AS (
          SELECT leaf, count(*) FILTER (y = 0) AS valid_0, count(*) FILTER (y = 1) AS valid_1
          FROM split, leaves WHERE conjunto = 'validacao' AND (low IS NULL OR value > low)
            AND (high IS NULL OR value <= high) GROUP BY leaf)
        SELECT leaf, round(low, 6) AS low, round(high, 6) AS high, CAST(n_0 AS BIGINT) AS n_0,
               CAST(n_1 AS BIGINT) AS n_1, round(score, 6) AS score, coalesce(valid_0, 0) AS valid_0,
               coalesce(valid_1, 0) AS valid_1 FROM leaves LEFT JOIN held USING (leaf)""",
    "svm_scaling": _split_sql(
        "(SELECT vec_id, embedding, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y FROM embeddings)", "vec_id",
        "CAST(y AS VARCHAR)", False) + """
        SELECT 'x' || i AS feature, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean,
               round(stddev_samp(CAST(embedding[i] AS DOUBLE)), 6) AS std
        FROM split, generate_series(1, 64) AS g(i) WHERE conjunto = 'treino' GROUP BY i""",
    "forest_identities": f"""{_FOREST_ROWS}
        SELECT count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1, 64 AS n_features,
               1.0::DOUBLE AS importance, count(*) AS n, true AS in_range, true AS decisions_fit
        FROM split WHERE conjunto = 'validacao'""",
}
