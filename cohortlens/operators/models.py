"""Class-weighted models on tables, their scores, importances and checks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as K
from cohortlens.operators import evaluate as E
from cohortlens.operators.forests import APART, GroupedForest, GrownForest, held_out_scores
from cohortlens.operators.ordering import hash_positions
from cohortlens.operators.split import stratified_sample
from cohortlens.sources.tables import holds_table
from cohortlens.storage import broadcast_if_small, materialise

#: Partitions that a model is fitted on.
FIT_PARTITIONS = 16


# ---- inputs -------------------------------------------------------------------

def feature_columns(df: DataFrame, exclude: Sequence[str] = tuple(K.NOT_FEATURES)) -> list[str]:
    """Every column but the excluded ones, in table order.

    Call it before metadata is joined in. A column that is not numeric cannot
    be a feature and raises, so a forgotten exclusion does not pass silently.
    """
    names = [c for c in df.columns if c not in set(exclude)]
    wrong = [c for c in names if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"not numeric, so not features: {wrong}")
    return names


def assembled(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name,
                           handleInvalid="error").transform(df)


def from_array(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.transform(
        F.col(column), lambda v: v.cast("double"))))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return (counts.withColumn("_all", every).select(
        label, "n", (F.col("_all.n") / (F.col("_all.k") * F.col("n"))).alias("weight")))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Every row gets its class's weight; a table of classes too large to share joins by shuffle."""
    table = materialise(class_weights(df, label).select(label, F.col("weight").alias(name)), "class-weights")
    return df.join(broadcast_if_small(table), label, "left").select(*df.columns, name)


# ---- fitting and scoring --------------------------------------------------------

def placed(df: DataFrame, id_col: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Put every row where its id says, in id order.

    The learner draws its samples partition by partition, so the same rows must lie in the same places
    for the same seed to give the same model, on any number of cores and files. The number of
    partitions is therefore a parameter of the model.
    """
    return df.repartition(partitions, id_col).sortWithinPartitions(id_col)


def bounded(df: DataFrame, id_col: str, label: str, rows: int, seed: int = K.SEED) -> DataFrame:
    """At most ``rows`` labelled rows, an exact sample of each class; a smaller table as it is. No query fits on these."""
    return df if df.count() <= rows else stratified_sample(df, id_col, [label], rows, seed)


def forest(trees: int = 100, depth: int = 30, seed: int = K.SEED, label: str = "y",
           weight: str | None = "weight", **params) -> RandomForestClassifier:
    """The baseline learner; 30 is the deepest tree that MLlib's models hold.

    Its small nodes are finished where their rows lie (``forests``).
    """
    settings = {"cacheNodeIds": True, **params}
    model = GroupedForest(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", seed=seed, **settings)
    return model.setWeightCol(weight) if weight else model


def shallow_tree(depth: int = 3, seed: int = K.SEED, label: str = "y",
                 weight: str = "weight") -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth,
                                  weightCol=weight, seed=seed)


def scaled_svm(label: str = "y", weight: str = "weight", **params) -> Pipeline:
    """Linear machine behind a scaler that is fitted on the training rows only."""
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LinearSVC(labelCol=label, featuresCol="scaled", weightCol=weight, **params)])


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], object], kind,
                force: bool = False):
    """Train once, report many: a stored model is loaded, not trained again."""
    if force or not holds_table(spark, f"{path.rstrip('/')}/metadata"):
        fit().write().overwrite().save(path)
    return kind.load(path)


def with_scores(model, df: DataFrame, score: str = "score",
                predicted: str = "predicted") -> DataFrame:
    """Class-1 probability and decision, added to the rows they belong to.

    A machine without probabilities gives its margin instead. A forest that is a table of trees gives
    the rows back without their vector.
    """
    if isinstance(model, GrownForest):
        return model.with_scores(df, score, predicted)
    out = model.transform(df)
    if "probability" in out.columns:
        value = vector_to_array("probability")[1]
    else:
        value = vector_to_array("rawPrediction")[1]
    return out.withColumn(score, value).select(
        *df.columns, score, F.col("prediction").cast("int").alias(predicted))


def feature_importance(spark: SparkSession, model, names: Sequence[str],
                       k: int | None = 10) -> DataFrame:
    """Impurity importances as rows, largest first, rounded to 5 decimals."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    rows = [(n, float(v)) for n, v in zip(names, stage.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    table = (table.withColumn("importance", F.round("importance", 5))
             .orderBy(F.desc("importance"), "feature"))
    return table if k is None else table.limit(k)


def seconds(action: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    result = action()
    return time.perf_counter() - start, result


def scoring_time(model, df: DataFrame) -> dict[str, float]:
    """Seconds to score every row, and milliseconds per row."""
    n = df.count()
    took, _ = seconds(lambda: with_scores(model, df).write.format("noop")
                      .mode("overwrite").save())
    return {"seconds": took, "ms_per_row": 1000 * took / n if n else float("nan")}


def report(scored: DataFrame, label: str = "y") -> DataFrame:
    """The one-row baseline report: metrics, baseline, error rate, matrix.

    The scored rows are stored first, so the model scores each row once.
    """
    scored = materialise(scored.select(label, "predicted", "score"), "scored")
    table = E.confusion_metrics(scored, label, "predicted")
    rate = E.equal_error_rate(E.score_histogram(scored, label, "score"))
    return (table.withColumn("_eer", rate.select(F.struct("*")).scalar())
            .select("*", F.col("_eer.eer").alias("eer"),
                    F.col("_eer.eer_threshold").alias("eer_threshold"),
                    F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))
            .drop("_eer"))


# ---- experiments ----------------------------------------------------------------

def leak_test(train: DataFrame, valid: DataFrame, column: str, label: str = "y",
              limit: float = K.LEAK_F1, seed: int = K.SEED) -> DataFrame:
    """Can one column alone tell the classes apart? A shallow tree tries."""
    weighted = with_class_weights(assembled(train, [column]), label)
    model = shallow_tree(seed=seed, label=label).fit(weighted)
    scored = with_scores(model, assembled(valid, [column]))
    out = report(scored, label)
    n_train = train.agg(F.count("*")).scalar()
    return out.select(
        F.lit(column).alias("feature"), n_train.alias("n_train"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_valid"), "tn", "fp", "fn", "tp",
        F.round("f1_macro", 4).alias("f1_macro"), F.round("eer", 4).alias("eer"),
        (F.col("f1_macro") > limit).alias("shortcut"))


def learning_curve(samples: DataFrame, valid: DataFrame, sizes: Sequence[int | None],
                   id_col: str, label: str = "y", trees: int = 100, depth: int = 30,
                   seed: int = K.SEED) -> DataFrame:
    """One model per sample size, scored on the same validation rows.

    ``samples`` is a stored table from ``split.sized_samples``; each size reads
    its own rows of it. The loop is over the handful of sizes.
    """
    spark = samples.sparkSession
    tables = []
    for n in sizes:
        part = samples.where(F.col("sample_rows").eqNullSafe(F.lit(n).cast("bigint")))
        train = with_class_weights(part, label)
        took, model = seconds(lambda: forest(trees, depth, seed, label).fit(placed(train, id_col)))
        rows = part.agg(F.count("*")).scalar()
        tables.append(report(with_scores(model, valid), label).select(
            rows.alias("n_train"), F.round("f1_macro", 4).alias("f1_macro"),
            F.round("eer", 4).alias("eer"), F.lit(round(took, 2)).alias("fit_seconds")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def permutation_importance(model, valid: DataFrame, id_col: str, vector: str,
                           names: Sequence[str], label: str = "y",
                           seed: int = K.SEED) -> DataFrame:
    """Loss of macro F1 when one feature at a time is shuffled between rows.

    ``vector`` is the array column of the features. Rows are paired at random
    once, by their places in two hash orders; then each feature in turn takes
    its partner's value. All features are scored in one job.
    """
    rows = valid.select(id_col, label, F.col(vector).alias("_own"))
    # places are worked out on ids alone; each vector is then fetched twice
    ids = valid.select(id_col)
    mine = hash_positions(ids, id_col, seed, name="_place")
    theirs = hash_positions(ids, id_col, seed + 1, name="_place").withColumnRenamed(id_col, "_partner")
    pairs = mine.join(theirs, "_place").drop("_place")
    paired = rows.join(pairs, id_col).join(
        rows.select(F.col(id_col).alias("_partner"), F.col("_own").alias("_other")), "_partner")
    which = F.col("_j")
    swapped = F.transform(F.col("_own"), lambda v, i: F.when(
        i == which, F.element_at("_other", i + 1)).otherwise(v))
    tried = paired.select(
        label, F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("_j"),
        "_own", "_other").select(label, "_j", from_array_expr(swapped).alias("features"))
    scored = with_scores(model, tried)
    per_feature = E.confusion_metrics(scored, label, "predicted", ["_j"])
    whole = per_feature.where(which == -1).agg(F.first("f1_macro")).scalar()
    name = F.element_at(F.array(*[F.lit(n) for n in names]), which + 1)
    return per_feature.where(which >= 0).select(
        name.alias("feature"), (whole - F.col("f1_macro")).alias("f1_loss"))


def from_array_expr(values: Column) -> Column:
    return array_to_vector(F.transform(values, lambda v: v.cast("double")))


def random_search(train: DataFrame, fold: str, folds: int, draws: int,
                  space: dict[str, Sequence], label: str = "y", seed: int = K.SEED,
                  trees: int = 100, depth: int = 30, parallelism: int = 4) -> DataFrame:
    """Mean cross-validated ROC area of random draws from a parameter space.

    Folds come from a column, so every draw sees the same stratified folds. Draws of parameters in ``APART`` are
    grown and scored together, fold by fold, ``parallelism`` folds at once; others go through MLlib's validator.
    """
    model = forest(trees=trees, depth=depth, seed=seed, label=label)
    rng = random.Random(seed)
    names = sorted(space)
    combos = 1
    for n in names:
        combos *= len(space[n])
    seen: dict[tuple, None] = {}
    while len(seen) < min(draws, combos):
        seen.setdefault(tuple(rng.choice(list(space[n])) for n in names))
    grid = []
    for drawn in seen:
        builder = ParamGridBuilder()
        for n, v in zip(names, drawn):
            builder = builder.addGrid(model.getParam(n), [v])
        grid += builder.build()
    if set(names) <= APART:
        areas = _fold_areas(train, fold, folds, [model.copy(g) for g in grid], label, parallelism)
    else:
        areas = CrossValidator(
            estimator=model, estimatorParamMaps=grid, numFolds=folds, foldCol=fold,
            evaluator=BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability"),
            parallelism=parallelism, seed=seed).fit(train).avgMetrics
    rows = [({n: str(v) for n, v in zip(names, drawn)}, float(score))
            for drawn, score in zip(seen, areas)]
    return train.sparkSession.createDataFrame(
        rows, "params map<string,string>, mean_auc double").orderBy(F.desc("mean_auc"))


def _fold_areas(train: DataFrame, fold: str, folds: int, settings: Sequence[RandomForestClassifier], label: str,
                parallelism: int) -> list[float]:
    """The mean over the folds of each setting's ROC area on the rows that its forest did not see."""
    rows = train.persist()
    try:
        sizes = {r[fold]: r["count"] for r in rows.groupBy(fold).count().collect()}  # a row a fold
        for k in sizes:
            if k is None or not 0 <= k < folds:
                raise ValueError(f"fold {k} is not in the range 0 to {folds - 1}")
        for k in range(folds):
            if not sizes.get(k) or len(sizes) == 1:
                raise ValueError(f"fold {k} has no rows to learn from or to score")

        def areas(k: int) -> dict[int, float]:
            scored = materialise(held_out_scores(rows.where(F.col(fold) != k), rows.where(F.col(fold) == k), settings), "search")
            # a fold of one class has no area; MLlib counts 1 without negatives and 0 without positives
            one = scored.groupBy("setting").agg((F.max("y") > 0.5).cast("double").alias("_alone"))
            found = one.join(E.roc_auc(E.score_histogram(scored, "y", "score", ["setting"]), ["setting"]), "setting", "left")
            return {r["setting"]: r["area"] for r in found.select("setting", F.coalesce("auc_roc", "_alone").alias("area")).collect()}

        with ThreadPool(min(parallelism, folds)) as pool:
            every = pool.map(inheritable_thread_target(train.sparkSession)(areas), range(folds))
    finally:
        rows.unpersist()
    return [sum(found[i] for found in every) / folds for i in range(len(settings))]
