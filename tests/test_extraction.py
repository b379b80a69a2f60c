"""Extraction end to end: one pass from raw waves to rows, and runs that break off."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as X
from cohortlens.sources.tables import features_schema, holds_table
from cohortlens.storage import scratch_path
from cohortlens.streaming import incremental as I


def wave(seed, n):
    return [float(x) for x in np.random.default_rng(seed).normal(0, 0.2, n)]


@pytest.fixture(scope="module")
def waves(spark):
    data = [("noise", wave(1, 20_000)), ("half", [0.0] * 9600 + [math.sin(i / 3) for i in range(6400)]), ("silence", [0.0] * 16_000),
            ("short", wave(2, 100)), ("long", wave(3, 90_000)), ("empty", []), ("none", None), ("broken", [float("nan")] * 10),
            ("hole", [0.5, None, 0.25])]
    return spark.createDataFrame([(a, w, "spoof", 1) for a, w in data],
                                 "arquivo string, samples array<float>, label string, classe_binaria int")


def test_one_pass_equals_both_steps(waves):
    two = {r["arquivo"]: r for r in X.extract(X.prepare(waves), "arquivo", carry=["prop_fala"]).collect()}
    one = {r["arquivo"]: r for r in X.extract_raw(waves, "arquivo", carry=["label", "classe_binaria"]).collect()}
    assert set(one) == set(two)
    for name in ("noise", "half", "silence", "short", "long"):
        assert one[name]["erro"] is None and one[name]["label"] == "spoof"
        for c in ("prop_fala", *X.feature_names()):
            assert one[name][c] == pytest.approx(two[name][c], abs=1e-4), (name, c)
    for name in ("empty", "none", "broken", "hole"):
        assert one[name]["erro"].startswith("ValueError") and one[name]["mfcc1_media"] is None


def test_it_is_one_narrow_plan(waves):
    plan = X.extract_raw(waves, "arquivo")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_channels_are_mixed_down(spark):
    df = spark.createDataFrame([("two", [[1.0, 2.0] * 400, [3.0, 6.0] * 400]), ("odd", [[1.0], [1.0, 2.0]]), ("none", None)],
                               "arquivo string, samples array<array<float>>")
    one = {r["arquivo"]: r for r in X.extract_raw(df, "arquivo").collect()}
    two = X.extract(X.prepare(df.where("arquivo = 'two'")), "arquivo").first()
    assert one["two"]["mfcc1_media"] == pytest.approx(two["mfcc1_media"], abs=1e-4)
    assert "different lengths" in one["odd"]["erro"] and "empty" in one["none"]["erro"]


def test_a_run_that_breaks_off_keeps_what_was_done(spark):
    rows = [(f"LA_E_{i:03d}", wave(i, 600), "spoof", 1) for i in range(40)]
    source = spark.createDataFrame(rows, "arquivo string, samples array<float>, label string, classe_binaria int").repartition(8, "arquivo")
    features, errors = scratch_path(spark, "features"), scratch_path(spark, "errors")

    def extract(df):
        return X.extract_raw(df, "arquivo", carry=["label", "classe_binaria"], seconds=0.1)

    def killed(df):
        """Extraction, but the task that meets the last wave dies late."""
        def die(batches):
            import time
            for batch in batches:
                if "LA_E_039" in batch.column("arquivo").to_pylist():
                    time.sleep(8)
                    raise SystemError("killed")
                yield batch
        out = extract(df)
        return out.mapInArrow(die, out.schema)

    with pytest.raises(Exception, match="killed"):
        I.extract_pending(source, features, errors, killed, "arquivo")
    assert not holds_table(spark, features)
    schema = features_schema()
    kept = {r["arquivo"]: r["mfcc1_media"] for r in spark.read.schema(schema).parquet(features).collect()}
    assert 0 < len(kept) < 40 and "LA_E_039" not in kept
    seen = []

    def watched(df):
        seen.append({r["arquivo"] for r in df.select("arquivo").collect()})
        return extract(df)

    I.extract_pending(source, features, errors, watched, "arquivo")
    assert seen[0] == {r[0] for r in rows} - set(kept)
    done = spark.read.schema(schema).parquet(features)
    assert done.columns == schema.fieldNames() and len(done.columns) == 48
    assert done.count() == done.select("arquivo").distinct().count() == 40
    assert done.where(F.col("prop_fala").isNull()).count() == 0 and spark.read.parquet(errors).count() == 0
    I.extract_pending(source, features, errors, extract, "arquivo")
    assert spark.read.schema(schema).parquet(features).count() == 40
