"""Slot-based running totals and curves against brute force, with few slots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import correlate as C
from cohortlens.operators import evaluate as E
from cohortlens.operators import ordering as O
from cohortlens.operators import profile as P
from cohortlens.operators import shared as H


def brute_eer(y, s):
    """Curve by descending score, straight-line points dropped, first minimum."""
    y, s = np.asarray(y), np.asarray(s)
    cuts = np.unique(s)[::-1]
    tp = np.array([(y[s >= c] == 1).sum() for c in cuts])
    fp = np.array([(y[s >= c] == 0).sum() for c in cuts])
    if len(cuts) > 2:
        bend = (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0)
        keep = np.concatenate([[True], bend, [True]])
        tp, fp, cuts = tp[keep], fp[keep], cuts[keep]
    tpr = np.concatenate([[0], tp / (y == 1).sum()])
    fpr = np.concatenate([[0], fp / (y == 0).sum()])
    i = int(np.argmin(np.abs((1 - tpr) - fpr)))
    return (fpr[i] + (1 - tpr[i])) / 2, (None if i == 0 else cuts[i - 1])


def draw(seed, n, steps):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(int)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.25), 0, 1)
    if steps:
        s = np.round(s * steps) / steps
    group = np.where(rng.random(n) < 0.6, "A01", rng.choice(["A02", "A03", "A04"], n))
    return [(int(a), float(b), str(g)) for a, b, g in zip(y, s, group)]


SCORED = "y int, score double, grp string"


@pytest.mark.parametrize("seed, n, steps", [(1, 300, 0), (2, 300, 10), (3, 40, 3),
                                            (4, 500, 200), (5, 12, 0)])
def test_eer_and_areas(rows, seed, n, steps):
    data = draw(seed, n, steps)
    hist = E.score_histogram(rows(data, SCORED), "y", "score")
    want, at = brute_eer([d[0] for d in data], [d[1] for d in data])
    got = E.equal_error_rate(hist, points=7).first()
    assert got["eer"] == pytest.approx(want, abs=1e-12)
    assert got["eer_threshold"] == at
    pos = np.array([d[1] for d in data if d[0] == 1])[:, None]
    neg = np.array([d[1] for d in data if d[0] == 0])[None, :]
    auc = ((pos > neg).mean() + 0.5 * (pos == neg).mean())
    assert E.roc_auc(hist, points=7).first()["auc_roc"] == pytest.approx(auc, abs=1e-12)


@pytest.mark.parametrize("seed, n, steps", [(11, 400, 0), (12, 400, 12), (13, 60, 4),
                                            (14, 900, 300), (15, 200, 1)])
def test_shared_negatives_equal_full_pairing(rows, seed, n, steps):
    data = draw(seed, n, steps)
    got = {r["grp"]: (r["eer"], r["eer_threshold"]) for r in
           H.shared_negative_eer(rows(data, SCORED), "grp", "y", "score", points=15).collect()}
    names = {g for y, _, g in data if y == 1}
    assert set(got) == names
    for g in names:
        part = [(y, s) for y, s, h in data if y == 0 or h == g]
        want, at = brute_eer([p[0] for p in part], [p[1] for p in part])
        assert got[g][0] == pytest.approx(want, abs=1e-12)
        assert got[g][1] == at


def test_shared_negatives_far_from_a_bend(rows):
    """All steps alike around the crossing: the kept points lie many slots away."""
    data = [(1, 1000.0 - i, "A01") for i in range(200)]
    data += [(0, 600.0 - i, "-") for i in range(200)] + [(1, 5000.0 - i, "A02") for i in range(3)]
    got = {r["grp"]: r["eer"] for r in
           H.shared_negative_eer(rows(data, SCORED), "grp", "y", "score", points=31).collect()}
    for g in ("A01", "A02"):
        part = [(y, s) for y, s, h in data if y == 0 or h == g]
        assert got[g] == pytest.approx(brute_eer(*zip(*part))[0], abs=1e-12)


def test_one_class_group_has_no_rate(rows):
    df = rows([(1, 0.5, "a"), (1, 0.7, "a"), (0, 0.2, "b"), (1, 0.9, "b")], SCORED)
    df = df.withColumn("p", E.decide("score", 0.6))
    got = {r["grp"]: r for r in E.metrics_by_group(df, "grp", "y", "p", "score").collect()}
    assert got["a"]["eer"] is None and got["b"]["eer"] == 0.0
    # only the class that occurs counts towards the mean
    assert got["b"]["f1_macro"] == 1.0


def test_ties_at_the_threshold_are_accepted(rows):
    df = rows([(0, 0.5, ""), (1, 0.5, "")], SCORED)
    row = E.threshold_sweep(df, "y", "score", thresholds=[0.5]).first()
    assert (row["fp"], row["tp"]) == (1, 1)


def test_groups_add_up_to_the_whole(rows):
    df = rows(draw(21, 300, 0), SCORED).withColumn("p", E.decide("score", 0.5))
    whole = E.cells(df, "y", "p").first()
    parts = E.cells(df, "y", "p", ["grp"]).agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).first()
    assert whole.asDict() == parts.asDict()


@pytest.mark.parametrize("points", [1, 5, 1023])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_hot_group(rows, points, descending):
    rng = np.random.default_rng(3)
    data = [("hot" if i < 200 else f"g{i}", float(v), int(w)) for i, (v, w) in enumerate(
        zip(rng.permutation(260), rng.integers(1, 9, 260)))]
    hist = rows(data, "g string, v double, w long")
    out = O.running_totals(hist, "v", ["w"], ["g"], descending, points, follow=True).collect()
    assert len(out) == 260
    for r in out:
        same = sorted(((v, w) for g, v, w in data if g == r["g"]), reverse=descending)
        i = [v for v, _ in same].index(r["v"])
        assert r["cum_w"] == sum(w for _, w in same[:i + 1])
        assert r["total_w"] == sum(w for _, w in same)
        assert r["next_w"] == (same[i + 1][1] if i + 1 < len(same) else None)


def test_quantiles(rows):
    rng = np.random.default_rng(5)
    data = [("a", float(v)) for v in np.round(rng.normal(0, 3, 501), 1)] + [("b", 4.0)]
    got = {r["g"]: r["quantiles"] for r in O.exact_quantiles(
        rows(data, "g string, v double"), "v", [0.25, 0.5, 0.9], ["g"], points=9).collect()}
    want = np.quantile([v for g, v in data if g == "a"], [0.25, 0.5, 0.9])
    assert got["a"] == pytest.approx(list(want)) and got["b"] == [4.0, 4.0, 4.0]


def test_describe_matches_its_sketch_on_small_data(rows):
    df = rows([("a", float(i)) for i in range(101)], "g string, v double")
    exact = P.describe(df, "v", ["g"]).first()
    sketch = P.describe(df, "v", ["g"], approximate=True).first()
    assert exact.asDict() == sketch.asDict()


def test_describe_leaves_out_missing_values(rows):
    df = rows([(1.0,), (3.0,), (None,), (float("nan"),)], "v double")
    row = P.describe(df, "v").first()
    assert (row["count"], row["mean"], row["p50"], row["max"]) == (2, 2.0, 2.0, 3.0)


def test_previous_row_across_slots(rows):
    data = [("hot", i, i * 10) for i in range(50)] + [("b", 100, 1), ("b", 101, 2)]
    out = O.previous_in_order(rows(data, "g string, t long, v long"), ["g"], ["t"],
                              F.col("v"), points=7).collect()
    got = {(r["g"], r["t"]): r["previous"] for r in out}
    assert got[("hot", 0)] is None and got[("b", 100)] is None and got[("b", 101)] == 1
    assert all(got[("hot", i)] == (i - 1) * 10 for i in range(1, 50))


def test_spearman_equals_pandas(rows):
    import pandas as pd
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"a": rng.integers(0, 5, 80), "b": rng.normal(size=80)})
    frame["c"] = frame["a"] * 2 + frame["b"]
    df = rows([tuple(map(float, r)) for r in frame.itertuples(index=False)],
              "a double, b double, c double")
    ranks = frame.rank()
    got = {(r["a"], r["b"]): r["r"] for r in
           C.spearman_matrix(df, ["a", "b", "c"]).collect()}
    for x in "abc":
        for y in "abc":
            assert got[(x, y)] == pytest.approx(ranks[x].corr(ranks[y]))


def test_many_columns_take_several_passes(rows):
    names = [f"c{i}" for i in range(8)]
    rng = np.random.default_rng(9)
    df = rows([tuple(map(float, r)) for r in rng.normal(size=(30, 8))],
              ", ".join(f"{n} double" for n in names))
    assert C.pearson_matrix(df, names).count() == 64


def test_rare_groups_pair_nothing(spark, monkeypatch):
    """With one row per group the stored tables stay near negatives + positives."""
    sizes = []
    keep = H.materialise

    def counted(df, name="step"):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(H, "materialise", counted)
    neg = spark.range(3000).select(F.lit(0).alias("y"), F.lit("-").alias("grp"), (F.xxhash64("id") % 1000003).cast("double").alias("score"))
    pos = spark.range(40).select(F.lit(1).alias("y"), F.concat(F.lit("g"), F.col("id")).alias("grp"),
                                 (F.xxhash64("id", F.lit(1)) % 1000003).cast("double").alias("score"))
    table = neg.unionByName(pos)
    out = {r["grp"]: r["eer"] for r in H.shared_negative_eer(table, "grp", "y", "score").collect()}
    assert sum(sizes) <= 2 * 3000 + 4 * 40
    negatives = sorted((r["score"] for r in neg.collect()), reverse=True)
    for r in pos.collect():
        above = sum(s > r["score"] for s in negatives) / len(negatives)
        # one positive: missed until it is reached, then the false alarms above it
        assert out[r["grp"]] == pytest.approx(min((abs(x - f), (f + x) / 2) for f, x in (
            (0, 1), (above, 1), (above, 0), (1 / 3000 if above else 0, 1), (1, 0)))[1], abs=1e-3)


def test_slots_are_found_without_interpreted_functions(spark, rows):
    hist = rows([(None, 0)] + [(float(v), v % 3) for v in range(-5, 400)] + [(float("nan"), 1), (float("inf"), 2)],
                "value double, n long")
    cut = O.with_slots(hist, "value", ["n"], points=100)
    points = O.split_points(hist, "value", ["n"], points=100).scalar()
    want = hist.select("value", O.slot_of(F.col("value"), points, 100).alias("_slot"))
    assert sorted(map(str, cut.select("value", "_slot").collect())) == sorted(map(str, want.collect()))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
