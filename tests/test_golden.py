"""Published numbers that follow from published counts by arithmetic."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import decisions as D
from cohortlens.operators import evaluate as E
from cohortlens.operators import profile as P
from cohortlens.operators import split as S

CELLS = "tn long, fp long, fn long, tp long"
CODECS = ["alaw", "ulaw", "gsm", "pstn", "g722", "opus", "none"]


def test_baseline_report(rows):
    m = D.with_metrics(rows([(280, 2488, 3, 24464)], CELLS)).first()
    expected = {
        "accuracy": 0.9085368092527997, "precision_1": 0.9076877411694865,
        "recall_1": 0.9998773858666775, "f1_1": 0.9515548727124215,
        "precision_0": 0.9893992932862191, "recall_0": 0.10115606936416185,
        "f1_0": 0.18354637823664371, "f1_macro": 0.5675506254745326,
        "baseline_accuracy": 0.8983660730677437}
    for name, value in expected.items():
        assert m[name] == pytest.approx(value, abs=1e-15), name


def test_leak_tree_macro_f1(rows):
    m = D.with_metrics(rows([(2267, 184, 5473, 16779)], CELLS)).first()
    assert round(m["f1_macro"], 4) == 0.6503


def test_attack_f1(rows):
    cells = rows([(280, 2488, 0, 1846)], CELLS)
    assert round(D.with_metrics(cells).first()["f1_1"], 4) == 0.5974


@pytest.mark.parametrize("r0, r1, f1", [
    (0.0, 1.0, 0.4732), (0.0921, 0.9999, 0.5598), (0.3475, 0.9942, 0.7291),
    (0.5770, 0.9575, 0.7730), (0.9682, 0.4574, 0.4562)])
def test_sweep_macro_f1(rows, r0, r1, f1):
    tn, tp = round(r0 * 2768), round(r1 * 24467)
    cells = rows([(tn, 2768 - tn, 24467 - tp, tp)], CELLS)
    assert D.with_metrics(cells).first()["f1_macro"] == pytest.approx(f1, abs=2e-4)


def test_split_sizes(rows):
    slots = rows([("0", "a", 18452), ("1", "a", 163114)],
                 "stratum string, _slot string, _n long")
    parts = [("treino", 0.70), ("validacao", 0.15), ("teste", 0.15)]
    got = {r["stratum"]: (r["_part0"], r["_part1"], r["_part2"])
           for r in S.split_sizes(slots, parts).collect()}
    assert got == {"0": (12916, 2768, 2768), "1": (114180, 24467, 24467)}


def _population(spark):
    """Seven codecs of 2,636 and 23,302 rows."""
    codec = F.element_at(F.array(*[F.lit(c) for c in CODECS]),
                         (F.col("id") / 25938).cast("int") + 1)
    return spark.range(7 * 25938).select(
        codec.alias("codec"),
        F.when(F.col("id") - F.floor(F.col("id") / 25938) * 25938 < 2636, "bonafide")
        .otherwise("spoof").alias("label"))


def test_composition_by_codec(spark):
    got = {(r["codec"], r["n"], r["pct"]) for r in
           P.frequency_table(_population(spark), "codec").collect()}
    assert got == {(c, 25938, 14.29) for c in CODECS}


def test_composition_by_codec_and_label(spark):
    wide = P.crosstab_wide(_population(spark), "codec", "label", ["bonafide", "spoof"])
    got = {tuple(r) for r in wide.collect()}
    assert got == {(c, 2636, 23302, 25938) for c in CODECS} | {("All", 18452, 163114, 181566)}


def test_phase_and_trim_imply_each_other(rows):
    df = rows([("eval", "notrim"), ("hidden", "only_speech"), ("progress", "notrim")],
              "fase string, trim string")
    out = P.mutual_implication(df, F.col("fase") == "hidden", F.col("trim") == "only_speech")
    assert out.first()["equivalent"] is True


def test_band_means(rows):
    by_codec = rows([
        ("alaw", "estreita", 0.6743, 0.2422, 0.1373), ("ulaw", "estreita", 0.6668, 0.2333, 0.1467),
        ("gsm", "estreita", 0.4806, 0.0053, 0.2268), ("pstn", "estreita", 0.4734, 0.0, 0.2684),
        ("g722", "larga", 0.5571, 0.0909, 0.1335), ("opus", "larga", 0.4888, 0.0153, 0.1838),
        ("none", "larga", 0.5785, 0.1132, 0.1161)],
        "codec string, banda string, f1_macro double, recall_0 double, eer double")
    got = {r["banda"]: (round(r["f1_macro"], 4), round(r["recall_0"], 4), round(r["eer"], 4))
           for r in E.band_means(by_codec, "banda", ["f1_macro", "recall_0", "eer"]).collect()}
    assert got == {"estreita": (0.5738, 0.1202, 0.1948), "larga": (0.5415, 0.0731, 0.1445)}
    ordered = P.in_report_order(by_codec.select("codec"), "codec", CODECS)
    assert [r["codec"] for r in ordered.collect()] == CODECS


def test_saturation(rows):
    curve = rows([(5000, 0.4758), (10000, 0.482), (20000, 0.4911), (40000, 0.508),
                  (80000, 0.5375), (127096, 0.5676)], "n_train long, f1_macro double")
    got = E.saturation_point(curve).first()
    assert (got["saturates_at"], got["saturated"]) == (127096, False)


def test_correlations_flagged(rows):
    from cohortlens.operators.correlate import strong_pairs
    m = rows([("pearson", "a", "b", 0, 1, 0.41), ("pearson", "b", "a", 1, 0, 0.41),
              ("pearson", "a", "c", 0, 2, 0.013)],
             "method string, a string, b string, a_idx int, b_idx int, r double")
    assert [(r["a"], r["b"]) for r in strong_pairs(m).collect()] == [("a", "b")]
