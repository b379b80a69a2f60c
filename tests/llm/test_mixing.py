import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, p double, kept string, tokens int"


@pytest.fixture
def docs(spark):
    rows = []
    for i in range(900):
        source = "big" if i % 3 else f"s{i % 5}"
        text = ["plain words here", "a | b | c", "licensed under terms", ""][i % 4] + " more" * (i % 7)
        rows.append((i, text, ["en", "de", None][i % 11 % 3], source, 0.5, "x", 1))
    return spark.createDataFrame(rows + [(900, None, None, "big", 0.1, "y", 2), (None, "one two", "en", "big", 0.1, "z", 3)], SCHEMA)


def shares(frame, weight, margin):
    total = (frame[weight] * frame.n_tokens).groupby(frame[margin].fillna("-")).sum()
    return (total / total.sum()).to_dict()


def flat(docs, targets=None):
    return M.mix(docs, targets)[1].select(F.col("_row.doc_id").alias("doc_id"), "_cell.*", F.col("_tokens").alias("n_tokens"), "p", "kept").toPandas()


def test_expected_tokens_have_the_target_shares(docs):
    frame = flat(docs)
    frame["one"] = 1.0
    for margin in M.MARGINS:
        have, made = shares(frame, "one", margin), shares(frame, "p", margin)
        even = {v: s ** M.EVEN[margin] for v, s in have.items()}
        assert made == pytest.approx({v: s / sum(even.values()) for v, s in even.items()}, abs=1e-5)
    assert frame.p.max() == pytest.approx(1) and frame.p.min() > 0 and len(frame) == 902
    drawn = frame[frame.kept]
    assert abs(drawn.n_tokens.sum() / (frame.p * frame.n_tokens).sum() - 1) < 0.15


def test_same_as_raking_by_hand(docs):
    raked, _ = M.mix(docs)
    cells = raked.toPandas().fillna("-")
    start = cells.tokens / cells.tokens.sum()
    target = {m: (start.groupby(cells[m]).sum() ** M.EVEN[m]) for m in M.MARGINS}
    w = start.copy()
    for _ in range(200):
        for m in M.MARGINS:
            w *= cells[m].map(target[m] / target[m].sum() / w.groupby(cells[m]).sum())
    assert list(cells.weight) == pytest.approx(list(w), abs=1e-5)


def test_a_rare_row_does_not_shrink_the_sample(docs, spark):
    rare = spark.createDataFrame([(5000, "x", "xx", None, 0.0, "k", 1)], SCHEMA)
    frame = flat(docs.unionByName(rare))
    assert frame.p.mean() > 1 / M.MOST and frame[frame.doc_id == 5000].p.iloc[0] == 1


def test_rare_values_reach_their_targets(docs, spark):
    rare = [(6000 + i, "one two three", "xx" if i % 2 else "en", "tiny" if i % 3 else "big", 0.0, "k", 1) for i in range(6)]
    whole = docs.unionByName(spark.createDataFrame(rare + [(900, None, None, None, 0.1, "y", 2)], SCHEMA))
    frame = flat(whole)
    frame["one"] = 1.0
    for margin in M.MARGINS:
        have, made = shares(frame, "one", margin), shares(frame, "p", margin)
        even = {v: s ** M.EVEN[margin] for v, s in have.items()}
        assert made == pytest.approx({v: s / sum(even.values()) for v, s in even.items()}, abs=1e-5)
    wanted = {"tiny": 0.2, "big": 0.5} | {f"s{i}": 0.06 for i in range(5)}
    targets = spark.createDataFrame([("source", v, s) for v, s in wanted.items()], "margin string, value string, share double")
    made = shares(flat(whole.where("source is not null"), targets), "p", "source")
    assert made == pytest.approx(wanted, abs=1e-5)


def test_a_bound_is_asked_for_and_what_it_leaves_open_is_told(docs, spark, caplog):
    wanted = {"s0": 0.6, "big": 0.2} | {f"s{i}": 0.05 for i in range(1, 5)}
    targets = spark.createDataFrame([("source", v, s) for v, s in wanted.items()], "margin string, value string, share double")
    raked, _ = M.mix(docs, targets, most=1.5)
    cells = raked.toPandas()
    assert (cells.weight <= 1.5 * cells.tokens / cells.tokens.sum() + 1e-9).all()
    assert "source 's0'" in caplog.text
    settled = M.settled_targets(M.cells(M.celled(docs)), targets)
    left = {(r["margin"], r["value"]): r for r in M.unmet(raked, settled).collect()}
    reached = cells.weight[cells.source == "s0"].sum() / cells.weight.sum()
    assert left["source", "s0"]["share"] == pytest.approx(0.6) and left["source", "s0"]["reached"] == pytest.approx(reached)


def test_own_targets(docs, spark):
    targets = spark.createDataFrame([("source", "big", 0.3), ("source", "absent", 0.5), ("lang", "en", 0.6), ("lang", "de", 0.2)],
                                    "margin string, value string, share double")
    frame = flat(docs, targets)
    frame["one"] = 1.0
    have, made = shares(frame, "one", "lang"), shares(frame, "p", "lang")
    assert made["-"] == pytest.approx(have["-"], abs=1e-5)
    assert made["en"] / made["de"] == pytest.approx(3, abs=1e-3)


def test_sample_keeps_rows_whole_and_is_the_same_each_time(docs):
    a, b = M.sample(docs), M.sample(docs.repartition(7))
    assert a.columns == docs.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    twice = M.sample(docs.unionByName(docs))
    assert twice.count() == 2 * twice.distinct().count()
    assert M.sample(docs.limit(0)).count() == 0
