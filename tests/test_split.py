"""Splits, folds and samples: exact, complete and independent of layout."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import audit as A
from cohortlens.operators import split as S


@pytest.fixture(scope="module")
def people(spark):
    """Two thirds of the rows in one stratum, plus strata of one and nine rows."""
    kind = (F.when(F.col("id") < 800, "big").when(F.col("id") < 1190, "mid")
            .when(F.col("id") < 1199, "nine").otherwise("one"))
    return spark.range(1200).select("id", kind.alias("kind"), (F.col("id") > 100).cast("int")
                                    .alias("y"))


def parts_of(df):
    return {r["id"]: r["conjunto"] for r in df.select("id", "conjunto").collect()}


def test_split_is_a_partition_of_exact_size(people):
    out = S.stratified_split(people, "id", ["kind"])
    got = parts_of(out)
    assert len(got) == out.count() == 1200
    sizes = {p: list(got.values()).count(p) for p in ("treino", "validacao", "teste")}
    assert sizes == {"treino": 840, "validacao": 180, "teste": 180}
    big = {r["conjunto"]: r["count"] for r in
           out.where("kind = 'big'").groupBy("conjunto").count().collect()}
    assert big == {"treino": 560, "validacao": 120, "teste": 120}


@pytest.mark.parametrize("partitions", [1, 13])
def test_split_ignores_layout(people, partitions):
    shuffled = people.orderBy(F.rand(7)).repartition(partitions)
    assert parts_of(S.stratified_split(people, "id", ["kind"])) == \
        parts_of(S.stratified_split(shuffled, "id", ["kind"]))


def test_hash_digits_do_not_change_the_split(people):
    assert parts_of(S.stratified_split(people, "id", ["kind"], digits=1)) == \
        parts_of(S.stratified_split(people, "id", ["kind"], digits=4))


def test_seed_changes_the_split(people):
    a, b = (parts_of(S.stratified_split(people, "id", ["kind"], seed=s)) for s in (1, 2))
    assert a != b


def test_many_strata_join_by_shuffle(people, monkeypatch):
    want = parts_of(S.stratified_split(people, "id", ["kind"]))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert parts_of(S.stratified_split(people, "id", ["kind"])) == want


def test_proportions_must_add_up(people):
    with pytest.raises(ValueError, match="add up to 1"):
        S.stratified_split(people, "id", ["kind"], [("a", 0.7), ("b", 0.2)])


def test_two_and_four_parts(people):
    two = parts_of(S.stratified_split(people, "id", ["y"], [("a", 0.5), ("b", 0.5)]))
    assert list(two.values()).count("a") == 600
    four = parts_of(S.stratified_split(
        people, "id", ["y"], [("a", 0.25), ("b", 0.25), ("c", 0.25), ("d", 0.25)]))
    assert {v: list(four.values()).count(v) for v in "abcd"} == dict.fromkeys("abcd", 300)


def test_empty_table(people):
    assert S.stratified_split(people.limit(0), "id", ["kind"]).count() == 0


def test_folds_are_even(people):
    folds = S.stratified_folds(people, "id", ["kind"], 5)
    for kind in ("big", "mid", "nine", "one"):
        sizes = [r["count"] for r in
                 folds.where(F.col("kind") == kind).groupBy("fold").count().collect()]
        assert sum(sizes) == people.where(F.col("kind") == kind).count()
        assert max(sizes) - (min(sizes) if len(sizes) == 5 else 0) <= 1
    assert folds.select("fold").distinct().count() == 5


def test_samples_have_exact_sizes_and_nest(people):
    out = S.sized_samples(people, "id", ["kind"], [120, 600, None])
    ids = {n: {r["id"] for r in out.where(F.col("sample_rows").eqNullSafe(F.lit(n))).collect()}
           for n in (120, 600, None)}
    assert {n: len(v) for n, v in ids.items()} == {120: 120, 600: 600, None: 1200}
    assert ids[120] <= ids[600]


def test_a_sample_larger_than_the_table_is_refused(people):
    """It used to be the whole table under the wrong name."""
    with pytest.raises(ValueError, match="5000 rows"):
        S.stratified_sample(people, "id", ["kind"], 5000)
    assert S.stratified_sample(people, "id", ["kind"], 1200).count() == 1200


def test_strata_with_missing_and_joining_values_stay_apart(rows):
    table = rows([(i, *[("a_b", "c"), ("a", "b_c"), (None, "a"), ("a", None)][i % 4]) for i in range(80)],
                 "id int, left string, right string")
    out = S.stratified_split(table, "id", ["left", "right"], [("x", 0.5), ("y", 0.5)])
    assert [r["count"] for r in out.groupBy("left", "right", "conjunto").count().collect()] == [10] * 8


def test_rare_strata_are_merged(people):
    named = people.withColumn("stratum", F.col("kind"))
    got = {r["stratum"]: r["count"] for r in
           S.collapse_rare(named, "stratum").groupBy("stratum").count().collect()}
    assert got == {"big": 800, "mid": 390, "outros": 10}


def test_leave_one_group_out(people):
    out = S.leave_one_group_out(people, "kind", F.col("y") == 0, "mid", "id")
    own = {(r["kind"], r["conjunto"]) for r in out.where("y = 1").collect()}
    assert own == {("big", "train"), ("mid", "test"), ("nine", "train"), ("one", "train")}
    assert out.where("y = 0 and conjunto = 'test'").count() == 31   # of 101, 70 train


def test_overlap_and_conformity(people):
    out = S.stratified_split(people, "id", ["kind"])
    shared = {r["key"]: r["n_shared"] for r in
              A.split_overlap(out, "conjunto", ["kind", "id"]).collect()}
    assert shared["id"] == 0 and shared["kind"] >= 3
    total = S.split_conformity(out, "conjunto", "y").where("conjunto = 'TOTAL'").first()
    assert (total["total"], total["n_0"], total["n_1"]) == (1200, 101, 1099)
