"""The exact tree on one feature against a search through every cut."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import single_feature as SF


def by_hand(rows, depth):
    """Leaf bounds by trying every cut of every node."""
    n = [sum(1 for _, y in rows if y == c) for c in (0, 1)]
    w = [len(rows) / (2 * c) for c in n]

    def cost(part):
        a, b = (w[c] * sum(1 for _, y in part if y == c) for c in (0, 1))
        return a * b / (a + b)

    def split(part, level):
        values = sorted({v for v, _ in part})
        if level == depth or len(values) < 2 or len({y for _, y in part}) < 2:
            return []
        at = min(range(len(values) - 1), key=lambda i: (
            cost([r for r in part if r[0] <= values[i]]) + cost([r for r in part if r[0] > values[i]]), i))
        cut = (values[at] + values[at + 1]) / 2
        return [cut, *split([r for r in part if r[0] <= cut], level + 1), *split([r for r in part if r[0] > cut], level + 1)]
    return sorted(split(rows, 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search_through_all_cuts(rows, seed):
    r = random.Random(seed)
    data = [(float(v), int(r.random() < (0.8 if 20 < v < 45 else 0.3))) for v in (r.randrange(80) for _ in range(400))]
    leaves = SF.grow(rows(data, "x double, y int"), "x", points=5).orderBy("leaf").collect()
    assert [row["low"] for row in leaves][1:] == pytest.approx(by_hand(data, 3))
    assert leaves[0]["low"] is None and leaves[-1]["high"] is None
    for row in leaves:
        part = [y for v, y in data if (row["low"] is None or v > row["low"]) and (row["high"] is None or v <= row["high"])]
        assert (row["n_0"], row["n_1"]) == (part.count(0), part.count(1))


def test_scores_of_rows(rows):
    table = rows([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (None, 1), (5.0, None)], "x double, y int")
    leaves = SF.grow(table, "x")
    assert [r["high"] for r in leaves.orderBy("leaf").collect()] == [2.5, None]
    new = SF.with_leaf_scores(rows([(2.5,), (2.6,), (None,)], "x double"), leaves, "x").collect()
    assert [(r["score"], r["predicted"]) for r in new] == [(0.0, 0), (1.0, 1), (None, None)]


def test_tables_that_cannot_be_split(rows):
    one = SF.grow(rows([(1.0, 1), (2.0, 1)], "x double, y int"), "x").collect()
    assert len(one) == 1 and one[0]["score"] == 1.0
    same = SF.grow(rows([(1.0, 1), (1.0, 0)], "x double, y int"), "x").collect()
    assert len(same) == 1 and same[0]["score"] == 0.5
    assert SF.grow(rows([], "x double, y int").where(F.lit(True)), "x").count() == 0
