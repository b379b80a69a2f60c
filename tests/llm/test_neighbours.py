import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import neighbours as V


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def brute(rows, k, step):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in good:
        if i % step == 0:
            scored = sorted({(-float((x * q).sum()), j) for j, x in good if j != i})
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.fixture
def vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + r.normal(size=16) * 0.7).tolist()) for i in range(600)]
    return rows + [(1000 + i, rows[3][1]) for i in range(60)] + [(2000 + i, (3.0 * np.array(rows[i][1])).tolist()) for i in range(20)]


def test_recall_and_scores(spark, vectors):
    out = V.nearest(table(spark, vectors), F.col("vec_id") % 20 == 0, 20).toPandas()
    want = brute(vectors, 20, 20)
    assert set(out.query_id) == set(want)
    hits = 0
    for q, mine in out.groupby("query_id"):
        mine = mine.sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id)
        assert list(mine.score) == sorted(mine.score, reverse=True)
        exact = dict(brute(vectors, 10 ** 6, q or 20)[q]) if q in (0, 20) else dict(want[q])
        assert all(abs(exact[v] - s) < 1e-9 for v, s in zip(mine.vec_id, mine.score) if v in exact)
        hits += len({v for v, _ in want[q]} & set(mine.vec_id))
    assert hits / (20 * len(want)) >= 0.9


def test_ties_go_to_the_smaller_id_and_copies_count(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 90)] + [(200, [0.0, 1.0])]
    out = V.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20).toPandas().sort_values(["query_id", "rank"])
    assert list(out[out.query_id == 0].vec_id) == list(range(1, 21))
    assert list(out[out.query_id == 20].vec_id) == list(range(0, 20))
    assert list(out[out.query_id == 200].vec_id) == list(range(0, 20))


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, None]),
            (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (40, None)]
    out = V.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 5).toPandas()
    assert sorted(map(tuple, out[["query_id", "rank", "vec_id", "score"]].values)) == [
        (0, 1, 1, 4.0), (0, 2, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0)]


def test_empty_tables(spark):
    assert V.nearest(table(spark, []), F.lit(True)).count() == 0
    assert V.nearest(table(spark, [(1, None)]), F.lit(True)).count() == 0
    assert V.nearest(table(spark, [(1, [1.0]), (2, [2.0])]), F.lit(False)).count() == 0


def test_windows_that_cover_all_find_all(monkeypatch):
    monkeypatch.setattr(V, "FEW", 0)
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    for q, (places, scores) in zip(x[:5], V.block_search(x, x[:5], 10, V.Search(verified=1.0))):
        assert list(places) == list(np.argsort(-(x @ q), kind="stable")[:10])


def test_recall_of_large_blocks_of_unlike_lengths():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 24)) * r.lognormal(0, 0.5, size=(6000, 1))
    queries = r.normal(size=(40, 24))
    want = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    got = [set(places) for places, _ in V.block_search(x, queries, 20, V.Search())]
    assert np.mean([len(g & set(w)) / 20 for g, w in zip(got, want)]) >= 0.9
