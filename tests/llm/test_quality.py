import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import quality as Q
from cohortlens.llm.lines import NAMES, Lines, line_numbers

GOOD = "The river ran down past the old mill and on to the sea.\nNobody had been there for many years.\n"
BAD = "BUY NOW!! BUY NOW!! BUY NOW!!\n### $$$ click ### here $$$\n"


@pytest.fixture
def corpus(documents, labels):
    rows = [(i, (GOOD if i % 3 else BAD) * (1 + i % 4)) for i in range(60)]
    return documents(rows), labels([(i, int(i % 3 > 0), 0) for i in range(60)])


def test_learns_lines(corpus):
    docs, labels = corpus
    out = Q.classify(docs, labels).toPandas().set_index("doc_id")
    assert all(out.predicted[i] == int(i % 3 > 0) for i in range(60))
    assert all(out.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    assert out.score.between(0, 1).all()


def test_held_out_labels_are_not_read(corpus, labels):
    docs, own = corpus
    turned = labels([(i, int(i % 3 > 0) ^ (zlib.crc32(str(i).encode()) % 4 == 2), 0) for i in range(60)])
    a, b = (Q.classify(docs, x).toPandas().sort_values("doc_id") for x in (own, turned))
    assert np.allclose(a.score, b.score)


def test_odd_rows(corpus, documents):
    docs, labels = corpus
    more = documents([(100, None), (101, ""), (102, "\n\n\n"), (None, GOOD), (103, "x" * 300_000), (104, GOOD), (104, GOOD)])
    out = Q.classify(docs.unionByName(more), labels).toPandas()
    assert out.score.notna().all() and len(out) == 67
    kept = Q.keep_good(docs.unionByName(more), labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert Q.classify(documents([]), labels).count() == 0


def test_without_labels_nothing_is_rejected(corpus, labels):
    docs, _ = corpus
    assert Q.classify(docs, labels([])).where("score = 1 and predicted = 1").count() == 60
    assert Q.keep_good(docs, labels([])).count() == 60


def test_line_numbers_by_hand():
    lines = line_numbers(pa.array(["Ab cd cd.\n\nAb cd cd.", None, "#x 12!\n"]))
    assert list(lines.count) == [3, 1, 2] and list(lines.length) == [9, 0, 9, 0, 6, 0]
    f = {n: lines.features[:, i] for i, n in enumerate(NAMES)}
    assert list(f["repeated_line"]) == [0, 0, 1, 0, 0, 0]
    assert list(f["ends_in_point"]) == [1, 0, 1, 0, 0, 0]
    assert f["upper"][0] == np.float32(1 / 9) and f["digit"][4] == np.float32(2 / 6) and f["symbol"][4] == np.float32(1 / 6)
    same = line_numbers(pa.array(["to to the the end"])).features[0, NAMES.index("same_as_previous")]
    assert same == np.float32(2 / 5)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    count = np.array([3, 1, 4])
    lines = Lines(np.repeat([0, 1, 2], count), np.cumsum(count) - count, count, np.ones(8), np.zeros((8, len(NAMES))))
    good, moves = r.normal(size=8), r.normal(size=(2, 2))
    fore, back = Q.passes(good, lines, moves)
    odds = fore[:, 1] + back[:, 1] - fore[:, 0] - back[:, 0]
    for first, n in zip(lines.first, count):
        weight = np.zeros((n, 2))
        for code in range(2 ** n):
            path = [code >> i & 1 for i in range(n)]
            s = sum(good[first + i] for i in range(n) if path[i]) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            for i in range(n):
                weight[i, path[i]] += np.exp(s)
        assert np.allclose(odds[first:first + n], np.log(weight[:, 1] / weight[:, 0]))


def test_words_in_the_text_do_not_cross_documents():
    a, b = line_numbers(pa.array(["ab", "ab ab"])), line_numbers(pa.array(["ab ab"]))
    assert np.allclose(a.features[1], b.features[0]) and not re.search("x", "ab")


def test_what_comes_late_in_a_document_is_learnt(documents, labels):
    """The first 600 lines of every document are alike; the label follows from the lines after them."""
    head = "The river ran down past the old mill and on to the sea.\n" * 600
    rows = [(i, head + (GOOD if i % 2 else BAD) * 400) for i in range(40)]
    chain = Q.train(documents(rows), labels([(i, i % 2, 0) for i in range(40)]))
    score = {r["doc_id"]: r["score"] for r in Q.scored(documents([(0, GOOD * 5), (1, BAD * 5)]), chain).collect()}
    assert score[0] > 0.7 > 0.3 > score[1]


def test_an_id_on_a_third_of_the_rows_is_fitted_once(documents, labels):
    rows = [(i, GOOD) for i in range(20)] + [(3, BAD)] * 10
    picked = Q.fit_rows(documents(rows), labels([(i, 1, 0) for i in range(20)]), "quality", 100, 4, 2)
    counts = picked.groupBy("doc_id").count().collect()
    assert counts and all(r["count"] == 1 for r in counts) and 3 in {r["doc_id"] for r in counts}


def test_slopes_equal_differences():
    """The slope of one short document against the likelihood moved a little in each weight."""
    r = np.random.default_rng(2)
    block, y = r.normal(size=(5, len(NAMES))).astype(np.float32), np.array([1])
    k = 3 * len(NAMES) + 1
    theta = r.normal(size=k + 4) * 0.1

    def chain(t):
        return Q.Chain(np.zeros(len(NAMES)), np.ones(len(NAMES)), t[:k], t[k:].reshape(2, 2))

    def likelihood(t):
        lines = Lines(np.zeros(5, int), np.array([0]), np.array([5]), np.zeros(0), block)
        good = Q.with_neighbours(lines, np.zeros(len(NAMES)), np.ones(len(NAMES))) @ t[:k]
        fore, _ = Q.passes(good, lines, t[k:].reshape(2, 2))
        return (good.sum() + 4 * t[-1] - np.logaddexp(*fore[4])) / 5

    numeric = [(likelihood(theta + e) - likelihood(theta - e)) / 2e-5 for e in np.eye(k + 4) * 1e-5]
    assert np.allclose(Q.slopes([block], y, chain(theta)), numeric, atol=1e-6)
    first, size = Q.segments(np.array([1, 1200, 500]))
    assert list(first) == [0, 1, 501, 1001, 1201] and list(size) == [1, 500, 500, 200, 500]
