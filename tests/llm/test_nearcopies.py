import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import nearcopies as N
from cohortlens.llm.components import components
from cohortlens.llm.shingles import parities, set_number, shingle_sets


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_hand(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def made(seed):
    """Texts of many sizes, with copies that differ in none to many words, chains and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows, n = [], 0
    for size in (1, 2, 3, 4, 6, 9, 12, 13, 14, 21, 30, 45, 80, 150, 300):
        for _ in range(2):
            text = [r.choice(vocabulary) for _ in range(size)] + (passage if r.random() < 0.3 else [])
            for copy in range(5):
                rows.append((n, " ".join(text) if copy else " ".join(text).upper()))
                n += 1
                for _ in range(r.choice([0, 1, 1, 2, 4])):
                    text = list(text)
                    text[r.randrange(len(text))] = r.choice(vocabulary)
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_equals_comparing_all(documents, k, percent, seed):
    rows = made(seed) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (1005, "É one"), (1006, "é one")]
    out = N.link_documents(documents(rows), k, percent).toPandas()
    want = by_hand(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == want


def test_repeated_rows_and_null_ids(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, "x y z"), (7, "q r s"), (9, "q r s")]
    docs = documents(rows)
    out = N.link_documents(docs, 3, 90).toPandas()
    assert len(out) == 7 and out[out.doc_id.isna()].component_id.isna().all()
    assert out[out.doc_id.isin([3, 5])].component_id.eq(3).all() and out[out.doc_id.isin([7, 9])].component_id.eq(7).all()
    kept = N.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in kept.collect()) == [
        (-1, "a b c d e f"), (3, "a b c d e f"), (7, "q r s")]
    assert N.link_documents(documents([])).count() == 0 and N.keep_one(documents([])).count() == 0


def test_hot_group_of_near_copies(documents):
    r = random.Random(4)
    text = [f"v{r.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(300):
        mine = list(text)
        for _ in range(r.choice([1, 2, 3, 8])):
            mine[r.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(mine)))
    out = N.link_documents(documents(rows), 3, 90).toPandas()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.itertuples()} == by_hand(rows, 3, 90)


def test_copies_read_before_the_standing_document_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(N, "FILTER_BITS", 64)  # nearly every copy passes by accident
    texts = []
    for group in range(20):
        text = [f"g{group}w{i}" for i in range(40)]
        texts += [" ".join(text)] * 6 + [" ".join(text[:-1] + ["other"])] * 6
    rows = list(enumerate(texts))[::-1]
    out = N.link_documents(documents(rows).coalesce(1), 3, 90).toPandas()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.itertuples()} == by_hand(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    bands = N.Bands(percent)
    for size in [1, 2, 3, 5, 8, 10, 13, 19, 20, 27, 40, 64, 100, 250, 900]:
        for _ in range(12):
            x = np.unique(r.integers(1, 2 ** 63, size, dtype=np.uint64))
            out = int(r.integers(0, size + 1))
            while True:
                extra = int(r.integers(0, size + 1))
                y = np.unique(np.r_[x[out:], r.integers(1, 2 ** 63, extra, dtype=np.uint64)])
                same = size - out
                if 100 * same >= percent * (size + extra):
                    break
                out = max(0, out - 1) if r.random() < 0.5 else out
                if out == 0 and size == 1:
                    y, extra = x, 0
                    break
            if len(y) and not np.array_equal(x, y):
                assert set(N.signatures(x, bands)) & set(N.signatures(y, bands))
            assert np.unpackbits((parities(x) ^ parities(y)).view(np.uint8)).sum() <= out + extra


def test_sets_equal_python_sets():
    texts = ["a b c a b c", None, "", "One two", "x" * 5000 + " y", "A\x0bB\x1cC  d"]
    assert [len(s) for s in shingle_sets(pa.array(texts), 3)] == [len(shingles(t, 3)) for t in texts]
    a, b = shingle_sets(pa.array(["The END of it all", "the end OF it all"]), 3)
    assert set_number(a) == set_number(b)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 140))
    assert out[301] == 300 and 200 not in out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_turns_share_out_all_signatures(documents):
    docs = documents(made(5))
    whole = sorted(N.signature_rows(docs, 5, 80).distinct().collect())
    parts = [N.signature_rows(docs, 5, 80, t, 3).distinct().collect() for t in range(3)]
    assert sorted(sum(parts, [])) == whole and all(0 < len(p) < len(whole) / 2 for p in parts)
    one, three = (sorted(N.link_documents(docs, 5, 80, t).collect()) for t in (1, 3))
    assert one == three


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_only_doubtful_rows_are_joined(documents, monkeypatch, bits):
    monkeypatch.setattr(N, "FILTER_BITS", bits)
    rows = made(6) + [(2000, ""), (2000, "a b c d e f g"), (2001, "a b c d e f g"), (2001, "p q"), (2002, None), (2002, None)]
    docs = documents(rows + [(None, "a b"), (None, None)])
    joined = []
    keep = type(docs).join

    def join(self, other, on=None, how=None):
        if how == "left_semi" and "text" in self.columns:
            joined.append(self.count())
        return keep(self, other, on, how)

    linked = N.link_documents(docs, 5, 80).where("doc_id = component_id").groupBy("doc_id").count().collect()
    monkeypatch.setattr(type(docs), "join", join)
    out = N.keep_one(docs, 5, 80).collect()
    times = {r["doc_id"]: r["count"] for r in linked}
    want = sorted([(i, t or "") for i, t in rows if times.get(i) == 1]
                  + [(i, min(t or "" for j, t in rows if j == i)) for i, n in times.items() if n > 1])
    assert sorted((r["doc_id"], r["text"] or "") for r in out if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in out) == 2
    if bits > 64:
        gone = sum(times.get(i) != 1 for i, _ in rows)
        assert joined and all(n == gone for n in joined)
