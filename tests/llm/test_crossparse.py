import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import crossparse as C
from cohortlens.llm.tables import table


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def by_hand(text, learned):
    """Phrases of the longest-match parse, one byte at least each."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i:i + size + 1] in learned and text[i:i + size] in learned:
            size += 1
        i, n = i + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_equal_a_plain_parse(seed):
    rng = random.Random(seed)
    alphabet = "ab " if seed % 2 else "abcdefgh é"
    blocks = ["".join(rng.choices(alphabet, k=rng.randint(1, 300))).encode() for _ in range(5)]
    model = C.build(blocks)
    learned = b"\0".join(C.LETTERS[np.frombuffer(b, np.uint8)].tobytes() for b in blocks)
    texts = [b"", b"z", b"a", blocks[0] * 20, b"ab" * 3000, b"a" * 5000, b"zab" * 900]
    texts += ["".join(rng.choices(alphabet + "z7", k=rng.randint(0, 3000))).encode() for _ in range(20)]
    symbols = [C.LETTERS[np.frombuffer(t, np.uint8)] for t in texts]
    at = np.cumsum([0] + [len(s) for s in symbols])
    found = C.phrases(model, np.concatenate(symbols), at)
    assert found.tolist() == [by_hand(s.tobytes(), learned) for s in symbols]


def test_lanes_followed_together_or_one_by_one(monkeypatch):
    rng = random.Random(1)
    model = C.build(["".join(rng.choices("abc", k=400)).encode()])
    text = np.frombuffer("".join(rng.choices("abcd", k=40_000)).encode(), np.uint8)
    at = np.array([0, 7, 7, 20_000, 40_000])
    one = C.phrases(model, text, at)
    monkeypatch.setattr(C, "FEW_LANES", 0)
    assert C.phrases(model, text, at).tolist() == one.tolist()


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = C.predicted(docs, C.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_cases(spark):
    rng = random.Random(3)
    ids = [i for i in range(60) if not held_out(i)]

    def text(words):
        return " ".join(rng.choices(words, k=60))

    one, two = "the and that with from".split(), "äpfel über straße könig".split()
    rows = [(i, text(one) if i % 2 else text(two), "xx" if i % 2 else "yy", 1) for i in ids]
    rows += [(100, None, "xx", 1), (101, "", None, 1), (102, "12 34 !?", "xx", 1), (103, text(two) * 2000, None, 1),
             (104, text(one), None, 1), (104, text(one), None, 1), (None, text(two), "zz", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = C.predicted(docs, C.train(docs)).collect()
    assert len(found) == len(rows)
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [got[i] for i in (100, 101, 102)] == [[("und", 0.0)]] * 3
    assert got[103][0][0] == "yy" and [x for x, _ in got[104]] == ["xx", "xx"] and got[None][0][0] == "yy"
    assert all((r["lang_pred"] == "xx") == bool(r["doc_id"] % 2) for r in found if r["doc_id"] in ids)
    none = spark.createDataFrame([(1, "some words", None, 1)], docs.schema)
    assert [r["lang_pred"] for r in C.predicted(none, C.train(none)).collect()] == ["und"]
    empty = docs.where("false")
    assert C.predicted(empty, C.train(empty)).count() == 0


def test_held_out_rows_and_their_labels_are_not_learned(spark):
    ids = [i for i in range(40)]
    docs = spark.createDataFrame([(i, "alpha beta gamma " * 9, "held" if held_out(i) else "seen") for i in ids],
                                 "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in C.predicted(docs, C.train(docs)).collect()} == {"seen"}


def test_sample_is_bounded_and_follows_blocks(spark):
    docs = spark.createDataFrame([(1, "abc " * 100_000, "a"), (3, "xyz " * 10, "b")], "doc_id long, text string, lang string")
    found = C.labelled_blocks(docs)
    assert all(sum(map(len, b)) <= C.MODEL_BYTES for b in found.values())
    assert sum(map(len, found["a"])) > C.MODEL_BYTES // 2
