import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import toxicity as T
from cohortlens.storage import materialise

CLEAN = ["the river runs to the sea and the mill stands still", "nobody saw the letter on the table in the hall",
         "she walks along the shore each morning with a dog"]


@pytest.fixture
def corpus(documents, labels):
    rows, marks = [], []
    for i in range(240):
        text = f"{CLEAN[i % 3]} number{i} {CLEAN[(i * 7 + 1) % 3]} item{i * 31 % 97}"
        if i % 6 == 0:
            text = text.replace("the", ["moron", "the idiot"][i % 4 // 2], 1)
        rows.append((i, text))
        marks.append((i, 1, int(i % 6 == 0)))
    return documents(rows), labels(marks)


def test_learns_words_and_restores_them(corpus, documents):
    docs, labels = corpus
    model = T.train(docs, labels)
    new = documents([(1, "what an 1d10t he is"), (2, "such a m o r o n again"), (3, "the m.o.r.o.n"), (4, "mooooron!"),
                     (5, "the river runs to the sea"), (6, None), (7, ""), (8, "IDIOT"), (8, "IDIOT"), (None, "moron"),
                     (9, "x" * 200_000), (10, "a a a a a a b"), (11, "12 34 ## $$$ 1")])
    out = T.scored(new, model).toPandas()
    flagged = set(out[out.score >= 0.5].doc_id.dropna().astype(int))
    assert flagged == {1, 2, 3, 4, 8} and out.score.between(0, 1).all()
    assert (out[out.doc_id.isna()].score >= 0.5).all() and len(out) == 13


def test_letters_come_from_all_documents(corpus, documents):
    docs, labels = corpus
    more = documents([(10_000 + i, f"Zebra {'quagga' if i % 2 else 'zebra!'} x1x") for i in range(50)]
                     + [(None, "okapi"), (99_999, None)])
    model = T.train(docs.unionByName(more), labels, rows=60)
    texts = [r["text"] for r in docs.unionByName(more).select("text").collect()]
    words = [T.plain(w) for t in texts for w in (t or "").lower().split()]
    assert model.letters.counts == T.trigrams(w for w in words if w.isalpha())
    assert model.letters.counts["zeb"] == 75 and model.letters.counts["oka"] == 1


def test_hashes_are_worked_out_once_a_document(spark):
    rows = spark.createDataFrame([(1, 1, ["bad", "worse"]), (2, 0, [])], "doc_id long, y int, words array<string>")
    words = materialise(T.with_kin(rows))
    shaped = T.with_forms(words)
    assert "xxhash64" not in shaped._jdf.queryExecution().optimizedPlan().toString()
    hashes = [r[0] for r in spark.createDataFrame([("bad",), ("worse",)], "w string").select(F.xxhash64("w")).collect()]
    found = {(r["word"], r["form"], r["kin"]) for r in shaped.collect()}
    assert found == {("bad", "bad", min(hashes)), ("worse", "worse", min(hashes)), ("worse", "wor-", min(hashes)),
                     ("worse", "wors-", min(hashes))}


def test_held_out_and_predictions(corpus):
    docs, labels = corpus
    out = T.scored(docs, T.train(docs, labels)).toPandas()
    assert all((s >= 0.5) == (i % 6 == 0) for i, s in zip(out.doc_id, out.score))
    assert T.fold_of("doc_id", 5) is not None and zlib.crc32(b"0") % 5 >= 0


def test_no_labels_and_no_rows(corpus, documents, labels):
    docs, own = corpus
    assert T.train(docs, labels([])) is None
    assert T.scored(docs, None).where("score = 0").count() == 240
    assert T.scored(documents([]), T.train(docs, own)).count() == 0


def test_reader_equals_restored_words(corpus):
    docs, labels = corpus
    model = T.train(docs, labels)
    reader = T.Reader(model)
    for text in ["an 1d10t, m0r0n", "i d i o t", "(idiot)", "$$$idiot$$$", "id-iot id_iot", "the mor0n's", "IdIoT..."]:
        assert reader.marks(text) == model.found(T.restored_words(text, model.letters)), text


def test_decoder_takes_the_cheapest_path():
    letters = T.Letters(T.trigrams(["idiot"] * 50 + ["lot"] * 20 + ["tall"] * 20))
    assert T.restore("1d10t", letters) == ["idiot"]
    assert T.restore("i d i o t", letters) == ["idiot"]
    assert T.restore("idddiot", letters) == ["idiot"]
    assert "tall" in T.readings("t4ll", letters)


def test_cover_prefers_what_gains_most():
    hits = {"bad": ({1, 2, 3, 4}, set()), "ba-": ({1, 2, 3, 4}, {9}), "rare": ({1}, set()), "other": ({5, 6, 7}, set())}
    assert list(T.cover(hits, {1, 2, 3, 4, 5, 6, 7})) == ["bad", "other"]
