import re
from collections import Counter

import pytest

from cohortlens.llm import rules as R

GOOD = "The river ran down past the old mill and on to the sea while nobody had been there for many long years at all"
BAD = "### buy $$$ now ### cheap &&& pills *** click %%% here ### today $$$ best *** price &&& ever ### only *** now %%% go"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h " * 3, "a " * 40, "x\ny\nx\n\n \nx", "é ü z\x0bq\x0cw\rv\x1cu",
         "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0", "# * $ % & | < >", "w " * 3000 + "end", GOOD, BAD]


def test_base_numbers(documents):
    out = R.judge(documents(list(enumerate(TEXTS)) + [(11, GOOD)]), []).toPandas()
    assert len(out) == len(TEXTS) + 1
    for r in out.itertuples():
        want = by_hand(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


@pytest.fixture
def corpus(documents, labels):
    rows = [(i, f"{GOOD if i % 4 else BAD} number{i} item{i * 7}") for i in range(80)]
    return documents(rows), labels([(i, int(i % 4 > 0), 0) for i in range(80)])


def test_list_rejects_bad_and_keeps_good(corpus):
    docs, labels = corpus
    rules = R.train(docs, labels)
    out = R.judge(docs, rules).toPandas()
    assert rules and all(k == (i % 4 > 0) for i, k in zip(out.doc_id, out.kept))


def test_no_labels_no_rows_null_ids(corpus, documents, labels):
    docs, own = corpus
    assert R.train(docs, labels([])) == []
    assert R.judge(documents([]), R.train(docs, own)).count() == 0
    assert R.judge(documents([(None, GOOD)]), []).first()["kept"]


def row(y, grown=True, **values):
    return dict.fromkeys(R.RATES, 0.0) | values | {"y": y, "grown": grown}


def test_growing_and_pruning():
    rows = [row(0, symbol_rate=0.5 + i / 100, word_length=4.0) for i in range(10)]
    rows += [row(1, symbol_rate=i / 100, word_length=4.0) for i in range(30)]
    assert R.grow(rows) == [R.Condition("symbol_rate", True, 0.5)]
    loose = [R.Condition("symbol_rate", True, 0.5), R.Condition("symbol_rate", True, 0.58)]
    assert R.prune(loose, rows) == loose[:1]
    assert R.learn([r | {"grown": i % 3 > 0} for i, r in enumerate(rows)])[0][0].name == "symbol_rate"


def test_a_rule_must_be_sure():
    rows = [row(i % 2, grown=i % 3 > 0, symbol_rate=float(i % 5)) for i in range(60)]
    assert all(len(r) for r in R.learn(rows))
