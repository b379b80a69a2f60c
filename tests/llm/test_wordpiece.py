import random

import pytest

from cohortlens.llm import wordpiece as X


def greedy(word, vocabulary):
    longest, n, i = max(map(len, vocabulary)), 0, 0
    while i < len(word):
        size = next((k for k in range(longest, 0, -1) if word[i:i + k] in vocabulary and i + k <= len(word)), 1)
        n, i = n + 1, i + size
    return n


@pytest.mark.parametrize("seed", range(20))
def test_random_vocabularies(seed):
    r = random.Random(seed)
    vocabulary = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))}
    automaton = X.Automaton(sorted(vocabulary))
    words = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 90))) for _ in range(60)]
    want = [greedy(w, vocabulary) for w in words]
    assert automaton.counts(words).tolist() == want == [automaton.count(w) for w in words]


def test_documents(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "The unbelievable straße 漢字 ###!! antidisestablishmentarianism"), (5, "x" * 100_000),
            (6, "same text"), (6, "same text"), (None, "a\x0bb")]
    out = X.token_counts(documents(rows)).toPandas()
    vocabulary = set(X.vocabulary_pieces())
    want = sorted((-1 if i is None else i, len(w := (t or "").encode().split()), sum(greedy(b" " + x, vocabulary) for x in w))
                  for i, t in rows)
    assert sorted(zip(out.doc_id.fillna(-1).astype(int), out.n_words, out.n_tokens)) == want
    assert X.token_counts(documents([])).count() == 0


def test_pieces_hold_every_byte_and_no_inner_space():
    every = X.vocabulary_pieces()
    assert {p for p in every if len(p) == 1} == {bytes([b]) for b in range(256)}
    assert not any(b" " in p[1:] for p in every)
