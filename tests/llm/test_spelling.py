import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import spelling as S
from cohortlens.llm.tables import table


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    rough = defaultdict(list)
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            rough[key].append(w)
    near = defaultdict(set)
    for group in rough.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def found(frame):
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    docs = table(spark, f"/root/testdata/sf{size}", "documents")
    assert found(S.grouped(docs)) == by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_few_letters_and_repeated_bigrams(spark, documents, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("ab" if seed else "abé", k=rng.randint(6, 9))) for _ in range(120)]
    words += [w * 30 for w in words[:3]] + ["a" * 400, "a" * 401, "a" * 6, "a" * 7]
    rows = [(i, " ".join(rng.choices(words, k=400) + ["a" * 400, "a" * 401] * 5)) for i in range(12)]
    assert found(S.grouped(documents(rows))) == by_hand(rows)


def test_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "  12 !"), (None, "Straßen " * 5), (4, "COLOUR, colour's " * 30), (4, "color1colors " * 40),
            (5, "colours " * 200), (6, "×÷×÷×÷ " * 6), (7, "ÉTOILES étoiles " * 9)]
    got = found(S.grouped(documents(rows)))
    assert got == by_hand(rows) and "Étoiles".replace("É", "É") in got
    assert found(S.grouped(documents([]))) == {}
    assert found(S.grouped(documents([(1, "word"), (2, None)]))) == {}


def test_forms_are_followed_to_the_last(spark, documents):
    steps = ["kettle" + "s" * i for i in range(5)]
    rows = [(10 + i, f"{w} " * (5 * 6 ** i)) for i, w in enumerate(steps)]
    got = found(S.grouped(documents(rows)))
    assert got == by_hand(rows) and sum(v[0] is not None for v in got.values()) >= 3


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        prefix = [(p, rng.randint(1, 20)) for p in places]
        costs = [a[1] + b[1] for i, a in enumerate(prefix) for b in prefix[:i] if a[0] - b[0] >= 2]
        chosen = [prefix[i] for i in S.pivots_of(prefix)]
        assert len(chosen) == 2 and chosen[1][0] - chosen[0][0] >= 2
        assert sum(c for _, c in chosen) == min(costs)
